import hashlib
import random

import numpy as np
import pytest

from quillmark.llm import queries, suffixes

from .helpers import SF, documents


def brute(docs, length=50):
    """doc -> (bytes, removed, spans, what is left) by a table of all strings of ``length`` bytes."""
    raw = {d: (t or "").encode() for d, t in docs}
    first = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - length + 1):
            first.setdefault(raw[d][i : i + length], d)
    out = {}
    for d, x in raw.items():
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        out[d] = len(x), int(gone.sum()), spans, bytes(b for b, g in zip(x, gone, strict=False) if not g)
    return out


def fixture(seed=1):
    g = random.Random(seed)
    w = [f"{x}{i}" for i in range(60) for x in ("river", "stone", "é", "tree")]
    passage = [" ".join(g.choice(w) for _ in range(14)) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [" ".join(g.choice(w) for _ in range(g.randint(0, 30))) for _ in range(3)]
        parts.insert(g.randint(0, 3), g.choice(passage))
        if d % 7 == 0:
            parts += [passage[0], passage[0][: g.randint(40, 60)]]
        docs.append((d * 3 - 20, g.choice([" ", "\n"]).join(parts)))
    docs += [(500, docs[5][1]), (501, docs[5][1]), (502, "ab" * 200), (503, "ab" * 300), (504, None), (505, ""), (506, "short"), (507, "a" * 49), (508, "a" * 50), (509, "a" * 51)]
    return docs + [(510, " ".join(g.choice(passage) for _ in range(3000)))]


def found(spark, docs, **how):
    got = {}
    for r in suffixes.repeats(documents(spark, docs), **how).collect():
        assert r["doc_id"] not in got
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        got[r["doc_id"]] = sum(b - a for a, b in spans), len(spans), bytes(r["kept"])
    return got


@pytest.mark.parametrize("how", [{}, {"bucket_bytes": 2000, "hot": 0}])
def test_equals_brute_force(spark, how):
    docs = fixture()
    want = {d: x[1:] for d, x in brute(docs).items() if x[1]}
    assert found(spark, docs, **how) == want


@pytest.mark.parametrize("hot", [1, 3, 6])
def test_a_threshold_in_between_does_not_change_the_result(spark, hot):
    docs = fixture(7)
    g = random.Random(8)
    line = "a line that stands in very many documents and is longer than any window is"
    docs += [(1000 + i, f"{g.random()} {line} {g.random()}") for i in range(60)]
    want = {d: x[1:] for d, x in brute(docs).items() if x[1]}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "9")  # several runs, each of several documents
    try:
        assert found(spark, docs, bucket_bytes=2000, hot=hot) == want
    finally:
        spark.conf.set(name, before)


def test_a_suffix_array_is_in_order():
    g = random.Random(3)
    x = bytes(g.choice(b"ab\x00\xff") for _ in range(300)) + b"ab" * 200
    at = np.array(sorted(g.sample(range(len(x) - 49), 400)))
    order, new = suffixes.suffix_array(suffixes._words(np.frombuffer(x, np.uint8)), at)
    strings = [x[i : i + 50] for i in at[order].tolist()]
    assert strings == sorted(strings) and sorted(order.tolist()) == list(range(400))
    assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(400)]


def test_levels_of_the_index_stay_geometric():
    g = random.Random(2)
    x = b"".join(bytes(g.choice(b"abc") for _ in range(8)) * g.randint(1, 12) + b"." for _ in range(400))
    words, n, seen = suffixes._words(np.frombuffer(x, np.uint8)), len(x) - 49, {}
    index = suffixes.LogIndex(words)
    for doc, a in enumerate(range(0, n, 200)):
        at = np.arange(a, min(a + 200, n))
        order, new = suffixes.suffix_array(words, at)
        at = at[order][new]
        batch = at, np.full(len(at), doc), words[at]
        strings = [x[i : i + 50] for i in at.tolist()]
        assert [None if k > doc else k for k in index.scan(batch).tolist()] == [seen.get(k) for k in strings]
        for k in strings:
            seen.setdefault(k, doc)
        index.add(batch)
        sizes = [len(level[0]) for level in index.levels]
        assert all(p >= 2 * q for p, q in zip(sizes, sizes[1:], strict=False))
        for at, docs, head in index.levels:
            strings = [x[i : i + 50] for i in at.tolist()]
            assert strings == sorted(set(strings)) and all(seen[k] <= d for k, d in zip(strings, docs.tolist(), strict=True))  # a larger level may have it as well
            assert (head == words[at]).all()
    assert index.depth > 3


def test_batches_and_parts_do_not_change_the_result():
    docs = [(d, t.encode()) for d, t in fixture(4) if t and len(t.encode()) >= 50]
    ids = np.zeros(len(docs), suffixes._PAIR)
    ids["doc"] = [d for d, _ in docs]
    size = np.array([len(t) for _, t in docs])
    data = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
    results = []
    for batch in (100, 1 << 22):
        d, a, b, depth = suffixes.indexed_repeats(ids, np.zeros(len(docs), np.int64), size, np.cumsum(size) - size, data, batch)
        results.append(sorted(zip(d["doc"].tolist(), a.tolist(), b.tolist(), strict=True)))
        assert depth == 1 or batch == 100
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("batch, part", [(50, 1 << 21), (50, 400), (1 << 16, 1)])
def test_a_bucket_is_indexed_in_levels(monkeypatch, batch, part):
    """What the query does in a bucket, with small batches: the index has several levels, and the result is that of all strings."""
    docs = sorted((d, t) for d, t in fixture(9) if t)
    docs = [(d, t) for d, t in docs if len(t.encode()) >= 50]
    ids = np.zeros(len(docs), suffixes._PAIR)
    ids["doc"] = [d for d, _ in docs]
    raw = [t.encode() for _, t in docs]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    row, lo, hi, _ = suffixes.anchors(data, at)
    z = hi - lo + 50
    cells = np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z - lo, z)
    depths, plain = [], suffixes.indexed_repeats

    def watched(*args):
        out = plain(*args)
        depths.append(out[3])
        return out

    monkeypatch.setattr(suffixes, "indexed_repeats", watched)
    d, a, b = suffixes._repeats(ids[row], lo - at[row], z, data[cells], batch, part)
    got = {}
    for doc, x, y in zip(d["doc"].tolist(), a.tolist(), b.tolist(), strict=True):
        got.setdefault(doc, set()).update(range(x, y))
    assert {k: len(v) for k, v in got.items()} == {k: v[1] for k, v in brute(docs).items() if v[1]}
    assert max(depths) > 2 if part > 1 and batch == 50 else depths
    assert part > 400 or len(depths) > 1


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    t = "one sentence of quite some length that is there again and again"
    assert found(spark, [(1, t), (1, t), (None, t)]) == {}
    rows = suffixes.repeats(documents(spark, [(1, t), (2, t), (2, t), (2, t + "!")])).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in rows) == [(2, b""), (2, b"!")]
    assert found(spark, []) == {}


def test_texts_stay_valid(spark):
    # the first byte of the last letters is the same, so the letter is cut through and goes
    a, b = "ж" * 30 + "я", "x" * 3 + "ж" * 30 + "ю"
    out = {r["doc_id"]: r for r in suffixes.remove_repeats(documents(spark, [(1, a), (2, b), (3, None), (None, a)])).collect()}
    assert out[1]["text"] == a and out[3]["text"] is None and out[None]["text"] == a
    assert out[2]["text"] == "xxx" and out[2]["X"] == "x"


def test_columns_named_as_those_inside(spark):
    a = "one sentence of quite some length that is there again and again"
    docs = spark.createDataFrame([(1, a, 5, 6, 7), (2, a, 5, 6, 8)], "doc_id long, text string, _q_id long, _q_key long, _Q_KEPT long")
    out = sorted(suffixes.remove_repeats(docs).collect())
    assert out == [(1, a, 5, 6, 7), (2, "", 5, 6, 8)]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(d, n, gone, k, hashlib.sha256(left).hexdigest()) for d, (n, gone, k, left) in brute(docs).items()}
    rows = queries.op7_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(rows) == len(docs) and set(map(tuple, rows)) == want
