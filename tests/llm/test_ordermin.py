import random

import numpy as np
import pytest

from quillmark.llm import ordermin, queries
from quillmark.llm.components import components

from .helpers import SF, Union, documents, words


def labelled(text, k=5):
    w = words(text)
    if not w:
        return []
    seen, out = {}, []
    for i in range(max(1, len(w) - k + 1)):
        g = tuple(w[i : i + k])
        out.append((g, seen.setdefault(g, 0)))
        seen[g] += 1
    return out


def common(a, b):
    """Longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute(docs, threshold=0.8):
    """doc -> smallest document of its class."""
    seqs, u = {d: labelled(t) for d, t in docs}, Union()
    ids = sorted(seqs)
    for i, a in enumerate(ids):
        u.find(a)
        for b in ids[:i]:
            x, y = seqs[a], seqs[b]
            if x and y and len(set(x) & set(y)) >= threshold * (len(x) + len(y)) / (1 + threshold) - 1e-9:
                m = common(x, y)
                if m / (len(x) + len(y) - m) >= threshold:
                    u.join(a, b)
    return {d: u.find(d) for d in ids}


def edited(g, w, n):
    w = list(w)
    for _ in range(n):
        i = g.randrange(len(w))
        w[i : i + g.randint(0, 1)] = [f"new{g.randrange(999)}"]
    return w


def fixture():
    g = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for group in range(12):
        base = [g.choice(vocabulary) for _ in range(g.randint(20, 160))]
        for copy in range(g.randint(1, 5)):
            docs.append((len(docs) * 2 - 9, " ".join(edited(g, base, g.randint(0, 3)))))
        if group % 4 == 0:  # a chain: each is near the next
            for _ in range(4):
                base = edited(g, base, 1)
                docs.append((len(docs) * 2 - 9, ", ".join(base).upper()))
            half = len(base) // 2
            docs.append((len(docs) * 2 - 9, " ".join(base[half:] + base[:half])))  # the same words in another order
    docs += [(900, None), (901, ""), (902, " .. "), (903, "one two"), (904, "One, two!"), (905, "one two three"), (906, "la " * 400), (907, "la " * 420), (908, "la " * 900), (909, "one two"), (910, "é ü")]
    return docs


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


def test_equals_brute_force(spark):
    docs = fixture()
    assert classes(ordermin.near_texts(documents(spark, docs))) == brute(docs)


def test_blocks_equal_pairs(spark, monkeypatch):
    docs = fixture()
    monkeypatch.setattr(ordermin, "FEW", 2)
    monkeypatch.setattr(ordermin, "BLOCK_KMERS", 100)
    assert classes(ordermin.near_texts(documents(spark, docs))) == brute(docs)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_the_plain_table(seed):
    g = random.Random(seed)
    base = [f"w{g.randrange(30)}" for _ in range(80)]
    a, b = " ".join(base), " ".join(edited(g, base, seed * 2))
    x, y = labelled(a), labelled(b)
    m = common(x, y)
    s = m / (len(x) + len(y) - m)
    h = [np.array([hash(z) & (2**63 - 1) for z in q], np.uint64) for q in (x, y)]
    got = ordermin.alignment(*h)
    assert got == pytest.approx(s) if s >= 0.8 else got < 0.8


def test_sketch_knows_order():
    e = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (ordermin.sketch(e) == ordermin.sketch(e)).all()
    assert (ordermin.sketch(e) == ordermin.sketch(e[::-1])).sum() == 0


def test_rows_that_stay(spark):
    t = "a text of some words that is there twice or more often than that"
    rows = [(5, t), (3, t.upper()), (3, t.upper()), (8, None), (9, None), (None, t), (7, "another text")]
    out = ordermin.drop_near_texts(documents(spark, rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 3), (False, 3), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert "X" in out.columns
    assert classes(ordermin.near_texts(documents(spark, []))) == {}


def test_copies_without_words_are_a_class(spark):
    rows = [(4, "-----"), (2, "-----"), (9, "----"), (6, "-----"), (1, " \n"), (3, " \n"), (5, None), (7, None), (8, ""), (10, ""), (11, "a text of words"), (12, "A text of words --")]
    got = classes(ordermin.near_texts(documents(spark, rows)))
    assert got == {4: 2, 2: 2, 6: 2, 9: 9, 1: 1, 3: 1, 5: 5, 7: 7, 8: 8, 10: 8, 11: 11, 12: 11}


def test_components(spark):
    g = random.Random(4)
    links = [(g.randrange(150), g.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)] + [(400, 400 + i) for i in range(50)] + [(7, 7), (None, 3)]
    u = Union()
    for a, b in links:
        if a is not None and a != b:
            u.join(a, b)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: u.find(x) for x in list(u.up)}
    assert components(df.where("false")).collect() == []


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(d, t) for d, t in docs if len(words(t)) <= 1500]  # the plain table is slow
    got = {r["doc_id"]: r for r in queries.op3_minhash_duplicates(spark, SF).collect()}
    assert got.keys() == {d for d, _ in docs}
    want = brute(short)
    known = dict(short)
    assert {d: r["class_id"] for d, r in got.items() if d in known and r["class_id"] in known} == {d: c for d, c in want.items() if got[d]["class_id"] in known}
    assert all(r["kept"] == (d == r["class_id"]) for d, r in got.items())
