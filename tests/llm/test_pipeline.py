"""The pipeline's stages on a small fixture, each held against brute force on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillmark.llm import toxicity

from .helpers import words
from .test_ordermin import brute as classes
from .test_packing import check_packed, reference_ids
from .test_scans import hits_of
from .test_suffixes import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    g, d = random.Random(5), str(tmp_path_factory.mktemp("sf"))
    v = [f"{a}{b}" for a in ("river", "stone", "cloud", "field", "house") for b in ("", "s", "side", "land", "walk", "light")]
    say = lambda n: " ".join(g.choice(v) for _ in range(n))
    bench = [(i, say(20)) for i in range(6)]
    passage = say(30)
    docs, labels = [], []
    for i in range(160):
        toxic = i % 8 == 3
        text = say(g.randint(30, 90)) + (" you rotten vile scumbag " if toxic else " ") + say(20)
        docs.append((i, text))
        labels.append((i, 1, int(toxic)))
    for i in range(200, 212):
        docs.append((i, docs[(i - 200) * 7][1] + (" end" if i % 2 else "")))
    docs += [(300 + i, say(60) + " " + passage + " " + say(50)) for i in range(4)]
    docs += [(400 + i, say(10) + " " + bench[i][1]) for i in range(4)] + [(500, None), (501, ""), (502, say(3000)), (503, say(700) + " " + bench[5][1])]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity.fit, "__defaults__", (120, *toxicity.fit.__defaults__[1:]))  # fewer steps
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        rows = spark.read.parquet(path).collect()
        if k < 4:
            assert out.columns == docs.columns and len({r["doc_id"] for r in rows}) == len(rows)
            assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in rows)
        after = {r["doc_id"]: r["text"] for r in rows} if k < 4 else {}
        if k == 0:
            toxic = {d for d, t in before.items() if "scumbag" in (t or "")}
            gone = before.keys() - after.keys()
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3
        elif k == 1:
            c = classes(sorted((d, t) for d, t in before.items()))
            assert after == {d: t for d, t in before.items() if c[d] == d}
        elif k == 2:
            left = {d: x[3] for d, x in repeats(list(before.items())).items()}
            assert {d: (t or "").encode() for d, t in after.items()} == left
            assert sum(after[d] != before[d] for d in after) >= 3
        elif k == 3:
            want = hits_of(list(before.items()), bench)
            kept = {d for d, (n, hit, _) in want.items() if not hit or 20 * len(hit) < n}
            assert after.keys() == kept and after.keys() != before.keys()
            assert all(words(t) == [w for i, w in enumerate(words(before[d])) if i not in want[d][1]] for d, t in after.items())
        else:
            check_packed(rows, 1024)
            got = {}
            for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
                got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
            ids = sorted(before)
            assert {d: np.frombuffer(x, "<u4").tolist() for d, x in got.items()} == dict(zip(ids, reference_ids([before[d] for d in ids]), strict=True))
        if k < 4:
            docs = spark.read.parquet(path)


def test_tables_without_rows(spark, folder, tmp_path):
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{n}.parquet").where("false").write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
