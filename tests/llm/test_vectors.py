import numpy as np
import pytest

from quillmark.llm import queries, vectors

from .helpers import SF, Union


def brute(rows, threshold=0.98):
    """vec -> (links, component) by all pairs."""
    unit, u, links = {}, Union(), {}
    for v, e, label in rows:
        links[v], x = 0, None if e is None or not len(e) or any(c is None for c in e) else np.array(e, np.float64)
        u.find(v)
        if label is not None and x is not None and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            unit[v] = x / np.sqrt((x * x).sum()), label
    ids = sorted(unit)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            (x, p), (y, q) = unit[a], unit[b]
            if p == q and len(x) == len(y) and float(x @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    return {v: (links[v], u.find(v)) for v in links}


def fixture():
    g = np.random.default_rng(8)
    rows = []
    for _ in range(20):
        c = g.standard_normal(8)
        rows += [(len(rows) + i, (c + 0.09 * g.standard_normal(8)).astype(np.float32).tolist(), int(g.integers(0, 3))) for i in range(int(g.integers(1, 9)))]
    x = rows[3][1]
    odd = [x, x, [2 * c for c in x], None, [], [0.0] * 8, [float("nan"), *x[1:]], [float("inf"), *x[1:]], [None, *x[1:]], x[:4], [1e38] * 8, [1e-38] * 8, [1.0] * 8]
    rows += [(1000 + i, e, rows[3][2]) for i, e in enumerate(odd)]
    return rows + [(1100, x, None), (1101, x, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.5, "y") for r in rows], "vec_id long, embedding array<float>, label int, V double, n string")


@pytest.mark.parametrize("block", [5, 2048])
def test_equals_brute_force(spark, block):
    rows = fixture()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table(spark, rows), block=block).collect()}
    assert got == brute(rows)


def clusters(n=600, dim=8, near=0.02, seed=4):
    g = np.random.default_rng(seed)
    c = g.standard_normal((30, dim))
    return [(i, (c[i % 30] + near * g.standard_normal(dim)).astype(np.float32).tolist(), i % 7 == 0) for i in range(n)]


def test_cells_equal_brute_force_and_prune_pairs(spark):
    rows = [(i, v, int(k)) for i, v, k in clusters()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table(spark, rows), block=20).collect()}
    assert got == brute(rows)
    unit = np.array([v for _, v, k in rows if not k], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    reps = spark.createDataFrame([(i, 1, u.tolist(), 0) for i, u in enumerate(unit)], "id long, copies long, v array<double>, label int")
    dealt = vectors._dealt(reps, 0.98, 20)
    pairs = dealt.select("i", "p", "j", "q").distinct().collect()
    cells = {(r["i"], r["p"]) for r in pairs} | {(r["j"], r["q"]) for r in pairs}
    assert len(cells) > 20 and len(pairs) < 0.25 * len(cells) * (len(cells) + 1) / 2
    assert dealt.where("side <= 1").select("id").distinct().count() == len(unit)


@pytest.mark.parametrize("most", [64, 4096])
def test_unprunable_vectors_and_few_centres(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "MAX_PAIRS", 500)
    monkeypatch.setattr(vectors, "MAX_CENTRES", most)
    g = np.random.default_rng(1)
    rows = [(i, g.standard_normal(40).astype(np.float32).tolist(), 0) for i in range(500)]
    rows += [(1000 + i, rows[i][1], 0) for i in range(5)] + [(2000 + i, [x * 1.001 + 0.01 for x in rows[i][1]], 0) for i in range(300)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table(spark, rows), block=10).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_trees_find_every_pair(seed):
    g = np.random.default_rng(seed)
    x = g.standard_normal((40, 6))[g.integers(0, 40, 300)] + 0.1 * g.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = set()

    def found(p, q, m):
        pairs.update((int(a), 150 + int(b)) for i, a in enumerate(p) for b in np.asarray(q)[m[i]])

    vectors.dual_links(vectors.CoverTree(x[:150]), vectors.CoverTree(x[150:]), 0.95, found)
    a, b = np.nonzero(x[:150] @ x[150:].T >= 0.95)
    assert pairs == set(zip(a.tolist(), (b + 150).tolist(), strict=True)) and pairs


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (None, [1.0, 0.0], 0)]
    got = sorted(tuple(r) for r in vectors.near_vectors(table(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)]
    assert vectors.near_vectors(table(spark, rows).where("false")).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op8_embedding_duplicates(spark, SF).collect()}
    assert got == brute(rows)
