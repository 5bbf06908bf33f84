"""Embedding near-duplicates: cover trees and their dual traversal find every pair of a cosine at or above a threshold.

On unit vectors a cosine is a distance, so the triangle inequality holds. A cover tree has nested levels of centres with halving radii. Its
top is made once for each label of many vectors, from a bounded sample: all vectors are dealt to cells by their nearest centre, and a cell's
covering radius is that of all its vectors. Pairs of cells whose centres are farther apart than both radii and the threshold's
distance are pruned with all in them; what is left is a task for each pair, in which both sides get the rest of their trees, whose pairs of
nodes are pruned likewise. Of pairs that are left at the leaves the cosine is taken. Cells of over BLOCK vectors are split into parts, so
no task depends on a label's or a cell's size. A task returns link counts and a forest, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .components import components

BLOCK = 2048
#: Bounds of what the driver and each task know of the tops of the trees: centres and their components.
MAX_CENTRES, MAX_NUMBERS = 4096, 4 << 20
#: Vectors of the sample for each centre that is wanted.
SAMPLE = 4
#: Pairs of near cells that are listed; a label with more is dealt without cells.
MAX_PAIRS = 1 << 20
SLACK = 1e-9


def _radii(threshold: float) -> list[float]:
    """Halving radii down to about the distance at which vectors are linked."""
    return [0.5**k for k in range(11) if k < 3 or 0.5**k >= _reach(threshold)]


def _reach(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def _cover(x: np.ndarray, rows: np.ndarray, r: float) -> list[np.ndarray]:
    """Rows in groups, each within r of its first; the firsts are over r apart."""
    out, least = [], 1 - r * r / 2
    while len(rows):
        near = x[rows] @ x[rows[0]] >= least
        near[0] = True
        out.append(rows[near])
        rows = rows[~near]
    return out


class CoverTree:
    """``levels[k]``: (centre rows, covering radii, children in the next level as offsets); the last level is the points themselves."""

    def __init__(self, x: np.ndarray, threshold: float = 0.98):
        self.x = x
        members = [np.arange(len(x))]
        self.centres, self.radii, self.children = [], [], []
        groups = members
        for r in _radii(threshold):
            below: list[np.ndarray] = []
            counts = []
            for g in groups:
                kids = _cover(x, g, r)
                counts.append(len(kids))
                below += kids
            self._add(groups, np.array(counts))
            groups = below
        self._add(groups, np.array([len(g) for g in groups]))
        self.points = np.concatenate(groups) if groups else np.zeros(0, np.int64)

    def _add(self, groups: list[np.ndarray], counts: np.ndarray) -> None:
        self.centres.append(np.array([g[0] for g in groups], np.int64))
        self.radii.append(np.array([math.sqrt(max(0.0, 2 - 2 * float((self.x[g] @ self.x[g[0]]).min()))) if len(g) > 1 else 0.0 for g in groups]))
        self.children.append(np.concatenate(([0], np.cumsum(counts))))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def dual_links(a: CoverTree, b: CoverTree, threshold: float, found) -> None:
    """Calls ``found(rows of a, rows of b, linked matrix)`` for all pairs of points that may be linked; others are not."""
    reach = _reach(threshold)
    if not len(a.x) or not len(b.x):
        return
    partners = [np.array([0])]
    for k in range(len(a.centres)):
        last = k == len(a.centres) - 1
        following: list[np.ndarray] = []
        for node, near in enumerate(partners):
            mine = np.arange(a.children[k][node], a.children[k][node + 1])
            theirs = np.concatenate([np.arange(b.children[k][n], b.children[k][n + 1]) for n in near]) if len(near) else np.zeros(0, np.int64)
            for i in range(0, len(mine), 512):
                part = mine[i : i + 512]
                if not len(theirs):
                    following += [theirs] * len(part)
                elif last:
                    p, q = a.points[part], b.points[theirs]
                    found(p, q, a.x[p] @ b.x[q].T >= threshold)
                else:
                    keep = _distance(a.x[a.centres[k + 1][part]], b.x[b.centres[k + 1][theirs]]) <= a.radii[k + 1][part][:, None] + b.radii[k + 1][theirs][None, :] + reach
                    following += [theirs[m] for m in keep]
        partners = following


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.root[rows])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]


def _links_of_blocks(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, side: np.ndarray, threshold: float) -> pd.DataFrame:
    """side 0: both blocks are the same one."""
    order = np.argsort(ids, kind="stable")  # so that a root is the smallest id
    ids, copies, x, side = ids[order], copies[order], x[order], side[order]
    counts, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    one, two = np.flatnonzero(side <= 1), np.flatnonzero(side == 2)

    def found(p: np.ndarray, q: np.ndarray, linked: np.ndarray, left: np.ndarray = one, right: np.ndarray = two) -> None:
        p, q = left[p], right[q]
        linked &= p[:, None] != q[None, :]
        some = np.flatnonzero(linked.any(axis=1))
        counts[p] += linked @ copies[q]
        if right is not left:
            np.add.at(counts, q, linked.T @ copies[p])
        for i in some:
            forest.join(np.append(q[linked[i]], p[i]))

    a = CoverTree(x[one], threshold)
    if (side == 0).any():
        dual_links(a, a, threshold, lambda p, q, m: found(p, q, m, one, one))
    else:
        dual_links(a, CoverTree(x[two], threshold), threshold, found)
    some = counts > 0
    return pd.DataFrame({"id": ids[some], "n": counts[some], "root": ids[forest.root[some]]})


def unit(vectors: pd.Series) -> pd.Series:
    """Vectors of length 1 in double precision; null for those that are null or empty, have components that are null or not finite, or are zero."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = np.array([np.nan if y is None else y for y in v] if v is not None and getattr(v, "dtype", None) == object else [] if v is None else v, np.float64)
        top = np.abs(x).max() if len(x) else 0.0
        if not np.isfinite(top) or top == 0 or np.isnan(x).any():
            out.append(None)
        else:
            x = x / top  # squares of neither very large nor very small numbers
            out.append(x / np.sqrt((x * x).sum()))
    return pd.Series(out, dtype=object)


def top_centres(x: np.ndarray, wanted: int, threshold: float) -> np.ndarray:
    """The centres of the highest level of a cover tree of ``x`` that has as many as wanted, or of its lowest level."""
    groups = [np.arange(len(x))]
    for r in _radii(threshold):
        if len(groups) >= wanted:
            break
        groups = [kid for g in groups for kid in _cover(x, g, r)]
    return x[[g[0] for g in groups if len(g)]]


def _tops(reps: DataFrame, sizes: DataFrame, threshold: float, block: int) -> dict[tuple[str, int], np.ndarray]:
    """(label, dim) -> centres, of the largest labels of over ``block`` vectors. Bounded by MAX_CENTRES and MAX_NUMBERS, whatever the table has."""
    big = sizes.where(F.col("n") > block).orderBy(F.desc("n"), "label", "dim").limit(MAX_CENTRES // 2).collect()
    wanted, left = {}, (MAX_CENTRES, MAX_NUMBERS)
    for r in big:
        k = min(2 * -(-r["n"] // block), MAX_CENTRES // max(2, len(big)) + 1, left[0], left[1] // (SAMPLE * r["dim"]))
        if k < 2:
            continue
        wanted[r["label"], r["dim"]] = k, min(1.0, SAMPLE * k / r["n"])
        left = left[0] - k, left[1] - SAMPLE * k * r["dim"]
    if not wanted:
        return {}
    rates = reps.sparkSession.createDataFrame([(*key, int(rate * (1 << 31))) for key, (_, rate) in wanted.items()], "label string, dim int, below long")
    some = reps.join(F.broadcast(rates), ["label", "dim"]).where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 31)) < F.col("below"))
    found: dict[tuple[str, int], list] = {key: [] for key in wanted}
    for r in some.select("label", "dim", "id", "v").collect():  # about SAMPLE vectors a centre
        found[r["label"], r["dim"]].append((r["id"], r["v"]))
    return {key: top_centres(np.array([v for _, v in sorted(x)]), wanted[key][0], threshold) for key, x in found.items() if len(x) > 1}


def near_cells(centres: np.ndarray, radii: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of cells, each with itself and in both orders, of which vectors may be linked."""
    near = _distance(centres, centres) <= radii[:, None] + radii[None, :] + _reach(threshold) + SLACK
    np.fill_diagonal(near, True)
    return np.nonzero(near)


def _nearest(tops):
    """A function of (label, v): the nearest centre of the label and its distance; -1 for labels without centres."""

    @F.pandas_udf("cell int, distance double")
    def nearest(label: pd.Series, v: pd.Series) -> pd.DataFrame:
        cell, distance = np.full(len(v), -1, np.int32), np.zeros(len(v))
        dims = v.map(len)
        for key, centres in tops.value.items():
            rows = np.flatnonzero((label == key[0]).to_numpy() & (dims == key[1]).to_numpy())
            for i in range(0, len(rows), 1024):
                part = rows[i : i + 1024]
                away = _distance(np.stack(v.to_numpy()[part]), centres)
                cell[part], distance[part] = away.argmin(axis=1), away.min(axis=1)
        return pd.DataFrame({"cell": cell, "distance": distance})

    return nearest


def _dealt(reps: DataFrame, threshold: float, block: int) -> DataFrame:
    """A row for each task that a vector takes part in: label, dim, part p of cell i with part q of cell j, side (see ``_links_of_blocks``), id, copies, v."""
    spark = reps.sparkSession
    d = reps.select(F.col("label").cast("string").alias("label"), F.size("v").alias("dim"), "id", "copies", "v")
    sizes = d.groupBy("label", "dim").agg(F.count("*").alias("n"))
    tops = _tops(d, sizes, threshold, block)
    while True:
        if not tops:
            cells = d.withColumn("cell", F.lit(-1))
            break
        nearest = _nearest(spark.sparkContext.broadcast(tops))
        cells = materialize(d.withColumn("c", nearest("label", "v")).select("*", "c.cell", "c.distance").drop("c"))
        stats = cells.where("cell >= 0").groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # a row for each centre
        by_label: dict[tuple[str, int], list] = {}
        for r in sorted(stats, key=lambda r: r["cell"]):
            by_label.setdefault((r["label"], r["dim"]), []).append(r)
        listed, kept = [], {}
        for key, rs in by_label.items():
            own, n = np.array([r["cell"] for r in rs]), np.array([r["n"] for r in rs])
            i, j = near_cells(tops[key][own], np.array([r["radius"] for r in rs]), threshold)
            parts = -(-n // block)
            # where hardly any pair is pruned, cells would only make more tasks; then any parts of a label do, all with all
            if len(i) <= MAX_PAIRS // len(by_label) and (n[i] * parts[j]).sum() < n.sum() * -(-n.sum() // block):
                kept[key] = tops[key]
                listed += [(*key, *x) for x in zip(own[i].tolist(), parts[i].tolist(), own[j].tolist(), parts[j].tolist(), strict=True)]
        if len(kept) == len(tops):
            break
        tops = kept
        discard(cells)
    schema = "label string, dim int, cell int, parts int, other int, other_parts int"
    parts = F.ceil(F.col("n") / block).cast("int")
    near = sizes.select("label", "dim", F.lit(-1).alias("cell"), parts.alias("parts"), F.lit(-1).alias("other"), parts.alias("other_parts"))
    if tops:
        near = near.unionByName(spark.createDataFrame(listed, schema))
    rows = cells.join(near, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    own, other = F.struct(F.col("cell").alias("c"), F.col("part").alias("p")), F.struct(F.col("other").alias("c"), F.col("other_part").alias("p"))
    side = F.when(own == other, 0).when(own < other, 1).otherwise(2)
    lo, hi = F.least(own, other), F.greatest(own, other)
    return rows.select("label", "dim", lo["c"].alias("i"), lo["p"].alias("p"), hi["c"].alias("j"), hi["p"].alias("q"), side.alias("side"), "id", "copies", "v")


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per distinct id: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and they have the same number of components. Those without a
    direction (see ``unit``) link with nothing. Equal vectors are compared once and count as linked. Rows with a null id are left
    out; of rows that repeat an id one counts (that of the smallest vector). Other columns are ignored.
    """
    d = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.struct(F.col(vector_col).alias("v"), F.col(label_col).alias("label"))).alias("x"))
    d = materialize(d.select("id", F.col("x.label").alias("label"), F.pandas_udf(unit, "array<double>")(F.col("x.v")).alias("v")))
    valid = d.where("v is not null and label is not null")
    reps = materialize(valid.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    same = valid.join(reps.select("label", "v", F.col("id").alias("rep"), "copies"), ["label", "v"]).select("id", "rep", "copies")
    dealt = _dealt(reps, threshold, block)

    def linked(df: pd.DataFrame) -> pd.DataFrame:
        x = np.array(df["v"].tolist(), np.float64).reshape(len(df), -1)
        return _links_of_blocks(df["id"].to_numpy(), df["copies"].to_numpy(), x, df["side"].to_numpy(), threshold)

    found = materialize(dealt.groupBy("label", "dim", "i", "p", "j", "q").applyInPandas(linked, "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_rep = counts.join(comp.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("rep"), "n", "component")
    out = d.select("id").join(same, "id", "left").join(per_rep, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias("vec_id"), (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
