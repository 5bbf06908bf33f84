"""Connected components of a link table by contraction; nothing of it comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that has a link; component is the smallest node that can be reached.

    Each round maps every node to its smallest neighbour, or itself, follows that map twice more, and contracts the links by it.
    A component's smallest node maps to itself, so it is what a component comes to. Minima are aggregated before the
    shuffle, so a node of any degree will do. Rows with a null end, and links of a node with itself, are ignored.
    """
    e = materialize(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        near = e.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("to")))
        step = materialize(near.groupBy("node").agg(F.min("to").alias("to")))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            step = step.join(hop, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        step = materialize(step)
        m = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        n = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        after = materialize(e.join(m, "a").join(n, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            new = step.select("node", F.col("to").alias("component"))
        else:
            new = labels.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = materialize(new)
        for old in (e, labels):
            if old is not None:
                discard(old)
        e, labels = after, new
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels
