"""Ranking of files for a chat, and packing into messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .ranks import numbered

MAX_FILES, MAX_CHARS = 10, 80_000


def ranked(manifest: DataFrame, edges: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """``manifest`` (path, exports, ...) with degree and rank: most edges first, then files with exports, then no tests, then by path.

    A script's node is its path without extension; other files have degree 0.
    """
    from .imports import degrees

    d = degree if degree is not None else degrees(edges)
    m = with_degree(manifest, d)
    order = [F.desc("degree"), (F.size("exports") > 0).desc(), paths.is_test_path(F.col("path")), F.col("path")]
    return numbered(m, order, "rank")


def with_degree(manifest: DataFrame, degree: DataFrame) -> DataFrame:
    """Files that are no scripts have keys of their own, which no node has: without a key they would all go to one task."""
    node = F.concat(F.lit("js:"), paths.without_extension(F.col("path")))
    m = manifest.withColumn("_id", F.when(paths.lang_of(F.col("path")) == "ts", node).otherwise(F.concat(F.lit("file:"), F.col("path"))))
    nodes = degree.where(F.startswith(F.col("id"), F.lit("js:"))).withColumnRenamed("id", "_id")
    return m.join(nodes, "_id", "left").drop("_id").withColumn("degree", F.coalesce("degree", F.lit(0)))


def header(path: Column, package: Column, typ: Column, exports: Column) -> Column:
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    owner = F.when((package != "") | (typ != ""), F.concat(F.lit("- Package: "), dash(package), F.lit("\n- Class: "), dash(typ), F.lit("\n"))).otherwise("")
    listed = F.when(F.size(exports) > 0, F.concat(F.lit("- Exports: "), F.array_join(exports, ", "), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("# "), path, F.lit("\n"), owner, listed, F.lit("\n"))


def limits(max_files: int, max_chars: int) -> tuple[int, int]:
    return max_files if max_files > 0 else MAX_FILES, max_chars if max_chars > 0 else MAX_CHARS


def head_and_fence() -> Column:
    return F.concat(header(F.col("path"), F.col("package"), F.col("class"), F.col("exports")), F.lit("```"), paths.fence_of(F.col("path")), F.lit("\n"))


def body(max_chars: int = MAX_CHARS) -> Column:
    """Header, fence and text, cut to the budget, in bytes; a line feed follows unless header and fence alone fill it."""
    _, budget = limits(0, max_chars)
    head = head_and_fence()
    cut = F.substring(F.concat(head, F.col("text")).cast("binary"), 1, budget)
    return F.when(F.octet_length(head) < budget, F.concat(cut, F.lit(b"\n"))).otherwise(cut)


def one_per_message(ranks: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(message, path, body): as the counter runs full after each file, a message is one file."""
    return ranks.select(F.col("rank").alias("message"), "path", body(max_chars).alias("body"))


def next_fit(items: DataFrame, max_files: int = MAX_FILES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(rank, path, message): items (rank, path, size) go to the current message while it has room, else to a new one.

    Next fit depends on all that came before, so this is one ordered pass, of numbers only, over a bundle.
    """
    most, budget = limits(max_files, max_chars)

    def packed(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank")
        out, message, n, size = [], 1, 0, 0
        for s in df["size"]:
            if n and (n == most or size + s > budget):
                message, n, size = message + 1, 0, 0
            n, size = n + 1, size + s
            out.append(message)
        return df.assign(message=out)[["rank", "path", "message"]]

    return items.select("rank", "path", "size").groupBy(F.lit("all")).applyInPandas(packed, "rank long, path string, message int")


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """Of (path, size) those that a walk takes: a file that would overflow is left out, later ones may still fit; at the budget it ends.

    The walk's order is by segments. One ordered pass over sizes, like ``next_fit``; 0 is no limit.
    """
    if budget <= 0:
        return items

    def taken(df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(_k=df["path"].str.split("/")).sort_values("_k")
        keep, total = [], 0
        for s in df["size"]:
            fits = total < budget and total + s <= budget
            keep.append(fits)
            total += s if fits else 0
        return df[keep][["path", "size"]]

    return items.select("path", "size").groupBy(F.lit("all")).applyInPandas(taken, "path string, size long")
