"""Unified patches of changed and added files, and names for them."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


@dataclass(frozen=True)
class DiffOptions:
    max_bytes: int = 2_000_000
    context: int = 4
    no_prefix: bool = True


def keep_feeds(text: str) -> list[str]:
    """Lines with their feeds; a text that ends in one has an empty line more, an empty text has none."""
    if not text:
        return []
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + [parts[-1]]


def omitted(before: str, after: str) -> str:
    """Stands for a patch that is left out; a fixed format, which patch readers take."""
    return f"--- {before}\n+++ {after}\n@@\n# diff omitted (oversize)\n"


def added(new: str | None, path: str, options: DiffOptions) -> tuple[str, bool]:
    """(patch, oversize) of a new file. An empty one has no lines to show and gets the placeholder, but is not oversize."""
    new = new or ""
    if 0 < options.max_bytes < len(new.encode()):
        return omitted("/dev/null", path if options.no_prefix else "b/" + path), True
    text = "".join(difflib.unified_diff([], keep_feeds(new), "/dev/null", path, n=lines_around(options)))
    return text or omitted("/dev/null", path), False


def lines_around(options: DiffOptions) -> int:
    return options.context if options.context > 0 else DiffOptions.context


def unified(old: str | None, new: str | None, path: str, options: DiffOptions) -> tuple[str, bool]:
    """(patch, oversize). Without an old text, or when the patch has no hunk to speak of, the file counts as added."""
    old, new = old or "", new or ""
    if not old:
        return added(new, path, options)
    a, b = (path, path) if options.no_prefix else ("a/" + path, "b/" + path)
    if 0 < options.max_bytes < len(old.encode()) + len(new.encode()):
        return omitted(a, b), True
    text = "".join(difflib.unified_diff(keep_feeds(old), keep_feeds(new), a, b, n=lines_around(options))) or omitted(a, b)
    return (text, False) if len(text.encode()) >= 32 and "@@" in text else added(new, path, options)


def make_patches(rows: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """(path, patch, oversize) of rows (path, old, new); Arrow batches, a file at a time, as the algorithm is sequential in a file."""

    @F.pandas_udf("patch string, oversize boolean")
    def patched(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
        out = [unified(o, n, p, options) for p, o, n in zip(path, old, new, strict=True)]
        return pd.DataFrame({"patch": [x[0] for x in out], "oversize": [x[1] for x in out]})

    return rows.withColumn("_p", patched("path", "old", "new")).select("path", "_p.patch", "_p.oversize")


def make_added_patches(rows: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """(path, patch, oversize) of new files (path, text)."""

    @F.pandas_udf("patch string, oversize boolean")
    def patched(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = [added(t, p, options) for p, t in zip(path, text, strict=True)]
        return pd.DataFrame({"patch": [x[0] for x in out], "oversize": [x[1] for x in out]})

    return rows.withColumn("_p", patched("path", "text")).select("path", "_p.patch", "_p.oversize")


def patch_inputs(changed: DataFrame, blobs: DataFrame, current: DataFrame) -> DataFrame:
    """(path, old, new): changed (path, hash_before) with old texts by hash from blobs (hash, text), new ones by path from current (path, text)."""
    old = blobs.select(F.col("hash").alias("hash_before"), F.col("text").alias("old"))
    new = current.select("path", F.col("text").alias("new"))
    return changed.select("path", "hash_before").join(old, "hash_before", "left").join(new, "path", "left").select("path", "old", "new")


def patch_names(rows: DataFrame, hash_col: str = "hash") -> DataFrame:
    """(path, name): the flat base of a path; if a smaller path has it, with the first 8 of the hash (of the path's hash where there is none); if that is
    taken too, also with the short hash of base and suffix. From the third of equal base and suffix on names repeat; archives tell them apart."""
    base = paths.patch_base(F.col("path"))
    r = rows.select("path", base.alias("base"), F.coalesce(F.nullif(F.left(F.col(hash_col), F.lit(8)), F.lit("")), paths.short_hash(F.col("path"))).alias("h"))
    r = r.withColumn("i", F.row_number().over(Window.partitionBy("base").orderBy("path")))
    r = r.withColumn("j", F.row_number().over(Window.partitionBy("base", "h", F.col("i") > 1).orderBy("path")))
    first = F.concat_ws("", "base", F.lit("-"), "h")
    name = F.when(F.col("i") == 1, F.col("base")).when(F.col("j") == 1, first).otherwise(F.concat(first, F.lit("-"), paths.short_hash(F.concat("base", "h"))))
    return r.select("path", F.concat(name, F.lit(".patch")).alias("name"))


def entry_names(rows: DataFrame, name_col: str = "name", order_col: str = "ord") -> DataFrame:
    """``rows`` with ``entry``: a safe archive name; the second of a name gets -1 before its extension, and so on."""
    r = rows.withColumn("_safe", paths.safe_entry(F.col(name_col)))
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy("_safe").orderBy(order_col)) - 1)
    ext = F.regexp_extract("_safe", r"(\.[^./]*)$", 1)
    stem = F.substr(F.col("_safe"), F.lit(1), F.length("_safe") - F.length(ext))
    return r.withColumn("entry", F.when(F.col("_k") == 0, F.col("_safe")).otherwise(F.concat(stem, F.lit("-"), F.col("_k"), ext))).drop("_safe", "_k")
