"""Line slices of files, and stable pointers to regions and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .ranks import numbered_within

MAX_LINES = 500


def slices(files: DataFrame, regions: DataFrame | None = None, max_lines: int = MAX_LINES) -> DataFrame:
    """(path, slice, start, end) of files (path, lines): one for each distinct region of a file that has regions (path, name,
    start, end); of other files chunks of ``max_lines`` if they are longer than that. Without a limit that is one chunk."""
    row = lambda name, a, b: F.struct(name.alias("slice"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    if max_lines > 0:
        starts = F.when(F.col("lines") > max_lines, F.sequence(F.lit(1), F.col("lines"), F.lit(max_lines)))
    else:
        starts = F.array(F.lit(1))
    end = lambda x: F.least(x + max_lines - 1, F.col("lines")) if max_lines > 0 else F.col("lines")
    chunks = F.transform(starts, lambda x: row(F.concat(F.lit("chunk_"), x), x, end(x)))
    if regions is None:
        return files.select("path", F.inline(chunks))
    # files are read once: each with its regions, or without any
    j = files.select("path", "lines").join(regions.select("path", "name", "start", "end", F.lit(True).alias("_named")), "path", "left")
    first = F.greatest("start", F.lit(1))
    named = F.array(row(F.col("name"), first, F.least(F.greatest("end", first), F.col("lines"))))
    return j.select("path", F.inline(F.when(F.col("_named"), named).otherwise(chunks))).distinct()


def region_pointers(regions: DataFrame) -> DataFrame:
    """(id, path, start, end): path and slug, the k-th of a slug in a file with -k."""
    slug = paths.slug(F.col("name"))
    r = regions.select("path", "name", "start", "end", slug.alias("slug"))
    k = F.row_number().over(Window.partitionBy("path", "slug").orderBy("start", "end", "name"))
    r = r.withColumn("k", k)
    tail = F.when(F.col("k") > 1, F.concat(F.lit("-"), "k")).otherwise("")
    return r.select(F.concat(F.replace("path", F.lit("/"), F.lit("-")), F.lit("#"), "slug", tail).alias("id"), "path", "start", "end")


def symbol_pointers(symbols: DataFrame) -> DataFrame:
    """(id, path, sym, start, end): the symbol with dashes, the k-th of a bundle with -k.

    Numbers come from one sort, so names as common as ``main`` are spread. A symbol and its number give one id, so no row is there twice.
    """
    base = F.replace("symbol", F.lit("."), F.lit("-"))
    s = symbols.select("symbol", "path", "start", "end", base.alias("base"))
    s = numbered_within(s, "base", [F.col(c) for c in ("symbol", "path", "start", "end")])
    tail = F.when(F.col("k") > 1, F.concat(F.lit("-"), "k")).otherwise("")
    return s.select(F.concat("base", tail).alias("id"), "path", F.col("symbol").alias("sym"), "start", "end")


def pointers(regions: DataFrame, symbols: DataFrame) -> DataFrame:
    return region_pointers(regions).withColumn("sym", F.lit("")).unionByName(symbol_pointers(symbols))
