"""Text forms of artifacts: JSON lines, tables of contents, and line ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered

_ESCAPES = {"&": "\\u0026", "<": "\\u003c", ">": "\\u003e", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def escaped(json: Column) -> Column:
    """Characters that are markup in HTML, and two line separators, as escapes."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _ESCAPES.items(), json)


def json_lines(rows: DataFrame, columns: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """(line): one object for each row; optional columns are left out where they are empty."""
    cols = [F.nullif(F.col(c), F.lit("")).alias(c) if c in optional else F.col(c) for c in columns]
    return rows.select(escaped(F.to_json(F.struct(*cols))).alias("line"))


def toc_rows(files: DataFrame) -> DataFrame:
    """(k, row) in the order of paths."""
    t = numbered(files.select("path", "lines"), [F.col("path")])
    return t.select("k", F.concat(F.lit("| "), "k", F.lit(" | "), "path", F.lit(" | "), "lines", F.lit(" |")).alias("row"))


def one_feed(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def fed(text: Column) -> Column:
    """With a line feed at the end; an empty text stays empty."""
    return F.when((text != "") & ~text.endswith("\n"), F.concat(text, F.lit("\n"))).otherwise(text)


def pieces(text: Column) -> Column:
    """Lines with their feeds; after a last feed comes an empty one. An empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "(?<=\n)", -1))


def joined(chunks: list[str]) -> str:
    """Chunks with a line feed between them where there is none."""
    return "".join(c if i == len(chunks) - 1 or c.endswith("\n") or not c else c + "\n" for i, c in enumerate(chunks))
