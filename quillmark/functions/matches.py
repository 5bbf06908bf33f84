"""All matches of a pattern with their lines, in column expressions.

Patterns are Java's, to be written with UNIX_LINES and explicit white space; each rule also has its form for RE2, of which
the tests and oracles make use. Line of a match: 1 and the line feeds before it. Texts around matches come from ``split``,
the matches from ``regexp_extract_all``, and sums of their line feeds give the lines, so no Python is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that RE2 knows as \\s; Java's has a vertical tab more.
WS = r"[\t\n\f\r ]"
MULTI = "(?dm)"


def feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    return (F.lit(1) + feeds(text)).cast("int")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<i, start, end, offset, name, whole>> of all matches, in order; start and end are lines, offset is in characters."""
    gaps, whole, names = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("m"), names.alias("n"))
    empty = F.array().cast("array<struct<i:int,start:int,end:int,offset:int,name:string,whole:string>>")
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        line, at = (acc["line"] + feeds(x["g"])).cast("int"), (acc["at"] + F.length(x["g"])).cast("int")
        end = (line + feeds(x["m"])).cast("int")
        row = F.struct(F.size(acc["out"]).alias("i"), line.alias("start"), end.alias("end"), at.alias("offset"), x["n"].alias("name"), x["m"].alias("whole"))
        return F.struct(end.alias("line"), (at + F.length(x["m"])).cast("int").alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    # texts without a match, which are most for most patterns, are not split
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(empty)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Empty if there is no match."""
    return F.regexp_extract(text, pattern, group)


def matches_sql(text: str, pattern: str, group: int = 0, alias: str = "m") -> str:
    """The same for DuckDB: an expression that gives a list of structs (i, start, end, name, whole)."""
    p = "'" + pattern.replace("'", "''") + "'"
    nl = "(length({0}) - length(replace({0}, chr(10), '')))"
    g, m, n = f"string_split_regex({text}, {p})", f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {group})"
    sums = f"list_transform(range(1, len({m}) + 1), lambda i: struct_pack(i := i - 1, start := 1 + list_sum(list_transform({g}[1:i], lambda s: {nl.format('s')})) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda s: {nl.format('s')})), 0), \"end\" := 1 + list_sum(list_transform({g}[1:i], lambda s: {nl.format('s')})) + list_sum(list_transform({m}[1:i], lambda s: {nl.format('s')})), name := {n}[i], whole := {m}[i]))"
    return sums
