"""Rules that artifacts must meet, as one relation of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def _bad_path(p: Column) -> list[tuple[str, Column]]:
    return [
        ("path is empty", F.coalesce(p, F.lit("")) == ""),
        ("path is absolute", p.startswith("/")),
        ("path has a backslash", p.contains("\\")),
        ("path climbs", paths.climbs(p)),
    ]


def _violations(rows: DataFrame, scope: str, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules]), lambda x: x.isNotNull())
    return rows.select(F.lit(scope).alias("scope"), key.alias("path"), F.explode(found).alias("rule"))


def manifest_violations(manifest: DataFrame, module: str = "module") -> DataFrame:
    """(scope, path, rule) of manifest rows (path, hash, lines, regions: array of (name, start, end))."""
    p = F.col("path")
    files = _violations(manifest, "file", p, [*_bad_path(p), ("hash is not 64 lower hex digits", (F.coalesce("hash", F.lit("")) != "") & ~F.col("hash").rlike("^[0-9a-f]{64}$")), ("lines below 1", F.col("lines") < 1)])
    twice = manifest.groupBy("path").count().where("count > 1").select(F.lit("file").alias("scope"), "path", F.lit("path comes twice").alias("rule"))
    r = manifest.select("path", "lines", F.explode("regions").alias("r"))
    bad = (F.col("r.start") < 1) | (F.col("r.end") < F.col("r.start")) | (F.col("r.end") > F.col("lines"))
    regions = _violations(r, "region", F.col("path"), [("region has no name", F.trim("r.name") == ""), ("region is out of range", bad)])
    parts = [files, twice, regions]
    if not module.strip():
        parts.append(manifest.sparkSession.createDataFrame([("manifest", "", "module is blank")], "scope string, path string, rule string"))
    return reduce(DataFrame.unionByName, parts)


def symbol_violations(symbols: DataFrame, version: int = 1) -> DataFrame:
    """(scope, path, rule) of symbols (symbol, path, start, end)."""
    p = F.col("path")
    out = _violations(symbols, "symbol", p, [*_bad_path(p), ("symbol is blank", F.trim(F.coalesce("symbol", F.lit(""))) == ""), ("range is wrong", (F.col("start") < 1) | (F.col("end") < F.col("start")))])
    if version < 1:
        out = out.unionByName(symbols.sparkSession.createDataFrame([("symbols", "", "version below 1")], "scope string, path string, rule string"))
    return out


def out_of_order(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Rows whose keys are smaller than those before them, where ``order`` numbers the rows from 0 without gaps: a self-join by number."""
    now = rows.select(F.col(order).alias("_n"), F.struct(*keys).alias("_k"), *rows.columns)
    before = rows.select((F.col(order) + 1).alias("_n"), F.struct(*keys).alias("_b"))
    return now.join(before, "_n").where(F.col("_k") < F.col("_b")).select(*rows.columns)


def report(violations: DataFrame) -> str:
    """All messages, sorted, one a line; empty if all is well. For people, so on the driver."""
    return "\n".join(f"{r.scope} {r.path}: {r.rule}" for r in violations.distinct().orderBy("scope", "path", "rule").toLocalIterator())
