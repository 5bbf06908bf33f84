"""The import graph: nodes and edges of packages and modules, resolution of bare specifiers, degrees."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.matches import WS
from .symbols import PACKAGE, _both

JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;"
GO_SINGLE = r"""^\s*import\s+(?:[A-Za-z_][A-Za-z0-9_]*\s+)?"([^"]+)\""""
GO_BLOCK = r"import\s*\(\s*([^)]*?)\s*\)"
GO_LINE = r"""^\s*(?:[A-Za-z_][A-Za-z0-9_]*\s+)?"([^"]+)\""""
JS = [r"""^\s*import\s+[^;]*?\s+from\s+['"]([^'"]+)['"]""", r"""^\s*import\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)""", r"""^\s*export\s*\{[^}]*\}\s*from\s*['"]([^'"]+)['"]"""]
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


@dataclass(frozen=True)
class Resolver:
    """What bare script specifiers may stand for: ``paths`` in sorted order, first target each, then ``base_url``."""

    base_url: str = ""
    paths: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_json(cls, text: str) -> Resolver | None:
        """None if the text is not strict JSON."""
        try:
            o = (json.loads(text) or {}).get("compilerOptions") or {}
            targets = sorted((o.get("paths") or {}).items())
        except (ValueError, AttributeError):
            return None
        return cls(o.get("baseUrl") or "", tuple((k, v[0]) for k, v in targets if v and v[0]))


def all_groups(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(_both(pattern)), F.lit(1))


def specifiers(files: DataFrame) -> DataFrame:
    """(path, node, spec, kind) of Java, Go and .ts/.tsx/.js files (path, text): what a file's node imports; spec is null if it imports nothing."""
    ext = paths.extension(F.col("path"))
    t, p = F.col("text"), F.col("path")
    node = lambda tag, value: F.concat(F.lit(f"{tag}:"), value)
    java = files.where(ext == ".java").select("path", node("java", F.coalesce(F.nullif(F.regexp_extract(t, _both(PACKAGE["java"]), 1), F.lit("")), paths.java_package(p))).alias("node"), all_groups(t, JAVA_IMPORT).alias("specs"), F.lit("java").alias("kind"))
    inner = F.flatten(F.transform(F.regexp_extract_all(t, F.lit("(?d)" + GO_BLOCK.replace(r"\s", WS)), F.lit(1)), lambda x: all_groups(x, GO_LINE)))
    go = files.where(ext == ".go").select("path", node("go", F.coalesce(F.nullif(F.regexp_extract(t, _both(PACKAGE["go"]), 1), F.lit("")), paths.go_package(p))).alias("node"), F.concat(all_groups(t, GO_SINGLE), inner).alias("specs"), F.lit("go").alias("kind"))
    js = files.where(ext.isin(".ts", ".tsx", ".js")).select("path", node("js", paths.without_extension(p)).alias("node"), F.concat(*[all_groups(t, x) for x in JS]).alias("specs"), F.lit("js").alias("kind"))
    u = reduce(DataFrame.unionByName, [java, go, js])
    return u.select("path", "node", "kind", F.explode_outer(F.array_distinct("specs")).alias("spec"))


def resolved(specs: DataFrame, listing: DataFrame, resolver: Resolver | None) -> DataFrame:
    """``specs`` with ``target``: the node that a specifier stands for. ``listing`` has the path of every file, scanned or not."""
    relative = F.col("spec").startswith(".")
    known = specs.withColumn("target", F.when(F.col("kind") != "js", F.concat("kind", F.lit(":"), "spec")).when(relative, paths.relative_spec(F.col("path"), F.col("spec"))))
    if resolver is None:
        return known.withColumn("target", F.coalesce("target", F.concat(F.lit("npm:"), "spec")))
    found = bare_targets(known.where("kind = 'js' and target is null and spec is not null").select("spec").distinct(), listing, resolver)
    j = known.join(found.withColumnRenamed("file", "_file"), "spec", "left")
    return j.withColumn("target", F.coalesce("target", F.concat(F.lit("js:"), paths.without_extension(F.col("_file"))), F.concat(F.lit("npm:"), "spec"))).drop("_file")


def bare_targets(specs: DataFrame, listing: DataFrame, resolver: Resolver) -> DataFrame:
    """(spec, file) of bare specifiers that name a file. Candidates are exploded with their priority and joined with the listing."""
    spec = F.col("spec")
    bases = []
    for key, target in resolver.paths:
        target = target.removeprefix("/")
        if "*" not in key:
            bases.append(F.when(spec == key, F.lit(target)))
            continue
        pre, suf = key.split("*", 1)
        mid = F.substr(spec, F.lit(len(pre) + 1), F.greatest(F.length(spec) - len(pre) - len(suf), F.lit(0)))
        fits = spec.startswith(pre) & spec.endswith(suf) & (F.length(spec) >= len(pre) + len(suf))
        bases.append(F.when(fits, F.replace(F.lit(target), F.lit("*"), mid)))
    if resolver.base_url:
        bases.append(F.concat_ws("/", F.lit(resolver.base_url.strip("/")), spec))
    if not bases:
        return specs.select("spec", F.lit(None).cast("string").alias("file")).where(F.lit(False))
    b = specs.select("spec", F.posexplode(F.array(*bases)).alias("rank", "base")).where("base is not null")
    clean = F.array_join(paths.folded(F.col("base"), True), "/")
    b = b.select("spec", "rank", clean.alias("base")).where("base <> ''")
    literal = F.when(F.col("base").rlike(r"\.[^./]*$"), F.col("base"))
    c = F.array(literal, *[F.concat("base", F.lit(s)) for s in SUFFIXES], *[F.concat("base", F.lit("/index" + s)) for s in SUFFIXES])
    c = b.select("spec", "rank", F.posexplode(c).alias("place", "file")).where("file is not null")
    return c.join(listing.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy("spec").agg(F.min_by("file", F.struct("rank", "place")).alias("file"))


def graph(files: DataFrame, listing: DataFrame | None = None, resolver: Resolver | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst), each once, without loops."""
    s = resolved(specifiers(files), files if listing is None else listing, resolver)
    named = s.where("spec is not null").select(F.col("node").alias("src"), F.col("target").alias("dst")).distinct()
    nodes = s.select(F.col("node").alias("id")).unionByName(named.select(F.col("dst").alias("id"))).where("id <> ''").distinct()
    return nodes, named.where("src <> dst and src <> '' and dst <> ''")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


