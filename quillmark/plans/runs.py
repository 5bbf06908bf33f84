"""The three runs over a source tree: a full bundle, a delta against the last snapshot, a chat bundle."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..operators import changes, chat, checks, filters, imports, patches, regions, slices
from ..operators import symbols as S
from ..sources import bundles, project, state, tree


@dataclass(frozen=True)
class Config:
    source: str
    extensions: tuple[str, ...] = filters.EXTENSIONS
    excludes: tuple[str, ...] = filters.EXCLUDES
    includes: tuple[str, ...] = ()
    max_bytes: int = 25_000_000
    max_file_bytes: int = 2_000_000
    use_ignore_file: bool = True
    chat_max_files: int = chat.MAX_FILES
    chat_max_chars: int = chat.MAX_CHARS
    chat_compat: bool = True
    diff: patches.DiffOptions = patches.DiffOptions()
    bench: str = ""
    cache: str = "tmp/.ccache"
    new: bool = False
    store_blobs: bool = False
    rename_similarity: bool = False
    rename_distance: int = changes.RENAME_DISTANCE
    rename_old_root: str = ""
    emit_sources: bool = False
    max_file_lines: int = slices.MAX_LINES
    languages: tuple[str, ...] = ()
    validate: bool = True
    save_snapshot: bool = True
    auto: regions.AutoConfig = field(default_factory=regions.AutoConfig)

    @property
    def module(self) -> str:
        return os.path.basename(os.path.abspath(self.source))

    @property
    def folder(self) -> str:
        return state.folder(self.cache, self.source)

    def bench_bytes(self) -> bytes | None:
        if not self.bench:
            return None
        with open(self.bench, "rb") as f:
            return f.read()


class InvalidArtifacts(ValueError):
    """What is to be bundled breaks rules; the message lists all of them."""


class Index:
    """All relations of a tree, lazily, over files that are read once."""

    def __init__(self, spark: SparkSession, config: Config, budget: bool = True):
        self.spark, self.config = spark, config
        self.files = tree.scan(spark, config.source, config.extensions, config.excludes, config.includes, config.use_ignore_file, config.max_file_bytes, config.max_bytes if budget else 0).persist()

    @cached_property
    def indexed(self) -> DataFrame:
        """Files of the languages that are asked for; without a choice, all."""
        langs = self.config.languages
        return self.files.where(paths.lang_of(F.col("path")).isin(*langs)) if langs else self.files

    @cached_property
    def symbols(self) -> DataFrame:
        return S.symbols(self.indexed.select("path", "text")).persist()

    @cached_property
    def regions(self) -> DataFrame:
        return regions.all_regions(self.indexed.select("path", "text"), self.config.auto).persist()

    @cached_property
    def slices(self) -> DataFrame:
        return slices.slices(self.indexed.select("path", "lines"), self.regions, self.config.max_file_lines)

    @cached_property
    def pointers(self) -> DataFrame:
        return slices.pointers(self.regions, self.symbols)

    @cached_property
    def manifest(self) -> DataFrame:
        h = S.heads(self.indexed.select("path", "text")).drop("text", "lang", "lines")
        r = self.regions.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("origin", "start", "end", "name"))), lambda x: F.struct(x["name"].alias("name"), x["start"].alias("start"), x["end"].alias("end"))).alias("regions"))
        e = S.exports(self.indexed.select("path", "text"))
        m = self.indexed.select("path", F.col("sha256").alias("hash"), "lines").join(h, "path").join(e, "path", "left").join(r, "path", "left")
        empty = F.array().cast("array<struct<name:string,start:int,end:int>>")
        return m.select("path", "package", "class", "kind", "hash", F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), "lines", F.coalesce("regions", empty).alias("regions")).persist()

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Languages do not narrow the graph. The resolver's file is looked for in the folder that all files share."""
        found = [r.abs_path for r in self.files.select("abs_path").toLocalIterator()]  # of one bundle
        root = os.path.commonpath([os.path.dirname(p) for p in found]) if found else self.config.source
        resolver = None
        try:
            with open(os.path.join(root, "tsconfig.json"), encoding="utf-8") as f:
                resolver = imports.Resolver.from_json(f.read())
        except OSError:
            pass
        listing = None
        if resolver:
            self.spark.dataSource.register(tree.TreeSource)
            listing = self.spark.read.format("quillmark_tree").load(root)
        return imports.graph(self.files.select("path", "text"), listing, resolver)

    def header(self) -> dict:
        out = {"module": self.config.module, "bundle_id": hashing.bundle_id(self.manifest).first()["bundle_id"]}
        return project.merged(out, project.detect(self.config.source))

    def is_empty(self) -> bool:
        return self.files.isEmpty()


def full(spark: SparkSession, config: Config, path: str) -> bool:
    """Writes a full bundle; False if there are no files. Raises InvalidArtifacts before anything is written."""
    x = Index(spark, config)
    if x.is_empty():
        return False
    header = x.header()
    if config.validate:
        found = checks.manifest_violations(x.manifest, header["module"]).unionByName(checks.symbol_violations(x.symbols))
        if text := checks.report(found):
            raise InvalidArtifacts(text)
    nodes, edges = x.graph
    sources = x.files.join(x.manifest.select("path"), "path", "left_semi") if config.emit_sources else None
    bundles.write_full(path, header, x.manifest, x.symbols, x.slices, x.pointers, nodes, edges, sources, config.bench_bytes())
    if config.save_snapshot:
        state.save_snapshot(config.folder, x.manifest.select("path", "hash", "lines"), header["module"], os.path.abspath(config.source))
    return True


def delta(spark: SparkSession, config: Config, path: str) -> dict | None:
    """Writes what changed since the last snapshot, then keeps the new one; None if there are no files. There is no byte budget here."""
    x = Index(spark, config, budget=False)
    if x.is_empty():
        return None
    if config.new:
        state.clear(config.folder)
    blobs = os.path.join(config.folder, "blobs")
    curr = x.files.select("path", F.col("sha256").alias("hash"), "lines")
    last = state.load_snapshot(spark, config.folder)
    prev, header = last if last else (spark.createDataFrame([], state.SNAPSHOT), {})
    old = state.load_blobs(spark, blobs)
    c = changes.classify(prev, curr)
    removed, added = changes.sides(c)
    renames = changes.exact_renames(removed, added)
    removed, added = changes.without_renamed(removed, added, renames)
    if config.rename_similarity and config.rename_old_root:
        before = tree.with_content(removed.withColumn("abs_path", F.concat(F.lit(config.rename_old_root.rstrip("/") + "/"), "path")))
        gone = hashing.simhash(before.select("path", "text"), "path", "text").withColumnRenamed("id", "path")
        came = hashing.simhash(x.files.join(added.select("path"), "path", "left_semi"), "path", "text").withColumnRenamed("id", "path")
        near = changes.greedy_similar(removed, added, gone, came, config.rename_distance)
        near = near.join(added.select(F.col("path").alias("to_path"), "hash"), "to_path").select("from_path", "to_path", "hash")
        renames = renames.unionByName(near)
        removed, added = changes.without_renamed(removed, added, renames)
    none = F.lit(None).cast("string")
    rows = added.select(F.lit("added").alias("op"), "path", none.alias("from_path"), none.alias("hash_before"), F.col("hash").alias("hash_after"), "lines")
    rows = rows.unionByName(removed.select(F.lit("removed").alias("op"), "path", none.alias("from_path"), F.col("hash").alias("hash_before"), none.alias("hash_after"), "lines"))
    rows = rows.unionByName(c.where("op = 'changed'").select("op", "path", none.alias("from_path"), "hash_before", "hash_after", F.col("lines_after").alias("lines")))
    rows = rows.unionByName(renames.select(F.lit("renamed").alias("op"), F.col("to_path").alias("path"), "from_path", F.col("hash").alias("hash_before"), F.col("hash").alias("hash_after"), F.lit(None).cast("int").alias("lines"))).persist()
    text = old.select("hash", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    inputs = patches.patch_inputs(rows.where("op = 'changed'"), text, x.files.select("path", "text"))
    fresh = x.files.join(rows.where("op = 'added'").select("path"), "path", "left_semi")
    top = {"baseModule": header.get("module", config.module), "baseSnapshot": header.get("created", ""), "headSnapshot": ""}
    index = bundles.write_delta(path, top, rows, inputs, fresh, config.diff, config.bench_bytes())
    if config.store_blobs:
        state.save_blobs(blobs, x.files.select(F.col("sha256").alias("hash"), "content"))
    state.save_snapshot(config.folder, curr, config.module, os.path.abspath(config.source))
    return index


def chat_bundle(spark: SparkSession, config: Config, path: str) -> bool:
    """Writes the files of a tree as chat messages, ranked; False if there are none."""
    x = Index(spark, config)
    if x.is_empty():
        return False
    ranks = chat.ranked(x.manifest, x.graph[1]).join(x.files.select("path", "text"), "path")
    messages = chat.one_per_message(ranks, config.chat_max_chars)
    if not config.chat_compat:
        fit = chat.next_fit(ranks.select("rank", "path", F.octet_length("text").cast("long").alias("size")), config.chat_max_files, config.chat_max_chars)
        bodies = messages.drop("message").join(fit, "path").groupBy("message").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "body"))).alias("x"))
        body = F.concat(F.aggregate(F.transform("x", lambda y: F.concat(y["body"], F.lit(b"```\n"))), F.lit(b""), lambda a, b: F.concat(a, b)))
        messages = bodies.select("message", F.array_join(F.transform("x", lambda y: y["path"]), ", ").alias("path"), body.alias("body"))
    bundles.write_chat(path, config.module, messages, x.manifest, config.bench_bytes(), x.symbols.count(), chat.limits(config.chat_max_files, config.chat_max_chars))
    return True
