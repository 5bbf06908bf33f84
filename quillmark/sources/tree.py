"""File trees as a Spark data source: hidden names count, excluded folders are not entered, and files are hashed where they are read."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.matches import line_count
from ..operators import filters
from ..operators.chat import within_budget

LISTING = "path string, abs_path string, size long"


def list_tree(root: str, prefixes: tuple[str, ...] = ()) -> Iterator[tuple[str, str, int]]:
    """(path, abs_path, size) of regular files, folder by folder in order of names. Links are not followed; what cannot be read is passed over."""
    if os.path.islink(root):
        return
    stack = [""]
    while stack:
        rel = stack.pop()
        folders = []
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: os.fsencode(e.name))
        except OSError:
            continue
        for e in entries:
            if any(e.name.startswith(p) for p in prefixes):
                continue
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    folders.append(path)
                elif e.is_file(follow_symlinks=False):
                    yield path, os.path.abspath(e.path), e.stat(follow_symlinks=False).st_size
            except OSError:
                continue
        stack += reversed(folders)


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]):
        super().__init__(0)
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.prefixes = tuple(x for x in options.get("exclude", "").split(",") if x)
        self.bytes = int(options.get("partitionBytes", 16 << 20))

    def partitions(self) -> list[_Part]:
        out, rows, size = [], [], 0
        for row in list_tree(self.root, self.prefixes):
            rows.append(row)
            size += row[2] + 4096
            if size >= self.bytes:
                out.append(_Part(rows))
                rows, size = [], 0
        return [*out, _Part(rows)] if rows or not out else out

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from partition.rows


class TreeSource(DataSource):
    """``spark.read.format("quillmark_tree").option("exclude", "a,b").load(root)`` gives (path, abs_path, size)."""

    @classmethod
    def name(cls) -> str:
        return "quillmark_tree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def with_content(files: DataFrame) -> DataFrame:
    """``files`` with content, sha256, text (invalid UTF-8 replaced) and lines. Files that cannot be read are left out. Read once, where the row is."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            keep, content, digest = [], [], []
            for i, p in enumerate(batch.column("abs_path").to_pylist()):
                try:
                    with open(p, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                keep.append(i)
                content.append(data)
                digest.append(hashlib.sha256(data).hexdigest())
            yield batch.take(pa.array(keep, pa.int64())).append_column("content", pa.array(content, pa.binary())).append_column("sha256", pa.array(digest, pa.string()))

    schema = StructType(list(files.schema.fields)).add("content", "binary").add("sha256", "string")
    out = files.mapInArrow(read, schema)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return out.withColumn("text", text).withColumn("lines", line_count(F.col("text")))


def read_ignore_file(root: str) -> list[filters.IgnoreRule]:
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return filters.ignore_rules(f.read())
    except OSError:
        return []


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = filters.EXTENSIONS, excludes: tuple[str, ...] = filters.EXCLUDES, includes: tuple[str, ...] = (), use_ignore_file: bool = True, max_file_bytes: int = 2_000_000, max_bytes: int = 25_000_000) -> DataFrame:
    """(path, abs_path, size, content, sha256, text, lines) of the files of a tree that count. Names and sizes are judged before anything is read."""
    spark.dataSource.register(TreeSource)
    files = spark.read.format("quillmark_tree").option("exclude", ",".join(excludes)).load(root)
    rules = read_ignore_file(root) if use_ignore_file else []
    files = filters.kept_files(files, extensions, excludes, includes, rules, max_file_bytes)
    if max_bytes > 0:
        files = files.join(within_budget(files, max_bytes).select("path"), "path", "left_semi")
    return with_content(files)
