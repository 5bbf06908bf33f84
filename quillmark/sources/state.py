"""Snapshots and blobs that are kept between runs."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "path string, hash string, lines int"


def project_key(source: str) -> str:
    return hashlib.sha256(os.path.abspath(source).encode()).hexdigest()[:12]


def folder(base: str, source: str) -> str:
    return os.path.join(base, project_key(source))


def clear(where: str) -> None:
    shutil.rmtree(where, ignore_errors=True)


def save_snapshot(where: str, files: DataFrame, module: str, previous_root: str = "", created: str | None = None) -> None:
    """index.json of (path, hash, lines), written beside and moved into place. Of one bundle, which its budget bounds; ``save_table`` is for corpora."""
    os.makedirs(where, exist_ok=True)
    rows = [{"path": r.path, "hash": r.hash, "lines": r.lines} for r in files.select("path", "hash", "lines").orderBy("path").toLocalIterator()]
    doc = {"module": module, "created": created or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "files": rows}
    if previous_root:
        doc["prevSrcDir"] = previous_root
    fd, temp = tempfile.mkstemp(dir=where)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, os.path.join(where, "index.json"))


def load_snapshot(spark: SparkSession, where: str) -> tuple[DataFrame, dict] | None:
    """Files and header; None where there is none."""
    try:
        with open(os.path.join(where, "index.json"), encoding="utf-8") as f:
            doc = json.load(f)
    except FileNotFoundError:
        return None
    rows = [(x["path"], x["hash"], x["lines"]) for x in doc.pop("files", [])]
    return spark.createDataFrame(rows, SNAPSHOT), doc


def save_table(path: str, files: DataFrame) -> None:
    """A snapshot of any size, as Parquet."""
    files.select("path", "hash", "lines").write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Empty where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(SNAPSHOT).parquet(path) if there else spark.createDataFrame([], SNAPSHOT)


def new_blobs(files: DataFrame, known: DataFrame) -> DataFrame:
    """(hash, content) of contents that are not known yet, each once."""
    return files.select("hash", "content").where(F.col("hash").rlike(BLOB_HASH)).dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti")


def save_blobs(path: str, files: DataFrame) -> None:
    spark = files.sparkSession
    new_blobs(files, load_blobs(spark, path)).write.mode("append").parquet(path)


def load_blobs(spark: SparkSession, path: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema("hash string, content binary").parquet(path) if there else spark.createDataFrame([], "hash string, content binary")


#: A hash of a blob: lower hex digits, six at least; others are refused.
BLOB_HASH = "^[0-9a-f]{6,}$"


def read_blobs(spark: SparkSession, path: str, wanted: DataFrame, hash_col: str = "hash") -> DataFrame:
    """``wanted`` with content: that of each row's hash, or null where it is unknown. A malformed hash ends the job."""
    h = F.col(hash_col)
    checked = F.when(h.isNull() | h.rlike(BLOB_HASH), h).otherwise(F.raise_error(F.concat(F.lit("not a hash of a blob: "), h)))
    blobs = load_blobs(spark, path).select(F.col("hash").alias("_blob"), "content")
    return wanted.join(blobs, checked == F.col("_blob"), "left").drop("_blob")


def has_blobs(spark: SparkSession, path: str, wanted: DataFrame, hash_col: str = "hash") -> DataFrame:
    """``wanted`` with known: whether there is a blob; a malformed hash has none."""
    blobs = load_blobs(spark, path).select(F.col("hash").alias("_blob")).distinct()
    return wanted.join(blobs, F.col(hash_col) == F.col("_blob"), "left").withColumn("known", F.col("_blob").isNotNull() & F.col(hash_col).rlike(BLOB_HASH)).drop("_blob")
