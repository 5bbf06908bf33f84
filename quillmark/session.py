"""Session and scratch-space helpers shared by the whole package."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "/tmp/checkpoints"
#: Has Spark delete a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "quillmark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir`` (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``; a local one where that is unset and all tasks run in this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_SCRATCH
    return f"{root.rstrip('/')}/quillmark-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads this query's shuffle files again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmark_path = path
    return out


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def until_exit(spark: SparkSession, path: str) -> None:
    """Has what is at ``path`` deleted when the driver ends; until then results may be read from it."""
    system, target = _folder(spark, path)
    system.deleteOnExit(target)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; later reads of it fail."""
    path = getattr(df, "_quillmark_path", None)
    if path:
        system, target = _folder(df.sparkSession, path)
        system.delete(target, True)
