"""Snapshots as a stream: each micro-batch of file states is classified against the last one, then takes its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import classify
from ..sources.state import SNAPSHOT


def latest(events: DataFrame) -> DataFrame:
    """(path, hash, lines) of events (path, hash, lines, ts): the last of each path; a null hash means that the file is gone."""
    return events.groupBy("path").agg(F.max_by(F.struct("hash", "lines"), F.struct("ts", "hash")).alias("x")).select("path", "x.hash", "x.lines")


def applied(prev: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshot, and what changed: paths without events stay as they are."""
    new = latest(events)
    kept = prev.join(new.select("path"), "path", "left_anti").select("path", "hash", "lines")
    curr = kept.unionByName(new.where("hash is not null"))
    return curr, classify(prev, curr).where("op <> 'same'")


def follow(events: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs over a stream of events; ``sink`` gets the changes of each batch.

    The snapshot of batch n is in ``folder``/n. A batch that runs again starts from the same one before it and overwrites
    its own, so it gives the same changes.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        before = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
        there = before.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(before)
        prev = spark.read.schema(SNAPSHOT).parquet(f"{folder}/{n - 1}") if there else spark.createDataFrame([], SNAPSHOT)
        curr, changed = applied(prev, df)
        curr.write.mode("overwrite").parquet(f"{folder}/{n}")
        sink(changed, n)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
