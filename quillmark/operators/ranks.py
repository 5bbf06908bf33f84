"""Numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import discard, materialize

_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column], name: str = "k") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in a total order.

    Rows are sorted by ranges and numbered within their range; a range starts after what the ranges before it hold, of which there is
    one count each. The sorted rows are written, so that both passes see the same ranges.
    """
    s = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = s.withColumn("_part", part).join(F.broadcast(before), "_part")  # by a shuffle, whole ranges would fall together
    return out.withColumn(name, F.col("_at").bitwiseAND(_PLACE) + F.col("_before") + 1).drop("_part", "_at", "_before")


def numbered_within(rows: DataFrame, key: str, order: list[Column], name: str = "k") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... among those of equal ``key`` (not null), which may be any share of all rows.

    Rows are sorted by ranges and numbered along them. Only a range's first key can be in ranges before it, as their last one, so
    a row for each range tells where its numbers start.
    """
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_k", LongType())])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, at = b.column(key), np.arange(b.num_rows)
            new = np.empty(b.num_rows, bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(new, at, -1))
            k = np.where(first < 0, held + at, at - first) + 1
            last, held = keys[b.num_rows - 1].as_py(), int(k[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(k)], names=[*b.schema.names, "_part", "_k"])

    held = materialize(rows.where(F.col(key).isNotNull()))  # a sort reads its rows twice
    s = materialize(held.orderBy(F.col(key), *order).mapInArrow(along, schema))
    discard(held)
    ends = materialize(s.groupBy("_part").agg(F.min(key).alias("_first"), F.max(F.struct(key, "_k")).alias("_last")))
    before = ends.select(F.col("_part").alias("_p"), F.col(f"_last.{key}").alias("_first"), F.col("_last._k").alias("_n"))
    starts = ends.join(before, "_first").where("_p < _part").groupBy("_part", "_first").agg(F.sum("_n").alias("_before"))
    out = s.join(F.broadcast(starts), "_part", "left")
    return out.withColumn(name, F.col("_k") + F.when(F.col(key) == F.col("_first"), F.col("_before")).otherwise(0)).drop("_part", "_k", "_first", "_before")
