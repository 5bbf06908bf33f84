"""Token files: ids of documents in ascending id order, range-coded in blocks (see rangecoder), written and read by Spark.

A file set is a folder with one part per range of ids. Its container is Parquet, so any store that Spark reaches will do; a row is a
block: part, block (from 0 in its part), n_ids, docs and counts (the documents that have ids in the block, and how many), data.
A document may go on in the next block, where it stands first, with ``more`` set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rangecoder import BLOCK_IDS, LANES, decode_blocks, encode_blocks
from .tokens import END_ID, binary_array, encoder

BLOCKS = "part int, block int, n_ids long, more boolean, docs array<long>, counts array<long>, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("more", pa.bool_()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("data", pa.binary())])
_READ = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the file set. Null and empty texts are the end id alone; rows that repeat an id stand in the order of their text's hash.

    Other columns are ignored. An empty table gives a file set without blocks.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = d.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held, docs, counts, size, done, goes_on = [], [], [], 0, 0, False

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, docs, counts, size, done, goes_on
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            key, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, counts))  # keys are objects: one may be null
            n = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
            cuts = list(range(0, n, BLOCK_IDS))
            data = encode_blocks([ids[a : min(a + BLOCK_IDS, n)] for a in cuts])
            ends = np.cumsum(count)
            rows = []
            for k, (a, x) in enumerate(zip(cuts, data, strict=True)):
                b = min(a + BLOCK_IDS, n)
                i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
                inside = np.diff(np.minimum(ends[i : j + 1], b), prepend=a)
                begun = goes_on if a == 0 else bool((ends[i - 1] if i else 0) < a)
                rows.append((part, done + k, b - a, begun, key[i : j + 1].tolist(), inside.tolist(), x))
            done += len(cuts)
            if n:
                i = int(np.searchsorted(ends, n, "right"))
                begun = int(ends[i - 1]) if i else 0
                goes_on = i < len(ends) and n > begun or i == 0 and goes_on
                key, count = key[i:], np.diff(ends[i:], prepend=n)
            held, docs, counts, size = [ids[n:]], [key], [count], len(ids) - n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            for a, b, ids, at in enc.encode_ended(batch.column(1), end_id):
                held.append(ids)
                docs.append(keys[a:b])
                counts.append(np.diff(at))
                size += len(ids)
                if size >= LANES * BLOCK_IDS:
                    yield from flush(False)
        yield from flush(True)

    dealt.mapInArrow(coded, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document; start is the number of ids of all documents before it.

    ids are little-endian unsigned 32-bit. A damaged block raises BlockError.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per part
    starts, at = [], 0
    for r in totals:
        starts.append((r["part"], at))
        at += r["n"]
    schema = _READ.append(pa.field("ids", pa.binary())) if with_ids else _READ

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, begin = None, 0, 0
        open_doc: list | None = None  # doc, begin, ids so far, crc, pieces

        def close() -> tuple:
            nonlocal place
            doc, b, n, crc, pieces = open_doc
            place += 1
            return (part, place - 1, doc, b, n, crc, *([b"".join(pieces)] if with_ids else []))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, LANES):
                some = batch.slice(a, LANES)
                rows = []
                parts, mores, docs, counts = (some.column(k).to_pylist() for k in (0, 3, 4, 5))
                for p, more, ds, cs, ids in zip(parts, mores, docs, counts, decode_blocks(some.column(6).to_pylist()), strict=True):
                    if p != part:
                        if open_doc:
                            rows.append(close())
                        part, place, begin, open_doc = p, 0, 0, None
                    raw, at = ids.astype("<u4").tobytes(), 0
                    for k, (doc, n) in enumerate(zip(ds, cs, strict=True)):
                        x = raw[4 * at : 4 * (at + n)]
                        at += n
                        if k == 0 and more and open_doc:
                            open_doc[2] += n
                            open_doc[3] = zlib.crc32(x, open_doc[3])
                        else:
                            if open_doc:
                                rows.append(close())
                            open_doc = [doc, begin, n, zlib.crc32(x), []]
                        if with_ids:
                            open_doc[4].append(x)
                        begin += n
                if rows:
                    yield batch_of(rows)
        if open_doc:
            yield batch_of([close()])

    fields = "part int, place long, doc_id long, begin long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    d = blocks.repartition("part").sortWithinPartitions("part", "block").select("part", "block", "n_ids", "more", "docs", "counts", "data").mapInArrow(decoded, fields)
    first = spark.createDataFrame(starts, "part int, before long")  # one row per part
    return d.join(first, "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
