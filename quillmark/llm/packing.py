"""Best-fit packing of token sequences: bounded-space online best fit.

Each task keeps a fixed number of open bins. A bitset has a bit for each free space that some open bin has, so the tightest bin for a piece is
the lowest set bit at or above its length. When there are too many open bins the fullest closes. Tasks pack what they are
dealt, on their own; pieces come in blocks that are sorted longest first, which costs no look-ahead beyond a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, binary_array, encoder

CAPACITY = 1024
OPEN_BINS = 16384
BLOCK = 16384


class BestFit:
    """``place(length) -> (bin, offset)``; bins are numbered from 0 as they open."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most, self.open, self.made, self.bits = capacity, open_bins, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"length {length} does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.by_space[free]
            number = stack.pop()
            if not stack:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_space[fullest].pop(0)
                self.open -= 1
                if not self.by_space[fullest]:
                    self.bits ^= 1 << fullest
        return number, self.capacity - free


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each whole text's ids and the end id, in pieces of at most ``capacity`` ids.

    ids are little-endian unsigned 32-bit. Only the first piece may be shorter than ``capacity``. A null or empty text is the end
    id alone; repeated rows give pieces each; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for a, b, ids, at in enc.encode_ended(batch.column(1), end_id):
                n = np.diff(at)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece > 0, n[row] - (pieces[row] - piece) * capacity, 0)
                end = n[row] - (pieces[row] - piece - 1) * capacity
                stretches = binary_array(ids, np.append(at[row] + start, at[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(end - start), stretches.cast(pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, block: int = BLOCK) -> DataFrame:
    """``pieces`` with sequence_id and offset; in a sequence they stand without gaps from 0 and fill at most ``capacity``.

    Needs doc_id, piece and length of 1 to ``capacity``; other columns go along. Pieces are dealt by (doc_id, piece), so a
    document of any length is spread. A task's rows are sorted first, so that a task that runs again places them alike.
    """
    dealt = pieces.repartition(F.col("doc_id"), F.col("piece"))  # without a number: small inputs come to few tasks
    dealt = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length")
    schema = dealt.drop("sequence_id", "offset").schema.add("sequence_id", "long").add("offset", "long")
    keep = [x.name for x in schema][:-2]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, task = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for rows in _blocks(batches, block):
            lengths = rows.column("length").to_numpy()
            number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for i in np.argsort(-lengths, kind="stable"):
                number[i], offset[i] = fit.place(int(lengths[i]))
            out = rows.select(keep).append_column("sequence_id", pa.array(number + task)).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    return dealt.mapInArrow(placed, schema)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, size)
            held, n = whole.slice(size).to_batches(), n - size
    if n:
        yield pa.Table.from_batches(held)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, documents): the packed ids themselves, and (doc_id, piece, offset, length) of what is in them."""
    g = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("x"))  # at most `capacity` pieces
    ids = F.aggregate(F.transform("x", lambda x: x["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return g.select("sequence_id", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), ids.alias("ids"), F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"))
