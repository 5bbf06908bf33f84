"""SimHash, Hamming distance, snapshot and bundle fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: FNV-1a over 64 bits, but with this start value.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211
_M32, _M64 = 0xFFFFFFFF, (1 << 64) - 1
#: Tokens of texts of more characters are not listed but counted one by one.
_LONG = 1 << 22


def fnv64(token: Column) -> Column:
    """(high, low) 32-bit halves of the hash of an ASCII token. The prime is 2^40 + 435, so products stay within a long."""
    start = F.struct(F.lit(FNV_START >> 32).cast("long").alias("h"), F.lit(FNV_START & _M32).cast("long").alias("l"))

    def step(acc: Column, c: Column) -> Column:
        low = acc["l"].bitwiseXOR(F.ascii(c).cast("long"))
        p = low * 435
        high = (acc["h"] * 435 + F.shiftright(p, 32) + F.shiftleft(low.bitwiseAND(0xFFFFFF), 8)).bitwiseAND(_M32)
        return F.struct(high.alias("h"), p.bitwiseAND(_M32).alias("l"))

    return F.aggregate(F.filter(F.split(token, ""), lambda x: x != ""), start, step)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9]+", -1), lambda x: x != "")


class _Hashes(dict):
    """Hashes of tokens seen so far; beyond ``MOST`` it starts anew."""

    MOST = 1 << 19

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = FNV_START
        for b in token.encode():
            h = (h ^ b) * FNV_PRIME & _M64
        self[token] = h
        return h


def _votes(counts: dict[str, int], known: _Hashes) -> int:
    """The lanes of one text as a signed 64-bit number."""
    if not counts:
        return -1
    n = np.fromiter(counts.values(), np.float64, len(counts))
    h = np.fromiter((known[t] for t in counts), np.uint64, len(counts))
    ones = n @ np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(2 * ones >= n.sum()).view(">i8")[0])


def simhash(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, simhash): 64-bit pattern as a long. A lane is 1 if its votes are 0 or more, so texts without tokens have all ones.

    A row's votes are counted where the row is: nothing is shuffled, and a task keeps the hashes of tokens it has seen.
    """
    word = re.compile("[A-Za-z0-9]+")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out = [_votes(Counter(m.group() for m in word.finditer(t)) if len(t) > _LONG else Counter(word.findall(t)), known) for t in (x.as_py() or "" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "simhash"])

    some = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return some.mapInArrow(hashed, StructType([some.schema["id"], StructField("simhash", LongType())]))


def hex16(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bundle_id(manifest: DataFrame, path_col: str = "path", hash_col: str = "hash") -> DataFrame:
    """One row, bundle_id: sha256 of the sorted lines ``path:hash``, each with its line feed.

    The hash is of all lines in order, so it is fed by a stream of sorted stretches; neither a task nor the driver holds more than one.
    """
    from .paths import normal_path

    line = F.concat(normal_path(F.col(path_col)), F.lit(":"), F.translate(F.col(hash_col), "ABCDEF", "abcdef"), F.lit("\n"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(x for x in batch.column(0).to_pylist() if x is not None)])], names=["lines"])

    total = hashlib.sha256()
    for r in manifest.select(line.alias("line")).orderBy("line").mapInArrow(stretches, "lines string").toLocalIterator():
        total.update(r["lines"].encode())
    return manifest.sparkSession.createDataFrame([(total.hexdigest(),)], "bundle_id string")
