"""Exact removal of long byte strings that an earlier document has: suffix arrays in a logarithmic index family.

A window is a string of LENGTH bytes. Its anchor is the smallest hash among its GRAM-byte substrings (the leftmost of equal ones), so
equal windows have equal anchors, wherever they stand. Four steps, of which each moves only what the one before let through:

1. Each run of documents gives the distinct anchors, dealt to buckets by hash; a bucket tells which ones several documents have.
2. Documents with such anchors give stretches: the bytes of the windows around an anchor (consecutive windows of one anchor share bytes).
3. In a bucket equal stretches become one, of the smallest document: the others are covered whole. Of anchors that have different
   stretches, batches of ascending documents get suffix arrays (of the suffixes that have LENGTH bytes in their stretch, in the order
   of these bytes, by doubling of ranks). A batch is merge-scanned against each level of the index: the place of each of its suffixes
   in the level is found, and whether they agree in LENGTH bytes. Then it becomes a level; levels of about equal size merge, so sizes are
   geometric and each suffix is merged a logarithmic number of times. All comparisons are of bytes, none of hashes.
4. Covered bytes of a document are removed.

Buckets are as many as the input asks for. An anchor that very many runs have is dealt by window, so no bucket depends on it. Its own
bucket alone decides that, and the answer holds for all documents: equal windows meet in one bucket whatever the threshold. These
anchors go to every task; they are fewer than one for each HOT_RUNS bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytetools import U64, byte_values, mix, prefix_hash, runs, span_hash
from .common import fresh

LENGTH, GRAM = 50, 18
RUN, CHUNK = 1 << 20, 1 << 20
BUCKET_BYTES = 8 << 20
#: An anchor that more runs than this have is dealt by window.
HOT_RUNS = 20_000
#: Windows of a batch, and of what one index holds at most (but for a single anchor with more).
BATCH, PART = 1 << 16, 1 << 21
_PLACE, _TOP = U64((1 << 24) - 1), 48
_PAIR = np.dtype([("doc", "<i8"), ("key", "<i8")])


def _words(data: np.ndarray) -> np.ndarray:
    """At each byte the number that the eight bytes from there make, so that numbers compare as bytes do; zeros follow the end."""
    padded = np.zeros(len(data) + LENGTH + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + LENGTH, ">u8", padded, strides=(1,)).astype(U64)


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), U64)
    rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))).astype(U64)
    return rank


def suffix_array(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at ``at``, by their first LENGTH bytes, and where in it another string than before begins.

    words: of the whole text. Ranks by 8 bytes are doubled to 16 and 32; two of these, which overlap, make LENGTH bytes.
    """
    a, b = int(at.min()), int(at.max()) + LENGTH
    rank = _dense(words[a:b])
    for h in (8, 16):
        rank = _dense(rank << U64(32) | np.concatenate((rank[h:], np.zeros(h, U64))))
    key = rank[at - a] << U64(32) | rank[at - a + LENGTH - 32]
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate(([True], key[1:] != key[:-1]))


class LogIndex:
    """Levels of (start, document, first word), in the order of the strings of LENGTH bytes that start there, each string once.

    Each level has at least twice the strings of the next. All are of one text, given by its ``_words``.
    """

    #: Where the words of a string begin; the last two overlap.
    PLACES = (8, 16, 24, 32, 40, LENGTH - 8)

    def __init__(self, words: np.ndarray):
        self.words, self.depth = words, 0
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _places(self, level: tuple[np.ndarray, np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each string of ``new``: how many of the level are smaller, and whether the level has it."""
        lo, hi = np.searchsorted(level[2], new[2], "left"), np.searchsorted(level[2], new[2], "right")
        equal = np.zeros(len(lo), bool)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            mine, theirs = new[0][open_], level[0][mid]
            side = np.zeros(len(open_), np.int8)
            tied = np.arange(len(open_))
            for k in self.PLACES:
                x, y = self.words[mine[tied] + k], self.words[theirs[tied] + k]
                side[tied] = (x > y).astype(np.int8) - (x < y)
                tied = tied[x == y]
                if not len(tied):
                    break
            up = side >= 0
            lo[open_[up]] = mid[up] + (side[up] > 0)
            hi[open_[~up]] = mid[~up]
            equal[open_[side == 0]] = True
            open_ = open_[(side != 0) & (lo[open_] < hi[open_])]
        return lo, equal

    def scan(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The smallest document of the levels that has each string of a batch, or a number above all."""
        out = np.full(len(new[0]), np.iinfo(np.int64).max)
        for level in self.levels:
            place, equal = self._places(level, new)
            out[equal] = np.minimum(out[equal], level[1][place[equal]])
        return out

    def add(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Documents of ``new`` are not smaller than those of the index."""
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            old = self.levels.pop()
            place, equal = self._places(old, new)
            place = place[~equal] + np.arange(len(place) - int(equal.sum()))
            own = np.ones(len(old[0]) + len(place), bool)
            own[place] = False
            both = []
            for x, y in zip(old, new, strict=True):
                z = np.empty(len(own), x.dtype)
                z[own], z[place] = x, y[~equal]
                both.append(z)
            new = tuple(both)
        self.levels.append(new)
        self.depth = max(self.depth, len(self.levels))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, 48-bit hash) of each stretch of windows of one anchor."""
    out = []
    n = len(data)
    if n >= LENGTH:
        bad = np.zeros(n + 1, np.int32)
        full = np.diff(at) > 0
        np.add.at(bad, np.maximum(at[:-1], at[1:] - LENGTH + 1)[full], 1)
        np.add.at(bad, at[1:][full], -1)
        valid = np.cumsum(bad[:-1]) == 0
        for a in range(0, n - LENGTH + 1, CHUNK):
            b = min(a + CHUNK, n - LENGTH + 1)
            sums = prefix_hash(byte_values(data[a : b + LENGTH - 1]))
            i = np.arange(b - a + LENGTH - GRAM)
            g = span_hash(sums, i, i + GRAM)
            # smallest hashes are what is kept, so buckets go by another hash of them
            m = (g & ~_PLACE) | i.astype(U64)
            width = 1
            while 2 * width <= LENGTH - GRAM + 1:
                m = np.minimum(m[:-width], m[width:])
                width *= 2
            rest = LENGTH - GRAM + 1 - width
            if rest:
                m = np.minimum(m[:-rest], m[rest:])
            s = np.flatnonzero(valid[a:b])
            if len(s):
                p = (m[s] & _PLACE).astype(np.int64)
                new = np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:] - 1, [len(s) - 1]))
                out.append((s[first] + a, s[last] + a, mix(g[p[first]]) >> U64(64 - _TOP)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    lo, hi, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(at, lo, "right") - 1, lo, hi, h


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(16)) * U64(buckets) >> U64(_TOP - 16)).astype(np.int64)


def _by_bucket(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of sorted hashes, of the buckets that occur."""
    b = _bucket(h, buckets)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))[: len(b)]
    return list(zip(b[first].tolist(), first.tolist(), np.append(first[1:], len(b)).tolist(), strict=True))


def _planes(h: np.ndarray) -> bytes:
    """Sorted 48-bit numbers byte by byte, so that the leading bytes compress."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(6, n).T
    return out.reshape(-1).view("<u8")


def _packed(bucket: int, kind: int, ids: np.ndarray, rows: np.ndarray, *parts: bytes) -> tuple:
    """A message to a bucket: the documents it speaks of, which one each entry is of, and the entries' columns."""
    used, local = np.unique(rows, return_inverse=True)
    return bucket, kind, ids[used].tobytes(), len(rows), local.astype("<u2").tobytes() if len(used) <= 65536 else local.astype("<u4").tobytes(), *parts


def _documents(ids: bytes, rows: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, _PAIR)[np.frombuffer(rows, "<u2" if len(rows) == 2 * n else "<u4")]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


_MESSAGE = "bucket int, kind int, ids binary, n long, rows binary, a binary, b binary, c binary"
_NAMES = ["bucket", "kind", "ids", "n", "rows", "a", "b", "c"]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _pairs(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    ids = np.zeros(b - a, _PAIR)
    ids["doc"], ids["key"] = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
    return ids


def _tell_anchors(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for a, b, data, at in runs(batch.column(2), RUN):
                ids = _pairs(batch, a, b)
                row, _, _, h = anchors(data, at)
                order = np.lexsort((row, ids["doc"][row], h))
                row, h = row[order], h[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, bool)
                row, h = row[new], h[new]
                first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                lead = np.flatnonzero(first)
                several = np.diff(np.append(lead, len(h))) > 1
                out = [_packed(k, 0, ids, row[lead[i:j]], _planes(h[lead[i:j]]), several[i:j].tobytes(), b"") for k, i, j in _by_bucket(h[lead], buckets)]
                if not first.all():  # in several documents of this run: known already
                    turn += 1
                    out.append(_packed(int(mix(np.array([ids["key"][0] + turn]).astype(np.int64).view(U64))[0] % U64(buckets)), 1, ids, row[~first], _planes(h[~first]), b"", b""))
                if out:
                    yield _batch(out, _TYPES, _NAMES)

    return each


def _shared_anchors(hot: int, shards: int):
    def each(df: pd.DataFrame) -> pd.DataFrame:
        hs, docs, known, echo = [], [], [], []
        for kind, ids, n, rows, a, b in df[["kind", "ids", "n", "rows", "a", "b"]].itertuples(index=False):
            hs.append(_from_planes(a, n))
            docs.append(_documents(ids, rows, n))
            known.append(np.frombuffer(b, bool) if kind == 0 else np.ones(n, bool))
            echo.append(np.full(n, kind == 1))
        h, d, k, e = (np.concatenate(x) for x in (hs, docs, known, echo))
        order = np.argsort(h, kind="stable")
        h, d, k, e = h[order], d[order], k[order], e[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(first, len(h)))
        leads = np.add.reduceat(~e, first, dtype=np.int64)  # runs; an echo's own bucket may be another one
        repeated = np.logical_or.reduceat(k, first) | (np.minimum.reduceat(d["doc"], first) != np.maximum.reduceat(d["doc"], first))
        h = h | ((np.repeat(leads, size) > hot).astype(U64) << U64(63))
        take = np.repeat(repeated, size) | e
        return _to_documents(d[take], h[take].tobytes(), 8, shards)

    return each


_FOR_DOCUMENTS = "shard int, ids binary, counts binary, data binary"


def _to_documents(d: np.ndarray, data: bytes, width: int, shards: int) -> pd.DataFrame:
    """Entries of ``width`` bytes for documents, as one message to each shard of documents: documents, their counts, entries."""
    shard = (mix(d["doc"].astype(np.int64).view(U64)) % U64(shards)).astype(np.int32)
    order = np.lexsort((d["key"], d["doc"], shard))
    d, shard, x = d[order], shard[order], np.frombuffer(data, np.uint8).reshape(-1, width)[order]
    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))[: len(d)]
    counts = np.diff(np.append(first, len(d)))
    rows = []
    for k in np.unique(shard):
        i, j = np.searchsorted(shard, [k, k + 1])
        u, v = np.searchsorted(first, [i, j])
        rows.append((k, d[first[u:v]].tobytes(), counts[u:v].astype("<i8").tobytes(), x[i:j].tobytes()))
    return pd.DataFrame(rows, columns=["shard", "ids", "counts", "data"]).astype({"shard": "int32"})


def _gathered(width: int):
    """(doc, key, data): the entries of each document of a shard together."""

    def each(df: pd.DataFrame) -> pd.DataFrame:
        ids, counts = np.frombuffer(b"".join(df["ids"]), _PAIR), np.frombuffer(b"".join(df["counts"]), "<i8")
        x, d = np.frombuffer(b"".join(df["data"]), np.uint8).reshape(-1, width), np.repeat(ids, counts)
        order = np.lexsort((d["key"], d["doc"]))
        d, x = d[order], x[order]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        ends = np.append(first[1:], len(d))
        return pd.DataFrame({"doc": d["doc"][first], "key": d["key"][first], "data": [x[a:b].tobytes() for a, b in zip(first, ends, strict=True)]})

    return each


def _by_document(messages: DataFrame, width: int) -> DataFrame:
    return messages.groupBy("shard").applyInPandas(_gathered(width), "doc long, key long, data binary")


def _hot_anchors(texts: DataFrame) -> np.ndarray:
    """The anchors that their own buckets marked, sorted. Others of an anchor's documents may not have the mark."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, U64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            found = np.union1d(found, x[x >> U64(63) > 0] & U64((1 << 63) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    rows = texts.select("data").mapInArrow(each, "h long").distinct().toArrow()
    return np.sort(rows.column(0).to_numpy().view(U64))


def _tell_windows(buckets: int, hot_anchors: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(3).to_pylist()
            for a, b, data, at in runs(batch.column(2), RUN):
                ids = _pairs(batch, a, b)
                row, lo, hi, h = anchors(data, at)
                want = [np.frombuffer(x, "<u8") for x in asked[a:b]]
                owner = np.repeat(np.arange(b - a), [len(x) for x in want])
                want = np.concatenate(want)
                mark = U64((1 << 63) - 1)
                dt = np.dtype([("r", "<i8"), ("h", "<u8")])
                w, mine = np.zeros(len(want), dt), np.zeros(len(h), dt)
                w["r"], w["h"], mine["r"], mine["h"] = owner, want & mark, row, h
                order = np.argsort(w, order=("r", "h"))
                w = w[order]
                code_w = mix(w["h"] + mix(w["r"].astype(U64)))
                code_m = mix(mine["h"] + mix(mine["r"].astype(U64)))
                code_w = np.sort(code_w)
                place = np.minimum(np.searchsorted(code_w, code_m), max(0, len(code_w) - 1))
                take = code_w[place] == code_m if len(code_w) else np.zeros(len(h), bool)
                hot = take & np.isin(h, hot_anchors)
                if hot.any():  # each window on its own
                    i = np.flatnonzero(hot)
                    n = hi[i] - lo[i] + 1
                    s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo[i], n)
                    plain = take & ~hot
                    row, lo, hi = np.concatenate((row[plain], np.repeat(row[i], n))), np.concatenate((lo[plain], s)), np.concatenate((hi[plain], s))
                    h = np.concatenate((h[plain], span_hash(prefix_hash(byte_values(data)), s, s + LENGTH) >> U64(64 - _TOP)))
                else:
                    row, lo, hi, h = row[take], lo[take], hi[take], h[take]
                if len(h):
                    yield _batch(_window_messages(data, at, ids, row, lo, hi, h, buckets), _TYPES, _NAMES)

    return each


def _window_messages(data: np.ndarray, at: np.ndarray, ids: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, buckets: int) -> list[tuple]:
    f = span_hash(prefix_hash(byte_values(data)), lo, hi + LENGTH)
    order = np.lexsort((ids["doc"][row], f, h))
    row, lo, hi, h, f = row[order], lo[order], hi[order], h[order], f[order]
    doc, size = ids["doc"][row], hi - lo + LENGTH
    first = np.concatenate(([True], (f[1:] != f[:-1]) | (h[1:] != h[:-1])))
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.flatnonzero((doc > doc[lead]) & (size == size[lead]))
    same = _same_bytes(data, lo[later], lo[lead[later]], size[later])  # the same bytes, not just the same hash
    known = np.zeros(len(row), bool)
    known[later[same]] = True
    start = lo - at[row]
    out = []
    keep = np.flatnonzero(~known)
    for k, i, j in _by_bucket(h[keep], buckets):
        x = keep[i:j]
        n = size[x]
        cells = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo[x], n)
        out.append(_packed(int(k), 0, ids, row[x], start[x].astype("<i8").tobytes(), n.astype(np.uint8).tobytes(), data[cells].tobytes()))
    x = np.flatnonzero(known)
    if len(x):
        out.append(_packed(int(f[0] % U64(buckets)), 1, ids, row[x], start[x].astype("<i8").tobytes(), size[x].astype(np.uint8).tobytes(), b""))
    return out


def _covered(shards: int):
    """Step 3: ranges of covered bytes, as pairs of 64-bit numbers, for the documents."""

    def each(df: pd.DataFrame) -> pd.DataFrame:
        docs, starts, sizes, blobs, ready = [], [], [], [], []
        for kind, ids, n, rows, a, b, c in df[["kind", "ids", "n", "rows", "a", "b", "c"]].itertuples(index=False):
            d, s, z = _documents(ids, rows, n), np.frombuffer(a, "<i8"), np.frombuffer(b, np.uint8).astype(np.int64)
            if kind == 1:
                ready.append((d, s, s + z))
            else:
                docs.append(d)
                starts.append(s)
                sizes.append(z)
                blobs.append(np.frombuffer(c, np.uint8))
        if docs:
            d, s, z, data = (np.concatenate(x) for x in (docs, starts, sizes, blobs))
            ready.append(_repeats(d, s, z, data))
        d, a, b = (np.concatenate(x) for x in zip(*ready, strict=True))
        return _to_documents(*_union(d, a, b), 16, shards)

    return each


def _union(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bytes]:
    order = np.lexsort((a, d["key"], d["doc"]))
    d, a, b = d[order], a[order], b[order]
    if not len(d):
        return d, b""
    own = np.concatenate(([True], d[1:] != d[:-1]))
    base = np.cumsum(own) * (int(b.max()) + 2)  # keeps documents apart
    top = np.maximum.accumulate(b + base)
    new = own | np.concatenate(([True], (a + base)[1:] > top[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    pairs = np.stack([a[first], top[last] - base[last]], axis=1).astype("<i8")
    return d[first], pairs.tobytes()


def _repeats(d: np.ndarray, s: np.ndarray, z: np.ndarray, data: np.ndarray, batch: int = BATCH, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of covered parts of a bucket's stretches, each of the windows of one anchor.

    Equal stretches are found first. What is left goes by anchor, in parts of about ``part`` windows, so an index stays small however
    many there are.
    """
    begin = np.cumsum(z) - z
    whole, anchor = _stretch_hashes(data, begin, z)
    order = np.lexsort((d["doc"], z, whole))
    first = np.ones(len(order), bool)
    first[1:] = (whole[order][1:] != whole[order][:-1]) | (z[order][1:] != z[order][:-1])
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = np.flatnonzero(d["doc"][order] > d["doc"][lead])
    gone = later[_same_bytes(data, begin[order[later]], begin[lead[later]], z[order[later]])]
    keep = np.ones(len(order), bool)
    keep[gone] = False
    done, left = order[gone], order[keep]
    out = [(d[done], s[done], s[done] + z[done])]
    left = left[np.argsort(anchor[left], kind="stable")]
    if len(left):
        a, doc = anchor[left], d["doc"][left]
        group = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        several = np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group)
        left = left[np.repeat(several, np.diff(np.append(group, len(left))))]
    if len(left):
        a, cell = anchor[left], np.cumsum(z[left] - LENGTH + 1) // part
        group = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        for x in np.split(left, group[1:][cell[group[1:]] != cell[group[:-1]]]):
            out.append(indexed_repeats(d[x], s[x], z[x], begin[x], data, batch)[:3])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def indexed_repeats(d: np.ndarray, s: np.ndarray, z: np.ndarray, begin: np.ndarray, data: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, start, end) of parts of stretches that consist of windows which a smaller document has, by the index; and its depth."""
    order = np.argsort(d["doc"], kind="stable")
    d, s, z, begin = d[order], s[order], z[order], begin[order]
    cells = np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z - begin, z)
    begin = np.cumsum(z) - z
    words = _words(data[cells])
    count = z - LENGTH + 1
    first_window = np.cumsum(count) - count
    starts = np.arange(int(count.sum())) - np.repeat(first_window - begin, count)
    doc = np.repeat(d["doc"], count)
    hit = np.zeros(len(starts), bool)
    index = LogIndex(words)
    for i in range(0, len(starts), batch):
        at, own = starts[i : i + batch], doc[i : i + batch]
        order, new = suffix_array(words, at)
        at, own, first = at[order], own[order], np.flatnonzero(new)
        least = np.minimum.reduceat(own, first)
        entry = at[first], least, words[at[first]]
        earlier = np.minimum(index.scan(entry), least)
        hit[i + order] = earlier[np.cumsum(new) - 1] < own
        index.add(entry)
    if not hit.any():
        return d[:0], s[:0], s[:0], index.depth
    own = np.zeros(len(hit) + 1, bool)
    own[first_window] = True
    a = np.flatnonzero(hit & (np.concatenate(([True], ~hit[:-1])) | own[:-1]))
    b = np.flatnonzero(hit & (np.concatenate((~hit[1:], [True])) | own[1:]))
    entry = np.searchsorted(first_window, a, "right") - 1
    start = s[entry] + a - first_window[entry]
    return d[entry], start, start + (b - a) + LENGTH, index.depth


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 20_000) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for arrays of places."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), most):
        x = slice(i, i + most)
        c = np.arange(int(size[x].max()))
        outside = c >= size[x][:, None]
        end = len(data) - 1
        out[x] = ((data[np.minimum(a[x][:, None] + c, end)] == data[np.minimum(b[x][:, None] + c, end)]) | outside).all(axis=1)
    return out


def _stretch_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch: its hash, and its anchor. The anchor is in all windows, so among the substrings from the last window's start to the first one's end."""
    whole, anchor = [np.zeros(0, U64)], [np.zeros(0, U64)]
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        at = begin[i:j] - begin[i]
        z = size[i:j]
        sums = prefix_hash(byte_values(data[begin[i] : begin[i] + int(z.sum())]))
        whole.append(span_hash(sums, at, at + z))
        last = z - LENGTH
        n = LENGTH - GRAM + 1 - last
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(first, n)
        p = np.repeat(at + last, n) + k
        g = span_hash(sums, p, p + GRAM)
        m = np.minimum.reduceat((g & ~_PLACE) | k.astype(U64), first)
        anchor.append(g[first + (m & _PLACE).astype(np.int64)])
        i = j
    return np.concatenate(whole), np.concatenate(anchor)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT_RUNS) -> DataFrame:
    """(doc_id, text_key, spans, kept) of each text from which bytes go: sorted disjoint ranges [start, end) of bytes, and what is left.

    A byte goes if it is in a string of 50 bytes that also starts in a document of a smaller id, judged on the texts as they are.
    Texts are UTF-8; null, empty and shorter ones lose nothing. Rows with a null id neither lose nor take anything. Rows that
    repeat an id do not count as earlier than each other; if their texts are the same (text_key is the hash) they give one row.
    """
    key = F.xxhash64(F.col(text_col))
    d = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= LENGTH)).select(F.col(id_col).cast("long").alias("doc"), key.alias("key"), F.col(text_col).alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    told = d.mapInArrow(_tell_anchors(buckets), _MESSAGE)
    shared = told.groupBy("bucket").applyInPandas(_shared_anchors(hot, buckets), _FOR_DOCUMENTS)
    asked = _by_document(shared, 8)
    texts = materialize(d.join(asked, ["doc", "key"]).select("doc", "key", "text", "data"))
    windows = texts.mapInArrow(_tell_windows(buckets, _hot_anchors(texts)), _MESSAGE)
    covered = windows.groupBy("bucket").applyInPandas(_covered(buckets), _FOR_DOCUMENTS)
    spans = materialize(_by_document(covered, 16))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, k, text, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw, p = text.encode(), np.frombuffer(data, "<i8").reshape(-1, 2)
                one = np.zeros(len(p), _PAIR)
                _, merged = _union(one, p[:, 0], p[:, 1])
                p, at, left = np.frombuffer(merged, "<i8").reshape(-1, 2).tolist(), 0, []
                for a, b in p:
                    left.append(raw[at:a])
                    at = b
                rows.append((doc, k, [{"start": a, "end": b} for a, b in p], b"".join([*left, raw[at:]])))
            yield _batch(rows, [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()], ["doc_id", "text_key", "spans", "kept"])

    return texts.select("doc", "key", "text").join(spans, ["doc", "key"]).mapInArrow(cut, "doc_id long, text_key long, spans array<struct<start:long,end:long>>, kept binary").dropDuplicates(["doc_id", "text_key"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shortened texts; bytes of a character that was cut through go too. Rows and other columns stay as they are."""
    own, key, kept = (fresh(docs, x) for x in ("_q_id", "_q_key", "_q_kept"))
    r = repeats(docs, id_col, text_col).select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("kept").alias(kept))
    j = docs.join(r, (F.col(id_col) == F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(key)), "left")
    whole = F.regexp_replace(F.make_valid_utf8(F.col(kept).cast("string")), "�", "")
    text = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(whole)
    return j.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])

