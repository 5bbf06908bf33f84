"""Whole batches of texts as one byte array: word bounds and 64-bit hashes without a Python loop over words or characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about this many bytes (a longer text is a run of its own).
RUN_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: whether it is in a word, its value when A-Z count as a-z, and its value as it is."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    in_word = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    values = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
    return in_word, values[low], values


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, RUN_BYTES + 65536)
        inverse = pow(_BASE, -1, 2**64)
        for key, base in (("up", _BASE), ("down", inverse)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums such that (sums[b] - sums[a]) * base^-a is the hash of values[a:b] wherever it stands."""
    up, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[b] - sums[a]) * down[a])


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of a string column; a null counts as an empty text."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes of the run) of all words, and for each text the number of words before it (one more entry than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _tables()[0][data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, at, "left")


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (A-Z as a-z), start and end of each word, and the word offsets of the texts."""
    starts, ends, by_text = word_spans(data, at)
    return span_hash(prefix_hash(_tables()[1][data]), starts, ends), starts, ends, by_text


def byte_values(data: np.ndarray) -> np.ndarray:
    return _tables()[2][data]
