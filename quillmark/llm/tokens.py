"""Encoding by the tokenizers library, with a table of the ids of segments at which a text can be cut without changing its ids."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .bytetools import U64, mix, runs

END_ID = 2
#: Segments of up to this many bytes are kept in the table, by their bytes.
KEY_BYTES = 24
#: Bytes of texts that are encoded in one go (a longer text is a run of its own).
RUN = 2 << 20
_CHUNK = 1 << 18
_BLANK, _WHITE, _LETTER, _OTHER = 1, 2, 4, 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each byte: space; white space or the first byte of such a character; ASCII letter; other ASCII but an apostrophe."""
    out = np.zeros(256, np.uint8)
    white = {9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3}
    for b in range(256):
        letter = chr(b).isalpha() and b < 128
        out[b] = _BLANK * (b == 32) | _WHITE * (b in white) | _LETTER * letter | _OTHER * (b < 128 and not letter and b not in white and b != 39)
    return out


@lru_cache(maxsize=1)
def _byte_characters() -> dict[int, str]:
    """What byte-level BPE writes for each character up to U+00FF: visible bytes stand for themselves, the others for U+0100 and on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    name = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(256)}


class _Table:
    """Ids by key, open addressing; of up to ``most`` keys, after which it starts anew."""

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most - 1).bit_length())
        self.keys = [np.empty(most, U64) for _ in range(KEY_BYTES // 8)]
        self.start, self.count = np.empty(most, np.int64), np.empty(most, np.int64)
        self.pool = np.empty(1 << 16, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.used = self.filled = 0

    def append(self, ids: np.ndarray, at: int) -> None:
        """Writes ids to the pool at a place, without counting them as filled."""
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty(max(len(self.pool), len(ids)), np.uint32)))
        self.pool[at : at + len(ids)] = ids

    def find(self, key: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Entries, or -1."""
        mask = len(self.slots) - 1
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        out = self.slots[slot]
        wrong = out >= 0
        for mine, asked in zip(self.keys, key, strict=True):
            wrong &= mine[out] == asked
        todo = np.flatnonzero(~wrong & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            e = out[todo] = self.slots[slot[todo]]
            same = e >= 0
            for mine, asked in zip(self.keys, key, strict=True):
                same &= mine[e] == asked[todo]
            todo = todo[~same & (e >= 0)]
        return out

    def add(self, key: list[np.ndarray], h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New, distinct keys."""
        n = len(h)
        new = np.arange(self.used, self.used + n)
        for mine, k in zip(self.keys, key, strict=True):
            mine[new] = k
        self.append(ids, self.filled)
        self.start[new], self.count[new] = self.filled + np.cumsum(counts) - counts, counts
        self.filled += len(ids)
        self.used += n
        mask, slot, todo = len(self.slots) - 1, (h >> U64(64 - self.bits)).astype(np.int64), np.arange(n)
        while len(todo):
            s = slot[todo]
            free = self.slots[s] < 0
            self.slots[s[free]] = new[todo[free]]
            todo = todo[self.slots[s] != new[todo]]
            slot[todo] = (slot[todo] + 1) & mask


class CachedEncoder:
    """Ids of whole texts, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Byte-level BPE with the usual pattern, and one that drops white space, start a new word at each space before what is not white space, at
    a line feed alone between other characters, and where an ASCII letter is followed by other ASCII than an apostrophe. Segments
    between such places recur, so their ids are kept (of up to ``most`` segments). A text with the spelling of an added token, and each text of
    any other tokenizer, is encoded as it is.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre, norm, added = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec.get("added_tokens") or []
        inner = [x.get("type") for x in norm.get("normalizers", [])]
        clean = spec["model"]["type"] == "BPE" and not spec.get("truncation") and not spec.get("padding") and not any(x.get("normalized") for x in added)
        self.kind = ""
        if clean and not norm and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            self.kind = "leading space"
        elif clean and inner == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}:
            split = (pre.get("pretokenizers") or [{}])[0]
            if split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and [x.get("type") for x in pre["pretokenizers"][1:]] == ["ByteLevel"]:
                self.kind = "dropped space"
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in added)) if added else None
        self.table = _Table(max(most, 2 * _CHUNK))  # a chunk always fits
        self.plain = re.compile({"leading space": " ?[A-Za-zÀ-ÖØ-öø-ÿ]+", "dropped space": "[a-zß-öø-ÿ]+"}.get(self.kind, "(?!)"))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and how many each text has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _segment_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # letters of Latin-1 (lower-case ones where case is dropped) are one word, whose ids the model alone gives
        one, model, table = self.plain.fullmatch, self.tokenizer.model.tokenize, _byte_characters()
        out = [[x.id for x in model(t.translate(table))] if one(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def _cuts(self, data: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where segments begin."""
        begin = np.zeros(len(data) + 1, bool)
        if self.kind:
            kind = _classes()[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            solid = ~edge[1:]
            solid[:-1] &= (kind[1:] & _WHITE) == 0  # another character follows in the text, and is not white space
            solid[-1:] = False
            begin[:-1] = (kind & _BLANK > 0) & solid
            begin[1:-1] |= (kind[1:] & _OTHER > 0) & (kind[:-1] & _LETTER > 0)
            feeds = np.flatnonzero((data == 10) & ~edge[:-1] & (solid | edge[1:]))
            if len(feeds):
                before, two = data[feeds - 1], data[np.maximum(feeds - 2, 0)]
                feeds = feeds[np.where(before < 128, kind[feeds - 1] & _WHITE == 0, (two > 0xC2) & (two < 0xE0))]
                begin[feeds] = begin[feeds + 1] = True
            for i in whole:
                begin[at[i] : at[i + 1]] = False
        begin[at] = True
        begin[len(data)] = False
        return np.flatnonzero(begin)

    def encode_run(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts, as UTF-8 bytes and offsets: all ids (unsigned 32-bit), and the number of ids before each text and at the end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        whole = np.unique(np.searchsorted(at, [m.start() for m in self.added.finditer(raw)], "right") - 1) if self.added else np.zeros(0, np.int64)
        starts = self._cuts(data, at, whole)
        ends = np.append(starts[1:], len(data))
        first = starts
        padded = np.zeros(len(data) + KEY_BYTES + 8, np.uint8)
        padded[: len(data)] = data
        if self.kind == "dropped space":
            padded += ((padded >= 65) & (padded <= 90)).astype(np.uint8) * np.uint8(32)
            first = starts + ((data[starts] == 32) | (data[starts] == 10))
        size = ends - first
        slow = size > KEY_BYTES
        slow[np.isin(starts, at[whole])] = True
        if not self.kind or not data.all():
            zeros = np.flatnonzero(data == 0) if self.kind else starts
            slow[np.searchsorted(starts, zeros, "right") - 1] = True
        words = np.ndarray(len(data) + KEY_BYTES, "<u8", padded, strides=(1,))
        parts, counts = [], []
        for a in range(0, len(starts), _CHUNK):
            x = slice(a, a + _CHUNK)
            ids, n = self._chunk(raw, padded, words, starts[x], first[x], ends[x], size[x], slow[x])
            parts.append(ids)
            counts.append(n)
        before = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.concatenate(parts) if len(parts) > 1 else parts[0], before[np.searchsorted(starts, at)]

    def _chunk(self, raw: bytes, padded: np.ndarray, words: np.ndarray, starts: np.ndarray, first: np.ndarray, ends: np.ndarray, size: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.table
        key = [words[first + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(KEY_BYTES // 8)]
        h = key[0] * _FACTORS[0]
        for k, f in zip(key[1:], _FACTORS[1:], strict=True):
            h ^= (k ^ (k >> U64(31))) * f
        h = mix(h)
        fast = ~slow
        entry = table.find(key, h)
        while True:
            lost = np.flatnonzero((entry < 0) & fast)
            if not len(lost):
                break
            if table.used + len(lost) > table.most:
                table.clear()
                entry[:] = -1
                lost = np.flatnonzero(fast)
            new = lost[np.unique(h[lost], return_index=True)[1]]
            source = padded if self.kind == "dropped space" else raw
            texts = [bytes(source[i:j]).decode() for i, j in zip(first[new].tolist(), ends[new].tolist(), strict=True)]
            table.add([k[new] for k in key], h[new], *self._segment_ids(texts))
            entry[lost] = table.find([k[lost] for k in key], h[lost])
        start, count = table.start[entry], table.count[entry]
        if len(long := np.flatnonzero(slow)):
            ids, n = self._ids([raw[i:j].decode() for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
            table.append(ids, table.filled)  # until the next chunk
            start[long], count[long] = table.filled + np.cumsum(n) - n, n
        place = np.cumsum(count) - count
        return table.pool[np.arange(int(count.sum())) + np.repeat(start - place, count)], count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null is empty."""
        out: list[bytes] = []
        for _, _, data, at in runs(pa.array(texts, pa.large_string()), RUN):
            ids, before = self.encode_run(data, at)
            ids = ids.astype("<u4")
            out += [ids[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        return out

    def encode_ended(self, texts: pa.Array, end_id: int = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of runs of a string column, with ``end_id`` after each text; a null is empty."""
        for a, b, data, at in runs(texts, RUN):
            ids, before = self.encode_run(data, at)
            at = before + np.arange(b - a + 1)
            out = np.empty(len(ids) + b - a, np.uint32)
            own = np.ones(len(out), bool)
            own[at[1:] - 1] = False
            out[own], out[at[1:] - 1] = ids, end_id
            yield a, b, out, at


@lru_cache(maxsize=4)
def encoder(path: str) -> CachedEncoder:
    """One for each Python worker."""
    return CachedEncoder(path)


def binary_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Stretches of ids as little-endian bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(ids.astype("<u4", copy=False))])

