"""Adaptive context-mixing range coder for token ids; many blocks are coded in step, one lane each, so all steps are numpy's.

A block is coded on its own: it starts with an empty model and has a checksum. Its distinct ids stand in its header; in
the block an id is its rank among them. Three predictions are mixed: order 0 gives each rank its share by adaptive counts; orders 1
and 2 (keyed by the last one and two ranks) each name the rank that came last in their context, with a confidence: how often in a
row they were right. How often predictions of a confidence hit in this block sets their weights. An interval has a part for
each order's weight, that of order 2 first, so equal names share one interval; a rank that no order names lies in the part of order 0.
Shares and weights are renewed at the ends of stretches of steps. The interval drives a 64-bit range coder with carries.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 4096
LANES = 2048
MAGIC = b"QMRC\x02"
SHARE_BITS, WEIGHT_BITS = 13, 8
TOTAL_BITS = SHARE_BITS + WEIGHT_BITS
SHARES, WEIGHTS, TOTAL = 1 << SHARE_BITS, 1 << WEIGHT_BITS, 1 << TOTAL_BITS
#: Cells for contexts of order 2, and confidences; a cell holds a rank and a confidence in 16 bits.
CONTEXTS, CONFIDENCES = 4096, 16
#: The cell of two ranks is (last * PAIR + the one before) modulo CONTEXTS.
PAIR = 1031
#: Steps after which shares and weights are renewed.
STRETCHES = (0, 256, 1024, BLOCK_IDS)
_PRIOR = np.array([0.02, *(k / (k + 1.5) for k in range(1, CONFIDENCES))])
#: What ``said`` (see ``_Model.learn``) makes of the confidences of orders 1 and 2.
_SAID = np.arange(1024)
NEXT1, NEXT2 = (np.minimum((_SAID >> a & 15) * (_SAID >> b & 1) + 1, CONFIDENCES - 1).astype(np.uint16) for a, b in ((0, 8), (4, 9)))
U64 = np.uint64
TOP, WORD = U64(1 << 32), U64(32)


class BlockError(ValueError):
    """A block is damaged."""


class _Model:
    """The state of all lanes. ``sizes``: distinct ids of each lane; ``slots``: whether ranks are looked up by share."""

    def __init__(self, sizes: np.ndarray, slots: bool):
        n, self.width, self.sizes, self.slots = len(sizes), int(sizes.max()), sizes.astype(np.int64), slots
        rows = np.arange(n)
        self.by_width, self.by_context, self.by_pair, self.by_share = rows * self.width, rows * CONTEXTS, rows * CONFIDENCES**2, rows * SHARES
        self.counts = (np.arange(self.width)[None, :] < self.sizes[:, None]).astype(np.int32)
        self.guess1, self.guess2 = np.zeros(n * self.width, np.uint16), np.zeros(n * CONTEXTS, np.uint16)
        self.hits = [np.repeat((4 * np.stack((1 - _PRIOR, _PRIOR), axis=1))[None], n, axis=0) for _ in (1, 2)]  # lane, confidence, missed or hit
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.renew()

    def renew(self) -> None:
        """Shares of SHARES by the counts, one at least for each rank that the lane has; weights by the hits."""
        room = ((SHARES - self.sizes) / self.counts.sum(axis=1)).astype(np.float32)
        f = (self.counts * room[:, None]).astype(np.int32)
        f += self.counts > 0
        f[:, 0] += SHARES - f.sum(axis=1)
        start = np.cumsum(f, axis=1, dtype=np.int32)
        start -= f
        self.share = (start.view(np.uint32) << np.uint32(16) | f.view(np.uint32)).reshape(-1)
        if self.slots:
            self.rank_at = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), len(f)), f.reshape(-1))
        p1, p2 = (h[:, :, 1] / h.sum(axis=2) for h in self.hits)
        w2 = np.clip((p2 * 250).astype(np.int32), 1, 240)[:, :, None]
        w1 = np.maximum(((p1 * 250).astype(np.int32)[:, None, :] * (248 - w2)) >> WEIGHT_BITS, 1)
        self.weights = ((w1 + w2) << 8 | w2).reshape(-1)  # by the confidences of order 2 and 1: both weights, and that of order 2

    def seen(self, ranks: np.ndarray, said: np.ndarray, valid: np.ndarray | None) -> None:
        """Counts a stretch (steps x lanes); said: see ``learn``. valid: None if all are."""
        n = ranks.shape[1]
        pick = (lambda x: x.reshape(-1)) if valid is None else (lambda x: x[valid])
        self.counts[:n] += np.bincount(pick(ranks + self.by_width[:n]), minlength=n * self.width).reshape(n, -1).astype(np.int32)
        cells = np.bincount(pick(said + (np.arange(n) << 10)), minlength=n << 10).reshape(n, 2, 2, CONFIDENCES, CONFIDENCES)  # lane, hits of 2, of 1, confidences of 2, of 1
        self.hits[1][:n] += cells.sum(axis=(2, 4)).transpose(0, 2, 1)
        self.hits[0][:n] += cells[:, 0].sum(axis=2).transpose(0, 2, 1)  # what order 2 missed
        self.renew()

    def predict(self, k: int) -> None:
        """For the first k lanes: the ranks that orders 1 and 2 name, and the weights."""
        self.at1 = self.by_width[:k] + self.last[:k]
        self.at2 = self.by_context[:k] + ((self.last[:k] * PAIR + self.before[:k]) & (CONTEXTS - 1))
        g1, g2 = self.guess1.take(self.at1), self.guess2.take(self.at2)
        self.sure, self.c1, self.c2 = (g1 & 15) | (g2 & 15) << 4, g1 >> 4, g2 >> 4
        w = self.weights.take(self.by_pair[:k] + self.sure)
        self.named, self.w2 = w >> 8, w & 255

    def intervals(self, r: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width, of TOTAL, of rank r (steps x lanes), of which said is known."""
        n = r.shape[1]
        w = self.weights.take(self.by_pair[:n] + (said & 255))
        share = self.share.take(self.by_width[:n] + r)
        named, w2 = w >> 8, w & 255
        w0 = WEIGHTS - named
        start, width = (named << SHARE_BITS) + w0 * (share >> 16).view(np.int32), w0 * (share & 0xFFFF).view(np.int32)
        i = (said & 256).nonzero()
        start[i], width[i] = w2[i] << SHARE_BITS, (named[i] - w2[i]) << SHARE_BITS
        i = (said & 512).nonzero()
        start[i], width[i] = 0, np.where(said[i] & 256, named[i], w2[i]) << SHARE_BITS
        return start.astype(U64), width.astype(U64)

    def find(self, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank in whose interval t lies, and the interval's start and width; sets which orders named the rank."""
        top, w0 = self.named << SHARE_BITS, WEIGHTS - self.named
        rest = t - top
        i = (rest < 0).nonzero()[0]
        rest[i] = 0
        r = self.rank_at.take(self.by_share[:k] + rest // w0)
        share = self.share.take(self.by_width[:k] + r)
        start, width = top + w0 * (share >> 16).view(np.int32), w0 * (share & 0xFFFF).view(np.int32)
        if len(i):
            c1, c2, w2 = self.c1[i], self.c2[i], self.w2[i]
            both = c1 == c2
            two = (t[i] < w2 << SHARE_BITS) | both
            r[i] = np.where(two, c2, c1)
            start[i], width[i] = np.where(two, 0, w2) << SHARE_BITS, np.where(both, self.named[i], np.where(two, w2, self.named[i] - w2)) << SHARE_BITS
        self.ok1, self.ok2 = self.c1 == r, self.c2 == r
        return r, start.astype(U64), width.astype(U64)

    def learn(self, r: np.ndarray, k: int) -> np.ndarray:
        """Returns confidences and hits as one number a lane: 4 bits for each order's confidence, a bit for each order's hit."""
        own = r << 4
        said = self.sure | self.ok1.view(np.uint8).astype(np.uint16) << 8 | self.ok2.view(np.uint8).astype(np.uint16) << 9
        self.guess1[self.at1] = own | NEXT1.take(said)
        self.guess2[self.at2] = own | NEXT2.take(said)
        self.before[:k] = self.last[:k]
        self.last[:k] = r
        return said


def _varints(x: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; all but a number's last byte have the top bit set."""
    x = x.astype(np.int64)
    places = np.arange(max(1, -(-int(x.max(initial=0)).bit_length() // 7)))
    rest = x[:, None] >> 7 * places
    more = rest >= 128
    return (rest & 127 | more << 7).astype(np.uint8)[(rest > 0) | (places == 0)].tobytes()


def _read_varints(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """Vectorised: ends are the bytes below 128."""
    b = np.frombuffer(data, np.uint8, offset=at, count=min(len(data) - at, 5 * n))
    ends = np.flatnonzero(b < 128)[:n]
    if len(ends) < n:
        raise BlockError("header is cut off")
    size = int(ends[-1]) + 1 if n else 0
    starts = np.concatenate(([0], ends[:-1] + 1)) if n else ends
    place = np.arange(size) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b[:size] & 127).astype(np.int64) << (7 * place), starts) if n else np.zeros(0, np.int64), at + size


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids, and the rank of each id among them."""
    if not len(ids) or int(ids.max()) >= 1 << 16:
        return np.unique(ids, return_inverse=True)
    at, there, rank = ids.astype(np.int64), np.zeros(1 << 16, bool), np.empty(1 << 16, np.uint16)
    there[at] = True
    kinds = there.nonzero()[0]
    rank[kinds] = np.arange(len(kinds), dtype=np.uint16)
    return kinds.astype(np.uint32), rank.take(at)


def _said(context: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Confidence, and 256 for a hit, at each place of a block for one order, as the decoder will have them: the name in a context is the rank that came last in it."""
    order, n = np.argsort(context, kind="stable"), len(r)
    c, x, at = context.take(order), r.take(order), np.arange(n, dtype=np.int32)
    new, on = np.ones(n, bool), np.zeros(n, bool)
    np.not_equal(c[1:], c[:-1], out=new[1:])
    np.equal(x[1:], x[:-1], out=on[1:])
    old = ~new
    on &= old
    run = at + 1 - np.maximum.accumulate(at * ~on)
    said = np.zeros(n, np.uint16)
    np.minimum(run[:-1], CONFIDENCES - 1, out=said[1:], casting="unsafe")
    said *= old
    said |= (on | (new & (x == 0))).astype(np.uint16) << 8  # a new cell names rank 0
    out = np.empty(n, np.uint16)
    out[order] = said
    return out


def _contexts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last, before = np.zeros(len(r), np.uint16), np.zeros(len(r), np.uint16)
    last[1:], before[2:] = r[:-1], r[:-2]
    return last, (last * np.uint32(PAIR) + before & np.uint32(CONTEXTS - 1)).astype(np.uint16)


def _by_length(lengths: list[int]) -> list[list[int]]:
    """Indices in groups of up to LANES, the longest first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    return [order[a : a + LANES] for a in range(0, len(order), LANES)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block (up to BLOCK_IDS unsigned 32-bit ids) as bytes."""
    out: list[bytes] = [b""] * len(blocks)
    for some in _by_length([len(b) for b in blocks]):
        for i, x in zip(some, _encode([np.asarray(blocks[i], np.uint32) for i in some]), strict=True):
            out[i] = x
    return out


def _stretches(lengths: np.ndarray):
    """(first step, end step, validity or None) of each stretch, and the lanes that are active at each step, the longest first."""
    steps = int(lengths[0])
    for a, b in zip(STRETCHES, STRETCHES[1:], strict=False):
        b = min(b, steps)
        if a < b:
            n = int((lengths > a).sum())
            yield a, b, None if lengths[n - 1] >= b else np.arange(a, b)[:, None] < lengths[None, :n], n


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    if lengths[0] > BLOCK_IDS:
        raise ValueError("a block is too long")
    live = int((lengths > 0).sum())
    kinds, payload = [np.zeros(0, np.uint32)] * len(blocks), [b""] * len(blocks)
    if live:
        lengths = lengths[:live]
        steps = int(lengths[0])
        ranks, told = np.zeros((live, steps), np.uint16), np.zeros((live, steps), np.uint16)
        for j, b in enumerate(blocks[:live]):
            kinds[j], r = _distinct(b)
            ranks[j, : len(b)] = r = r.astype(np.uint16)
            one, two = (_said(c, r) for c in _contexts(r))
            told[j, : len(b)] = one | (two & 15) << 4 | (two & 256) << 1
        ranks, told = np.ascontiguousarray(ranks.T).astype(np.int64), np.ascontiguousarray(told.T)
        m = _Model(np.array([len(u) for u in kinds[:live]]), False)
        low, rng = np.zeros(live, U64), np.full(live, 2**64 - 1, U64)
        words, used = np.zeros((live, steps * TOTAL_BITS // 32 + 4), np.uint32), np.zeros(live, np.int64)
        active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
        for a, b, valid, n in _stretches(lengths):
            for s in range(a, b, 64):
                z = slice(s, min(s + 64, b))
                starts, widths = m.intervals(ranks[z, :n], told[z, :n])
                for i, k in enumerate(active[z].tolist()):
                    unit = rng[:k] >> U64(TOTAL_BITS)
                    start = starts[i, :k] * unit
                    sums = low[:k] + start
                    over = (sums < start).nonzero()[0]  # a carry
                    low[:k] = sums
                    if len(over):
                        _carry(words, over, used[over] - 1)
                    np.multiply(unit, widths[i, :k], out=rng[:k])
                    full = (rng[:k] < TOP).nonzero()[0]
                    at = used[full]
                    words[full, at] = low[full] >> WORD
                    used[full] = at + 1
                    low[full] <<= WORD
                    rng[full] <<= WORD
            if b < steps:
                m.seen(ranks[a:b, :n], told[a:b, :n], valid)
        words[np.arange(live), used], words[np.arange(live), used + 1] = low >> WORD, low & (TOP - U64(1))
        used += 2
        payload[:live] = [words[j, : used[j]].astype("<u4").tobytes() for j in range(live)]
    return [_frame(*x) for x in zip(blocks, kinds, payload, strict=True)]


def _carry(words: np.ndarray, lane: np.ndarray, at: np.ndarray) -> None:
    while len(lane):
        words[lane, at] += np.uint32(1)
        on = words[lane, at] == 0
        lane, at = lane[on], at[on] - 1


def _frame(ids: np.ndarray, kinds: np.ndarray, payload: bytes) -> bytes:
    head = _varints(np.diff(kinds.astype(np.int64), prepend=0))
    body = struct.pack("<IIII", len(ids), len(kinds), len(payload), zlib.crc32(ids.astype("<u4").tobytes())) + head + payload
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; BlockError if one is damaged."""
    parsed = [_parse(b) for b in blocks]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for some in _by_length([p[0] for p in parsed]):
        some = [i for i in some if parsed[i][0]]
        try:
            for i, x in zip(some, _decode([parsed[i] for i in some]) if some else [], strict=True):
                out[i] = x
        except IndexError as e:
            raise BlockError("a number is out of range") from e
    for x, p in zip(out, parsed, strict=True):
        if zlib.crc32(x.astype("<u4").tobytes()) != p[3]:
            raise BlockError("ids differ from their checksum")
    return out


def _parse(data: bytes) -> tuple[int, np.ndarray, np.ndarray, int]:
    if data[:5] != MAGIC or len(data) < 25:
        raise BlockError("not a block")
    if zlib.crc32(data[5:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise BlockError("bytes differ from their checksum")
    n, k, size, crc = struct.unpack_from("<IIII", data, 5)
    gaps, at = _read_varints(data, k, 21)
    return n, np.cumsum(gaps).astype(np.uint32), np.frombuffer(data, "<u4", size // 4, at), crc


def _decode(blocks: list[tuple[int, np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    lengths = np.array([b[0] for b in blocks])
    steps, live = int(lengths[0]), len(blocks)
    m = _Model(np.array([len(b[1]) for b in blocks]), True)
    words = np.zeros((live, max(len(b[2]) for b in blocks) + 4), np.uint32)
    for j, b in enumerate(blocks):
        words[j, : len(b[2])] = b[2]
    flat, by_word = words.reshape(-1), np.arange(live) * words.shape[1]
    x, rng, used = words[:, 0].astype(U64) << WORD | words[:, 1], np.full(live, 2**64 - 1, U64), np.full(live, 2)
    ranks = np.zeros((steps, live), np.uint16)
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    for a, b, valid, n in _stretches(lengths):
        said = np.zeros((b - a, n), np.uint16)
        for s in range(a, b):
            k = int(active[s])
            m.predict(k)
            unit = rng[:k] >> U64(TOTAL_BITS)
            t = (x[:k] // unit).astype(np.int32)
            r, start, width = m.find(t, k)
            ranks[s, :k] = r
            x[:k] -= unit * start
            np.multiply(unit, width, out=rng[:k])
            said[s - a, :k] = m.learn(r, k)
            i = (rng[:k] < TOP).nonzero()[0]
            at = used[i]
            x[i] = x[i] << WORD | flat.take(by_word[i] + at)
            used[i] = at + 1
            rng[i] <<= WORD
        if b < steps:
            m.seen(ranks[a:b, :n], said, valid)
    return [b[1].take(r[: b[0]]) for b, r in zip(blocks, np.ascontiguousarray(ranks.T), strict=True)]
