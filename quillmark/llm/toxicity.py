"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is the sum of an embedding of its hash bucket and the mean embedding of its byte trigrams, so unseen forms of a
stem are known too. Windows of ``WINDOW`` words at steps of half of that cover a text; its logit is that of its highest window.
Labels are of documents, so windows of toxic ones are chosen by their score while training (multiple-instance learning).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetools import runs, word_hashes

WINDOW, STRIDE = 64, 32
WORDS, TRIGRAMS, WIDTH, HIDDEN, ATTENTION = 1 << 15, 1 << 13, 16, 8, 8
#: The classifier is fitted on at most this many rows of each label, those of the smallest hash, of texts of at most SAMPLE_BYTES.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 2500, 40_000
STEPS, BATCH, RATE = 500, 96, 0.01
THRESHOLD = 0.3


@dataclass
class Inputs:
    """Distinct words (bucket, and the range of their trigrams), and each window as indices of words; -1 stands after its end."""

    bucket: np.ndarray
    trigrams: np.ndarray
    first: np.ndarray
    length: np.ndarray
    windows: np.ndarray
    text: np.ndarray  # of each window
    hash: np.ndarray


def prepare(data: np.ndarray, at: np.ndarray) -> Inputs:
    h, starts, ends, by_text = word_hashes(data, at)
    _, pick, index = np.unique(h, return_index=True, return_inverse=True)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    s, e = starts[pick], ends[pick]
    length = e - s
    first = np.cumsum(length) - length
    at_byte = np.arange(int(length.sum())) - np.repeat(first - s, length)
    before = np.where(at_byte == np.repeat(s, length), 1, low[at_byte - 1]) if len(at_byte) else at_byte
    after = np.where(at_byte == np.repeat(e - 1, length), 2, low[np.minimum(at_byte + 1, len(low) - 1)]) if len(at_byte) else at_byte
    tri = ((before * 65536 + low[at_byte] * 256 + after).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % TRIGRAMS if len(at_byte) else np.zeros(0, np.int64)
    n = np.diff(by_text)
    per = np.maximum(1, -(-(n - STRIDE) // STRIDE))
    text = np.repeat(np.arange(len(n)), per)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE
    begin, left = by_text[:-1][text] + place, n[text] - place
    cell = begin[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < left[:, None], np.append(index, 0)[np.minimum(cell, len(index))], -1)
    return Inputs((h[pick] % np.uint64(WORDS)).astype(np.int64), tri, first, length, windows.astype(np.int32), text, h[pick])


def joined(parts: list[Inputs]) -> Inputs:
    """The inputs of several runs as one; a word of several runs stands once."""
    h, pick, index = np.unique(np.concatenate([x.hash for x in parts]), return_index=True, return_inverse=True)
    words = np.cumsum([0, *(len(x.hash) for x in parts)])
    texts = np.cumsum([0, *(int(x.text[-1]) + 1 for x in parts)])  # each text has a window
    tri = np.cumsum([0, *(len(x.trigrams) for x in parts)])
    first, length = np.concatenate([x.first + t for x, t in zip(parts, tri, strict=False)])[pick], np.concatenate([x.length for x in parts])[pick]
    windows = np.concatenate([np.where(x.windows >= 0, index[x.windows + w], -1).astype(np.int32) for x, w in zip(parts, words, strict=False)])
    return Inputs(np.concatenate([x.bucket for x in parts])[pick], np.concatenate([x.trigrams for x in parts]), first, length, windows, np.concatenate([x.text + t for x, t in zip(parts, texts, strict=False)]), h)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters ``p`` (name -> float32 array); ``scale`` and ``shift`` calibrate a text's highest logit."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        n = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": np.zeros((WORDS, WIDTH), np.float32), "tri": (g.standard_normal((TRIGRAMS, WIDTH)) * 0.5).astype(np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": n(WIDTH, 3 * HIDDEN), f"{d}h": n(HIDDEN, 3 * HIDDEN), f"{d}c": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"ax": n(2 * HIDDEN, ATTENTION), "ac": np.zeros(ATTENTION, np.float32), "av": n(ATTENTION), "o": n(2 * HIDDEN), "oc": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def embed(self, x: Inputs, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some distinct words: inputs, the places of their trigrams, and how many they have."""
        n = x.length[words]
        first = np.cumsum(n) - n
        flat = x.trigrams[np.arange(int(n.sum())) - np.repeat(first - x.first[words], n)] if len(n) else np.zeros(0, np.int64)
        mean = np.add.reduceat(self.p["tri"][flat], first) / n[:, None].astype(np.float32) if len(n) else np.zeros((0, WIDTH), np.float32)
        return self.p["word"][x.bucket[words]] + mean, flat, n

    def logits(self, x: Inputs, which: np.ndarray | None = None, chunk: int = 1024) -> np.ndarray:
        """Of all windows, or of some."""
        words = np.arange(len(x.bucket))
        e = np.concatenate([self.embed(x, words[i : i + 50_000])[0] for i in range(0, len(words), 50_000)] or [np.zeros((0, WIDTH), np.float32)])
        wins = x.windows if which is None else x.windows[which]
        out = np.zeros(len(wins), np.float32)
        # the last row stands for the places after a window's end
        proj = {d: np.concatenate([e @ self.p[f"{d}x"] + self.p[f"{d}c"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}
        for i in range(0, len(wins), chunk):
            w = wins[i : i + chunk]
            out[i : i + chunk] = self._pool(self._run(proj["f"], w, "f"), self._run(proj["b"], w, "b"), w >= 0)[0]
        return out

    def _run(self, proj: np.ndarray, w: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, u, H = len(w), self.p[f"{d}h"], HIDDEN
        h, out = np.zeros((n, H), np.float32), np.zeros((WINDOW, n, H), np.float32)
        live = (w >= 0).astype(np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            a = proj[w[:, t]]
            b = h @ u
            zr = _sigmoid(a[:, : 2 * H] + b[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(a[:, 2 * H :] + r * b[:, 2 * H :])
            new = (c + z * (h - c)) * live[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c, b[:, 2 * H :]))
            h = out[t] = new
        return out

    def _pool(self, f: np.ndarray, b: np.ndarray, live: np.ndarray):
        h = np.concatenate([f, b], axis=2)  # WINDOW x n x 2 HIDDEN
        k = np.tanh(h @ self.p["ax"] + self.p["ac"])
        s = np.where(live.T, k @ self.p["av"], np.float32(-1e4))
        a = np.exp(s - s.max(axis=0)) * live.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, h)
        return pooled @ self.p["o"] + self.p["oc"][0], h, k, a, pooled

    def loss_gradient(self, x: Inputs, which: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray, np.ndarray]:
        """Mean log loss of windows, the gradients, and the rows of ``word`` and ``tri`` that they touch."""
        w, H, p = x.windows[which], HIDDEN, self.p
        words, index = np.unique(w[w >= 0], return_inverse=True)
        local = np.full(w.shape, -1)
        local[w >= 0] = index
        e, flat, lengths = self.embed(x, words)
        proj = {d: np.concatenate([e @ p[f"{d}x"] + p[f"{d}c"], np.zeros((1, 3 * H), np.float32)]) for d in "fb"}
        kept: dict[str, list] = {"f": [], "b": []}
        f, b = (self._run(proj[d], local, d, kept[d]) for d in "fb")
        live = local >= 0
        logit, h, k, a, pooled = self._pool(f, b, live)
        prob = _sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)))
        g = {n: np.zeros_like(v) for n, v in p.items() if n not in ("word", "tri")}
        dl = ((prob - y) / len(y)).astype(np.float32)
        g["o"], g["oc"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * p["o"]
        da = np.einsum("nh,tnh->tn", dp, h)
        ds = a * (da - (a * da).sum(axis=0))
        dh = a[:, :, None] * dp[None]
        g["av"] = np.einsum("tn,tna->a", ds, k)
        dk = ds[:, :, None] * p["av"] * (1 - k * k)
        g["ax"], g["ac"] = np.einsum("tnh,tna->ha", h, dk), dk.sum(axis=(0, 1))
        dh = dh + dk @ p["ax"].T
        de = np.zeros_like(e)
        for d, cut in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            carry, dproj = np.zeros((len(w), H), np.float32), np.zeros((len(e) + 1, 3 * H), np.float32)
            for t, h0, z, r, c, bc in reversed(kept[d]):
                dn = (dh[t][:, cut] + carry) * live[:, t, None]
                dc, dz = dn * (1 - z) * (1 - c * c), dn * (h0 - c) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                back = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"{d}h"] += h0.T @ back
                carry = dn * z + back @ p[f"{d}h"].T
                np.add.at(dproj, local[:, t], np.concatenate([dz, dr, dc], axis=1))
            dproj = dproj[:-1]
            g[f"{d}x"], g[f"{d}c"] = e.T @ dproj, dproj.sum(axis=0)
            de += dproj @ p[f"{d}x"].T
        rows, place = np.unique(x.bucket[words], return_inverse=True)
        g["word"] = np.zeros((len(rows), WIDTH), np.float32)
        np.add.at(g["word"], place, de)
        tri, place = np.unique(flat, return_inverse=True)
        g["tri"] = np.zeros((len(tri), WIDTH), np.float32)
        np.add.at(g["tri"], place, np.repeat(de / np.maximum(lengths, 1)[:, None], lengths, axis=0).astype(np.float32))
        return loss, g, rows, tri

    def scores(self, x: Inputs, texts: int) -> np.ndarray:
        top = np.full(texts, -np.inf, np.float64)
        np.maximum.at(top, x.text, self.logits(x).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5, share: float | None = None) -> Network:
    """Trains on whole texts with labels 0 and 1. ``share``: of label 1 where it is to be used, for the calibration.

    Without both labels the result is a constant: the share of label 1 (0 without any text).
    """
    net, labels = Network(), np.asarray(labels)
    share = float(labels.mean()) if share is None and len(labels) else share or 0.0
    if not len(labels) or labels.min() == labels.max():
        p = min(max(share if len(labels) else 0.0, 1e-6), 1 - 1e-6)
        net.scale, net.shift = 0.0, float(np.log(p / (1 - p)))
        return net
    g, m, v = np.random.default_rng(seed), {n: np.zeros_like(a) for n, a in net.p.items()}, {n: np.zeros_like(a) for n, a in net.p.items()}
    x = joined([prepare(data, at) for _, _, data, at in runs(pa.array(texts, pa.large_string()))])
    y = labels[x.text]
    toxic, clean = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    hard, best = clean, toxic
    for step in range(steps):
        if step and step % 60 == 0:  # of each toxic text its highest window, and the highest windows of clean ones
            top = net.logits(x, toxic)
            order = np.lexsort((-top, x.text[toxic]))
            lead = np.concatenate(([True], np.diff(x.text[toxic][order]) != 0))
            best = toxic[order][lead]
            some = g.choice(clean, min(len(clean), 20_000), replace=False)
            hard = some[np.argsort(-net.logits(x, some))[: max(200, len(some) // 50)]]
        pick = np.concatenate([g.choice(best, batch // 2), g.choice(clean, batch // 4), g.choice(hard, batch - batch // 2 - batch // 4)])
        _, grads, rows, tri = net.loss_gradient(x, pick, y[pick].astype(np.float32))
        lr = rate * min(1, (step + 1) / 20) * (1 if step < steps * 0.7 else 0.3)
        for name, d in grads.items():
            s = rows if name == "word" else tri if name == "tri" else slice(None)
            m[name][s] = 0.9 * m[name][s] + 0.1 * d
            v[name][s] = 0.99 * v[name][s] + 0.01 * d * d
            t = step + 1
            net.p[name][s] -= lr * (m[name][s] / (1 - 0.9**t)) / (np.sqrt(v[name][s] / (1 - 0.99**t)) + 1e-6)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, x.text, net.logits(x).astype(np.float64))
    weight = np.where(labels > 0, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # logistic regression on one number, held near the start by a small penalty
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        e, c = weight * (q - labels), weight * q * (1 - q)
        grad = np.array([(e * top).sum() + 0.1 * (a - 1), e.sum() + 0.01 * b])
        hess = np.array([[(c * top * top).sum() + 0.1, (c * top).sum()], [(c * top).sum(), c.sum() + 0.01]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    net.scale, net.shift = float(max(a, 0.05)), float(b)
    return net


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, most: int = SAMPLE_BYTES) -> tuple[pd.DataFrame, float]:
    """(text, toxic) of the bounded sample of labelled rows that may be learnt from, and the share of label 1 among all of those."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = known.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(clean)).distinct()
    rows = docs.select("doc_id", F.col("text").alias("_text")).where(F.col("_text").isNotNull() & (F.octet_length("_text") <= most)).join(F.broadcast(some), "doc_id")
    df = rows.select(F.col("doc_id"), F.col("_text").alias("text"), "toxic").toPandas().sort_values(["doc_id", "toxic", "text"]).head(2 * (toxic + clean))
    return df, counts.get(1, 0) / max(1, sum(counts.values()))


def train(docs: DataFrame, labels: DataFrame, **how) -> Network:
    df, share = sample(docs, labels)
    return fit(df["text"].tolist(), df["toxic"].to_numpy(), share=share, **how)


def score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: the score in (0, 1) of each whole text; null and empty texts get that of a text without words.

    A column of that name is replaced; all else stays, repeated rows too.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    model = docs.sparkSession.sparkContext.broadcast(net)  # some 3 MB, whatever the input
    schema = docs.select(*kept).schema.add(name, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(batch.schema.get_field_index(text_col))
            for a, b, data, at in runs(t, 1 << 20):
                s = model.value.scores(prepare(data, at), b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*batch.schema.names, name])

    return docs.select(*kept).mapInArrow(scored, schema)
