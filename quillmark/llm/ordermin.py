"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word k-mers (A-Z lower-cased), each labelled with its occurrence (first, second, ...), so that no element
comes twice. A sketch has SKETCHES values; each is the hash of the TUPLE labelled k-mers that are smallest under its own
hash function, in the order in which they stand in the text: reordered texts differ in it. Texts that share a value are candidates.

Verified similarity: m / (n1 + n2 - m), where m is the length of the longest common subsequence of the two sequences. As elements are
distinct it is a longest increasing run of matched positions, and at similarity s the positions of a match differ by at
most (n1 + n2) (1 - s) / (1 + s), the band. Texts of 0.8 share a value of a sketch with probability 1 - (1 - 0.8^3)^24, all but 3e-8.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .bytetools import U64, mix, runs, word_hashes
from .common import fresh
from .components import components

K = 5
SIMILARITY = 0.8
SKETCHES, TUPLE = 24, 3
#: Buckets of up to FEW members give pairs; larger ones are cut into blocks of about BLOCK_KMERS k-mers and BLOCK_TEXTS texts.
FEW, BLOCK_KMERS, BLOCK_TEXTS = 8, 400_000, 1024
_SEEDS = np.random.default_rng(77).integers(1, 2**63, SKETCHES, dtype=U64)
_ORDER = np.random.default_rng(78).integers(1, 2**63, TUPLE, dtype=U64) | U64(1)
_PLACE = np.random.default_rng(79).integers(1, 2**63, K, dtype=U64) | U64(1)


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of one text's word hashes, labelled by occurrence; of fewer words than k all make one. No words: none."""
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    if n < k:
        words = np.concatenate([words, np.zeros(k - n, U64)])
        n = k
    h = np.zeros(n - k + 1, U64)
    for j in range(k):
        h += words[j : n - k + 1 + j] * _PLACE[j % K]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.concatenate(([False], s[1:] == s[:-1]))
    if again.any():
        at = np.arange(len(s))
        label = np.zeros(len(s), U64)
        label[order] = (at - np.maximum.accumulate(np.where(again, 0, at))).astype(U64)
        h = np.where(label > 0, mix(h + label * U64(0xD6E8FEB86659FD93)), h)
    return h


def sketch(elements: np.ndarray, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """The values, as signed 64-bit; of fewer elements than ``size`` all are taken."""
    v = mix(elements[None, :] ^ _SEEDS[:sketches, None])
    if len(elements) > size:
        pick = np.sort(np.argpartition(v, size - 1, axis=1)[:, :size], axis=1)
    else:
        pick = np.broadcast_to(np.arange(len(elements)), (sketches, len(elements)))
    return mix((elements[pick] * _ORDER[: pick.shape[1]]).sum(axis=1, dtype=U64) ^ _SEEDS[:sketches]).view(np.int64)


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two sequences of distinct elements if it is ``similarity`` or more; else a number below it."""
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    need = n * similarity / (1 + similarity) - 1e-9  # matches that the threshold takes
    if min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = np.abs(i - j) <= n - 2 * need + 1
    j = j[near]
    m = len(j)
    if m >= need and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        m = len(tails)
    return m / (n - m)


_SKETCHED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> DataFrame:
    """(id, n, content, sketch): number of k-mers, 128-bit hash of the word sequence, sketch values; without words no sketch and the hash of the bytes, of null texts null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in runs(batch.column(1)):
                h, _, _, by_text = word_hashes(data, at)
                rows = []
                present = batch.column(1).slice(a, b - a).is_valid().to_pylist()
                for i, w in enumerate(np.split(h, by_text[1:-1])):
                    e = kmers(w, k)
                    if len(e):
                        rows.append((len(e), hashlib.blake2b(w.tobytes(), digest_size=16).digest(), sketch(e, sketches, size).tolist()))
                    else:
                        raw = data[at[i] : at[i + 1]].tobytes()
                        rows.append((0, hashlib.blake2b(raw, digest_size=16, person=b"no words").digest() if present[i] else None, []))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t.type) for c, t in zip(cols, list(_SKETCHED)[1:], strict=True))], schema=_SKETCHED)

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, n long, content binary, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """Of pairs (a, b) those that are similar; texts: (id, text) of all that occur, each once."""
    p = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequences(column: pa.Array) -> Iterator[np.ndarray]:
            for _, _, data, at in runs(column):
                h, _, _, by_text = word_hashes(data, at)
                for w in np.split(h, by_text[1:-1]):
                    yield kmers(w, k)

        for batch in batches:
            ok = [alignment(x, y, similarity) >= similarity for x, y in zip(sequences(batch.column(2)), sequences(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return p.select("a", "b", "_ta", "_tb").mapInArrow(each, "a long, b long")


def _links_in_blocks(many: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """Links (a, b) that connect what is connected, of buckets (bucket, rep, component, blocks): each pair of a bucket's blocks is a group."""
    d = many.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    d = d.select("bucket", "rep", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"))
    d = d.join(texts.select(F.col("id").alias("rep"), "text"), "rep")

    def linked(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rep")
        seqs = []
        for _, _, data, at in runs(pa.array(df["text"], pa.large_string())):
            h, _, _, by_text = word_hashes(data, at)
            seqs += [kmers(w, k) for w in np.split(h, by_text[1:-1])]
        return _forest(df["rep"].to_numpy(), df["component"].to_numpy(), df["side"].to_numpy(), seqs, similarity)

    return d.groupBy("bucket", "i", "j").applyInPandas(linked, "a long, b long")


def _forest(ids: np.ndarray, components: np.ndarray, side: np.ndarray, seqs: list[np.ndarray], similarity: float) -> pd.DataFrame:
    n = np.array([len(s) for s in seqs])
    doc, element = np.repeat(np.arange(len(seqs)), n), np.concatenate(seqs)
    _, code, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    doc, code = doc[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    width = int(code[-1]) + 1 if len(code) else 0
    common = np.zeros((len(seqs), len(seqs)), np.float32)
    for a in range(0, width, 4096):  # elements that two texts have, some thousand at a time
        lo, hi = np.searchsorted(code, [a, a + 4096])
        x = np.zeros((len(seqs), min(4096, width - a)), np.float32)
        x[doc[lo:hi], code[lo:hi] - a] = 1
        common += x @ x.T
    need = (n[:, None] + n[None, :]) * (similarity / (1 + similarity)) - 1e-6
    maybe = common >= need
    if (side > 0).any():
        maybe &= side[:, None] != side[None, :]
    root = np.unique(components, return_inverse=True)[1]
    links = []
    for i in range(len(seqs)):
        for j in np.flatnonzero(maybe[i, :i]):
            if root[i] != root[j] and alignment(seqs[i], seqs[j], similarity) >= similarity:
                links.append((ids[j], ids[i]))
                root[root == root[i]] = root[j]
    return pd.DataFrame(links, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})


def near_texts(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, class_id, n_words_kmers): one row per distinct id; class_id is the smallest id of its class.

    Texts of the same words in the same order are copies; classes are the connected components of copies and similar pairs. First
    each bucket's smallest id is held against the others. Then, in buckets whose members are still of several components, all
    pairs from different components are: within a component no pair could change the result. Buckets of over FEW members are
    compared in blocks of a stated size, which give a forest of links instead of pairs. Texts without words are copies if
    their bytes are the same; null texts are classes of their own. Rows with a null id are left out; of rows that repeat an id the one of the smallest
    content counts. Other columns are ignored.
    """
    all_rows = sketched(docs, id_col, text_col, k, sketches).groupBy("id").agg(F.min(F.struct("content", "n", "sketch")).alias("x"))
    s = materialize(all_rows.select("id", "x.content", "x.n", "x.sketch"))
    copies = s.where("content is not null")
    firsts = materialize(copies.groupBy("content").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    rep_of = materialize(copies.select("id", "content").join(firsts.select("content", "rep"), "content").select("id", "rep"))
    # `distinct`: a value may come twice in a text
    buckets = firsts.select("rep", "n", F.explode("sketch").alias("bucket")).distinct()
    leads = buckets.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("members")).where("members > 1")
    members = materialize(buckets.join(leads.select("bucket", "lead"), "bucket"))
    pairs = members.where("lead <> rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    asked = members.select(F.col("rep").alias("id")).distinct()
    raw = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = materialize(raw.join(asked, "id").groupBy("id").agg(F.min("text").alias("text")))
    first = materialize(verified(pairs, texts, similarity, k))
    comp = components(first)
    m = materialize(members.select("bucket", "rep", "n").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component")))
    mixed = m.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"), F.sum("n").alias("total")).where("x <> y")
    few = m.join(mixed.where(F.col("members") <= FEW).select("bucket"), "bucket")
    x, y = few.alias("x"), few.alias("y")
    least = F.least("x.n", "y.n") * (1 + similarity) >= (F.col("x.n") + F.col("y.n")) * similarity - 1e-6
    more = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & least)
    more = more.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    many = m.join(mixed.where(F.col("members") > FEW).select("bucket", F.ceil(F.greatest(F.col("total") / BLOCK_KMERS, F.col("members") / BLOCK_TEXTS)).cast("int").alias("blocks")), "bucket")
    more_links = verified(more, texts, similarity, k).unionByName(_links_in_blocks(many, texts, similarity, k))
    second = materialize(more_links)
    if not second.isEmpty():
        comp = components(first.unionByName(second))
    for done in (firsts, members, texts, first, m, second):
        discard(done)
    classes = rep_of.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    return s.select("id", "n").join(classes, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.col("n").alias("n_kmers"))


def drop_near_texts(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id. All columns stay; rows with a null id stay too."""
    own = fresh(docs, "_q_id")
    gone = near_texts(docs, similarity, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col(id_col) == F.col(own), "left_anti")
