"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every token window.

All of it is DataFrame code. Documents are cut into words once: each gives a sentinel (so that its word count gets through)
and the 64-bit hash of each of its windows, of all sizes that items have; a hash join with the test windows keeps the few that may be
hits, which are then verified word by word. Only hits and sentinels are shuffled, and joined with the ids of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RAW_WORD, fresh, words

WINDOW = 13
#: Test windows up to this number (some 100 bytes each) are broadcast; beyond it the join shuffles by window hash.
MAX_BROADCAST_WINDOWS = 1_000_000


def test_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, gram, hash) of each distinct window of each item; an item of fewer words than ``window`` is one window.

    Items that are null or have no words give none.
    """
    w = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    w = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    g = w.select("item", "size", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.col("size")))).alias("g"))
    return g.select("item", "size", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("hash")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: id, text_key, n_words, spans (sorted, disjoint word ranges [start, end) that are hit), n_hit, items (sorted).

    Null and empty texts have no words and no hits. Repeated rows give a row each (``text_key`` is the text's hash). A null id is an id like
    any other. Other columns are ignored.
    """
    grams = test_windows(benchmark, window)
    n_grams, sizes = grams.agg(F.count("*"), F.sort_array(F.collect_set("size"))).first()  # at most `window` sizes
    side = F.broadcast(grams) if n_grams <= max_broadcast else grams
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("w"))
    hits = _windows(d, side, sizes or [window])
    hits = hits.groupBy("id", "text_key").agg(F.max("n").alias("n_words"), F.collect_set(F.when(F.col("pos") > 0, F.struct((F.col("pos") - 1).alias("s"), F.col("e")))).alias("raw"), F.collect_set("item").alias("items"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_words", _merged(F.col("raw")).alias("spans"), "items")
    j = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))).drop("hit_id", "hit_key")
    return j.withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]))


def _windows(d: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, text_key, n, pos, e, item): n words at pos 0 of each document, and its windows [pos - 1, e) that are an item's, of all sizes in one pass."""

    def hashes(size: int) -> Column:
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i, size)))

    # place 0 of each size's array stands for the document; it is never empty, and Spark would filter by its size, computing it twice
    e = d.select("id", "text_key", "w", F.posexplode_outer(F.array(*[hashes(n) for n in sizes])).alias("which", "hs"))
    e = e.select("id", "text_key", "w", "which", F.posexplode_outer(F.concat(F.array(F.lit(0).cast("long")), F.col("hs"))).alias("pos", "h"))
    e = e.withColumn("own_size", F.element_at(F.array(*map(F.lit, sizes)), F.col("which") + 1))
    j = e.join(grams, (F.col("h") == F.col("hash")) & (F.col("own_size") == F.col("size")) & (F.col("pos") > 0), "left")
    true_hit = F.col("gram") == F.array_join(F.slice(F.col("w"), F.greatest(F.col("pos"), F.lit(1)), F.col("own_size")), " ")
    j = j.where(true_hit | ((F.col("pos") == 0) & (F.col("which") == 0)))
    return j.select("id", "text_key", F.when(F.col("pos") == 0, F.size("w")).cast("long").alias("n"), "pos", (F.col("pos") - 1 + F.col("own_size")).alias("e"), "item")


def _merged(raw: Column) -> Column:
    """Union of ranges (s, e), as sorted disjoint (start, end)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["e"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["s"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("start"), x["e"].alias("end")))))

    def safe_step(acc: Column, x: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(F.struct(x["s"].alias("start"), x["e"].alias("end")))).otherwise(step(acc, x))

    return F.aggregate(F.array_sort(raw), empty, safe_step)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (a twentieth of the words or more is hit); from others the hit words are removed.

    A removed span goes with the separators between its words. Documents without hits stay as they are, nulls and empty
    texts too, whatever other columns there are.
    """
    own, key, spans, out = (fresh(docs, x) for x in ("_q_id", "_q_key", "_q_spans", "_q_out"))
    found = find_hits(docs, benchmark, window, id_col, text_col).where("n_hit > 0").dropDuplicates(["id", "text_key"])
    found = found.select(F.col("id").alias(own), F.col("text_key").alias(key), F.col("spans").alias(spans), contaminated(F.col("n_hit"), F.col("n_words")).alias(out))
    on = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(key))
    j = docs.join(found, on, "left").where(~F.coalesce(F.col(out), F.lit(False)))
    cut = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(without_spans(F.col(text_col), F.col(spans)))
    return j.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of the ranges, and without what separates the words of one range."""
    w, gaps = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.split(text, RAW_WORD, -1)
    kept = F.transform(w, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")).otherwise(x))
    joint = F.transform(gaps, lambda g, i: F.when(F.exists(spans, lambda s: (i > s["start"]) & (i < s["end"])), F.lit("")).otherwise(g))
    return F.array_join(F.transform(F.arrays_zip(joint.alias("g"), kept.alias("k")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["k"], F.lit("")))), "")
