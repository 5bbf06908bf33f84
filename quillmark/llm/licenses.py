"""License scan: base phrases, and an exact containment join of text blocks with license templates. DataFrame code only.

The join: the templates' tokens are ordered by their frequency in the corpus, rarest first. To hold ``need`` of a template's ``n`` tokens
a block must hold one of its first ``n - need + 1`` (prefix filter), at least ``need`` tokens of the templates' vocabulary (length
filter), and, from the place of the first common token on, enough tokens on both sides (positional filter). Candidates are verified.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label -> wording
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
THRESHOLD = 0.8
#: A plan has the vocabulary of up to so many templates.
MAX_TEMPLATES = 1000


def _strings(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def need(template: str, threshold: float = THRESHOLD) -> int:
    """Least number of the template's distinct words that a block must hold."""
    return max(1, math.ceil(threshold * len(set(template.split())) - 1e-9))


def block_size(templates: dict[str, str]) -> int:
    return max([len(t.split()) for t in templates.values()], default=1)


def blocks(w: Column, size: int) -> Column:
    """Word arrays of the text blocks: all words, or of over 2 x size words all windows of 2 x size words at steps of size.

    So each run of up to ``size`` words is within a block, across line breaks too.
    """
    starts = F.when(F.size(w) > 2 * size, F.sequence(F.lit(0), F.size(w) - size - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda s: F.slice(w, s + 1, 2 * size))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases; first_word and last_word are the smallest and largest word index at which one starts, or null.
    labels also has the templates that a block meets; score is 1 for a phrase, else the highest containment that meets the
    threshold, else 0. Null and empty texts have no words and no labels. Repeated rows stay as they are (text_key is the text's hash); a
    null id is an id like any other. Other columns are ignored. Templates go into a plan MAX_TEMPLATES at a time, each with a pass of its own.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, names = _base(d, phrases), list(templates)
    found = [_matches(d, {k: templates[k] for k in names[i : i + MAX_TEMPLATES]}, threshold) for i in range(0, len(names), MAX_TEMPLATES)]
    found = [x for x in found if x is not None]
    if found:
        met = reduce(DataFrame.unionByName, found).groupBy("id", "text_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
        met = met.select(F.col("id").alias("met_id"), F.col("text_key").alias("met_key"), "more", "share")
        base = base.join(met, F.col("id").eqNullSafe(F.col("met_id")) & (F.col("text_key") == F.col("met_key")), "left")
    else:
        base = base.withColumns({"more": F.array().cast("array<string>"), "share": F.lit(None).cast("double")})
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base.select("id", "text_key", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _base(d: DataFrame, phrases: dict[str, str]) -> DataFrame:
    w = F.col("w")

    def places(p: str) -> Column:
        parts = p.split()
        # a document without the first and the last word is done with after two scans of its words
        has = F.array_contains(w, parts[0]) & F.array_contains(w, parts[-1]) & (F.size(w) >= len(parts))
        at = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == x for k, x in enumerate(parts)])
        return F.when(has, F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), at)).otherwise(F.array().cast("array<int>"))

    d = d.select("id", "text_key", words(F.col("text")).alias("w"))
    d = d.select("id", "text_key", F.size("w").cast("long").alias("n_words"), *[places(p).alias(f"p{i}") for i, p in enumerate(phrases)])
    names = [f"p{i}" for i in range(len(phrases))]
    d = d.withColumn("all", F.concat(*names) if names else F.array().cast("array<int>"))
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values(), strict=True)]).cast("array<string>"), lambda x: x.isNotNull())))
    return d.select("id", "text_key", "n_words", F.size("all").cast("long").alias("n_base"), F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"), labels.alias("base"))


def _matches(d: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame | None:
    """(id, text_key, label, share) of each template that a block of the document meets."""
    tokens = {k: sorted(set(t.split())) for k, t in templates.items() if t.split()}
    if not tokens:
        return None
    vocabulary = sorted({x for t in tokens.values() for x in t})
    spoken = d.select(F.explode(F.array_intersect(words(F.col("text")), _strings(vocabulary))).alias("token"))
    frequency = {r["token"]: r["count"] for r in spoken.groupBy("token").count().collect()}  # at most the templates' vocabulary
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (frequency.get(x, 0), x)))}
    index = []
    for label, t in tokens.items():
        n, least = len(t), need(templates[label], threshold)
        for place, x in enumerate(sorted(t, key=rank.get)[: n - least + 1]):
            index.append((label, x, place, n, least, t))
    spark = d.sparkSession
    prefixes = spark.createDataFrame(index, "label string, token string, place int, n int, need int, tokens array<string>")
    first = sorted({x[1] for x in index})
    order = F.create_map(*[F.lit(y) for x, i in rank.items() for y in (x, i)])
    gated = d.select("id", "text_key", words(F.col("text")).alias("w")).where(F.arrays_overlap("w", _strings(first)))
    b = gated.select("id", "text_key", F.explode(blocks(F.col("w"), block_size(templates))).alias("b"))
    b = b.select("id", "text_key", F.array_intersect("b", _strings(vocabulary)).alias("b")).where(F.size("b") >= min(x[4] for x in index))  # length
    b = b.withColumn("b", F.transform(F.array_sort(F.transform("b", lambda x: F.struct(F.element_at(order, x).alias("rank"), x.alias("token")))), lambda x: x["token"]))
    at = b.select("id", "text_key", "b", F.posexplode("b").alias("i", "token"))
    c = at.join(F.broadcast(prefixes), "token").where("size(b) >= need and 1 + least(n - place - 1, size(b) - i - 1) >= need - least(place, i)")
    c = c.withColumn("common", F.size(F.array_intersect("b", "tokens"))).where("common >= need")
    return c.groupBy("id", "text_key", "label").agg(F.max(F.col("common") / F.col("n")).alias("share"))
