"""A training-data pipeline over ``documents``: five stages, each an operator of quillmark.llm.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, ordermin, packing, suffixes, toxicity
from quillmark.llm.common import fresh
from quillmark.llm.queries import tokenizer_path
from quillmark.session import materialize, table


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text, where it was not null."""
    if {"text", "n_chars"} <= set(docs.columns):
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))))
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones that are not held out, scores at the threshold or higher go."""
    net = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "_q_score")
    return toxicity.score(docs, net, name=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document of the smallest id stays."""
    return ordermin.drop_near_texts(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that a document of a smaller id has are cut out; every document stays, if with an empty text."""
    return _like(docs, suffixes.remove_repeats(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in benchmark windows go; from others the hit words are cut out."""
    return _like(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of all documents, in sequences of at most 1,024 tokens."""
    return packing.pack(packing.encode_pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Networks, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
