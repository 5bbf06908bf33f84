"""The thin queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, table, until_exit
from . import decontaminate, licenses, ordermin, packing, preferences, suffixes, tokenfile, toxicity, urls, vectors

WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(packing.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))
    return p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    until_exit(spark, path)
    return tokenfile.read_tokens(spark, path)


def op3_minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ordermin.near_texts(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "class_id", "n_kmers", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.pairs_from_conversations(table(spark, sf_dir, "conversations")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    r = suffixes.repeats(docs).select("doc_id", "text_key", gone.alias("gone"), F.size("spans").cast("long").alias("n"), F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    j = base.join(r, ["doc_id", "text_key"], "left")
    return j.select("doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return r.select(F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    s = toxicity.score(docs, net)
    return s.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    phrases = ", ".join(f"({_sql_text(p)}, {_sql_text(label)})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({_sql_text(label)}, {_sql_text(t)}, {licenses.need(t)})" for label, t in licenses.TEMPLATES.items())
    size = licenses.block_size(licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {LOWER_SQL.format('text')} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD_SQL}') AS w FROM d),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)::BIGINT - len(p)::BIGINT + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS i
    FROM w, phrases WHERE list_has_all(w, p)),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, unnest(CASE WHEN len(w) > {2 * size} THEN list_transform(range(0, len(w)::BIGINT - {size}, {size}), lambda s: w[s + 1 : s + {2 * size}]) ELSE [w] END) AS b FROM w WHERE len(w) > 0),
templates AS (SELECT label, list_distinct(string_split(t, ' ')) AS tokens, need FROM (VALUES {templates}) v(label, t, need)),
met AS (SELECT doc_id, label, len(list_intersect(b, tokens)) / len(tokens)::DOUBLE AS share FROM blocks, templates WHERE len(list_intersect(b, tokens)) >= need),
more AS (SELECT doc_id, list_distinct(list(label)) AS more, max(share) AS share FROM met GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    array_to_string(coalesce(base, []), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


def url_sql() -> str:
    rules = ", ".join(f"({_sql_text(r.action)}, {_sql_text(r.host)}, {_sql_text(r.path)})" for r in urls.RULES)
    return f"""
WITH rules AS (SELECT * FROM (VALUES {rules}) v(action, r_host, r_path)),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT host, path, arg_max(r_host || r_path, [length(r_host || r_path), length(r_path), (action = 'block')::INT]) AS rule,
    arg_max(action, [length(r_host || r_path), length(r_path), (action = 'block')::INT]) AS action
    FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path"""


PREFERENCE_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS cut FROM c WHERE role = 'assistant' GROUP BY conv_id),
answers AS (SELECT conv_id, cut, max(text) AS answer FROM last JOIN c USING (conv_id) WHERE c.turn = cut AND role = 'assistant' GROUP BY conv_id, cut),
pairs AS (SELECT a.conv_id // 2 AS pair_id, a.conv_id, a.cut, b.answer FROM answers a JOIN answers b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
chosen AS (SELECT pair_id, turn, min(struct_pack(role := role, text := text)) AS x FROM c JOIN pairs USING (conv_id) GROUP BY ALL),
rejected AS (SELECT pair_id, turn, min(x) AS x FROM (
    SELECT pair_id, turn, struct_pack(role := role, text := text) AS x FROM c JOIN pairs USING (conv_id) WHERE turn < cut
    UNION ALL SELECT pair_id, cut, struct_pack(role := 'assistant', text := answer) FROM pairs) GROUP BY ALL),
a AS (SELECT coalesce(k.pair_id, r.pair_id) AS pair_id, coalesce(k.turn, r.turn) AS turn, k.x AS c, r.x AS r FROM chosen k FULL JOIN rejected r ON k.pair_id = r.pair_id AND k.turn = r.turn),
cut AS (SELECT pair_id, min(turn) FILTER (WHERE c IS NULL OR r IS NULL OR c <> r) AS cut FROM a GROUP BY pair_id),
s AS (SELECT pair_id, turn, cut IS NULL OR turn < cut AS shared, c IS NOT NULL AS in_c, r IS NOT NULL AS in_r,
    '<|' || c.role || '|>' || chr(10) || c.text || '<|end|>' || chr(10) AS cs, '<|' || r.role || '|>' || chr(10) || r.text || '<|end|>' || chr(10) AS rs,
    (length(c.role) + 5) || ':' || (length(c.text) + 8) || ':' || (c.role = 'assistant')::INT AS cm, (length(r.role) + 5) || ':' || (length(r.text) + 8) || ':' || (r.role = 'assistant')::INT AS rm
    FROM a JOIN cut USING (pair_id))
SELECT pair_id, count(*) FILTER (WHERE shared) AS n_prompt_turns, coalesce(string_agg(cs, '' ORDER BY turn) FILTER (WHERE shared), '') AS prompt,
    coalesce(string_agg(cs, '' ORDER BY turn) FILTER (WHERE NOT shared AND in_c), '') AS chosen, count(*) FILTER (WHERE NOT shared AND in_c) AS n_chosen_turns, coalesce(string_agg(cm, ',' ORDER BY turn) FILTER (WHERE NOT shared AND in_c), '') AS chosen_mask,
    coalesce(string_agg(rs, '' ORDER BY turn) FILTER (WHERE NOT shared AND in_r), '') AS rejected, count(*) FILTER (WHERE NOT shared AND in_r) AS n_rejected_turns, coalesce(string_agg(rm, ',' ORDER BY turn) FILTER (WHERE NOT shared AND in_r), '') AS rejected_mask
FROM s GROUP BY pair_id"""

DECONTAMINATION_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format('text')}, '{WORD_SQL}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL.format('text')}, '{WORD_SQL}') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW})::BIGINT AS size FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(0, len(w)::BIGINT - size + 1), lambda i: array_to_string(w[i + 1 : i + size], ' '))) AS gram FROM s),
sizes AS (SELECT DISTINCT size FROM grams),
windows AS (SELECT doc_id, size, unnest(range(0, len(w)::BIGINT - size + 1)) AS i, w FROM w, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, i, windows.size, item_id FROM windows JOIN grams ON windows.size = grams.size AND array_to_string(w[i + 1 : i + windows.size], ' ') = gram),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op2_token_files": op2_token_files, "op3_minhash_duplicates": op3_minhash_duplicates, "op4_license_scan": op4_license_scan, "op5_url_filter": op5_url_filter, "op6_chat_preferences": op6_chat_preferences, "op7_suffix_dedup": op7_suffix_dedup, "op8_embedding_duplicates": op8_embedding_duplicates, "op9_decontamination": op9_decontamination, "op10_toxicity": op10_toxicity}
ORACLES = {"op4_license_scan": license_sql(), "op5_url_filter": url_sql(), "op6_chat_preferences": PREFERENCE_SQL, "op9_decontamination": DECONTAMINATION_SQL}
