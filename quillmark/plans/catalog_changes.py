"""Queries over two snapshots of documents: what changed, renames, SimHash, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import corpora
from ..catalog import query
from ..functions import hashing
from ..operators import changes, patches
from ..session import materialize

PREV, CURR = corpora.duck("prev"), corpora.duck("curr")
BASE = f"""prev AS ({PREV}), curr AS ({CURR}),
c AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS op,
    a.hash AS hash_before, b.hash AS hash_after, a.lines AS lines_before, b.lines AS lines_after FROM prev a FULL JOIN curr b ON a.path = b.path),
removed0 AS (SELECT path, hash_before AS hash, lines_before AS lines FROM c WHERE op = 'removed'),
added0 AS (SELECT path, hash_after AS hash, lines_after AS lines FROM c WHERE op = 'added'),
r AS (SELECT a.path AS from_path, b.path AS to_path, a.hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM removed0) a JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM added0) b ON a.hash = b.hash AND a.k = b.k),
removed AS (SELECT * FROM removed0 WHERE path NOT IN (SELECT from_path FROM r)),
added AS (SELECT * FROM added0 WHERE path NOT IN (SELECT to_path FROM r))"""
CANDIDATES = "cand AS (SELECT a.path AS from_path, b.path AS to_path, a.hash AS from_hash, b.hash AS to_hash, a.lines AS from_lines, b.lines AS to_lines FROM removed a, added b WHERE a.hash <> b.hash AND (a.lines = 0 OR b.lines = 0 OR greatest(a.lines, b.lines) <= 2 * least(a.lines, b.lines)))"
DELTA = """delta AS (SELECT 'added' AS op, path, NULL AS from_path, NULL AS hash_before, hash AS hash_after FROM added
UNION ALL SELECT 'removed', path, NULL, hash, NULL FROM removed
UNION ALL SELECT 'changed', path, NULL, hash_before, hash_after FROM c WHERE op = 'changed'
UNION ALL SELECT 'renamed', to_path, from_path, hash, hash FROM r)"""


def _fnv(token: str) -> str:
    return f"list_reduce(list_prepend({hashing.FNV_START}::UHUGEINT, list_transform(string_split({token}, ''), lambda ch: ascii(ch)::UHUGEINT)), lambda h, ch: (xor(h, ch) * {hashing.FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def simhash_sql(source: str) -> str:
    """CTEs that end in sim (key, simhash as 16 hex digits, bits)."""
    lanes = ", ".join(f"sum(CASE WHEN (h // {1 << i}::UHUGEINT) % 2 = 1 THEN n ELSE -n END) >= 0 AS b{i}" for i in range(64))
    high = " + ".join(f"coalesce(b{32 + i}, true)::BIGINT * {1 << i}" for i in range(32))
    low = " + ".join(f"coalesce(b{i}, true)::BIGINT * {1 << i}" for i in range(32))
    return f"""src AS ({source}),
tok AS (SELECT key, token, count(*) AS n FROM (SELECT key, unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS token FROM src) WHERE token <> '' GROUP BY ALL),
voc AS (SELECT token, {_fnv('token')} AS h FROM (SELECT DISTINCT token FROM tok)),
votes AS (SELECT key, {lanes} FROM tok JOIN voc USING (token) GROUP BY key),
halves AS (SELECT src.key, ({high})::BIGINT AS hi, ({low})::BIGINT AS lo FROM src LEFT JOIN votes USING (key)),
sim AS (SELECT key, hi, lo, printf('%08x%08x', hi, lo) AS simhash FROM halves)"""


def _both(spark, d):
    return corpora.corpus(spark, d, "prev"), corpora.corpus(spark, d, "curr")


def _sides(spark, d):
    c = changes.classify(*_both(spark, d))
    removed, added = changes.sides(c)
    return changes.without_renamed(removed, added, changes.exact_renames(removed, added))


@query("delta_classify", f"WITH {BASE} SELECT * FROM c")
def delta_classify(spark, d):
    return changes.classify(*_both(spark, d))


@query("delta_exact_renames", f"WITH {BASE} SELECT * FROM r")
def delta_exact_renames(spark, d):
    return changes.exact_renames(*changes.sides(changes.classify(*_both(spark, d))))


@query("delta_full", f"WITH {BASE}, {DELTA} SELECT * FROM delta")
def delta_full(spark, d):
    return changes.delta(*_both(spark, d))


@query("delta_summary_counts", f"WITH {BASE}, {DELTA} SELECT op, count(*) AS n FROM delta GROUP BY op")
def delta_summary_counts(spark, d):
    return changes.delta(*_both(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


@query("delta_rename_candidates", f"WITH {BASE}, {CANDIDATES} SELECT * FROM cand")
def delta_rename_candidates(spark, d):
    return changes.rename_candidates(*_sides(spark, d))


@query("simhash_documents", f"WITH {simhash_sql('SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL')} SELECT key AS doc_id, simhash FROM sim")
def simhash_documents(spark, d):
    docs = corpora.table(spark, d, "documents").where("text is not null")
    return hashing.simhash(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), hashing.hex16(F.col("simhash")).alias("simhash"))


PAIRS = f"""WITH {BASE}, {CANDIDATES}, {simhash_sql("SELECT 'a' || path AS key, text FROM prev UNION ALL SELECT 'b' || path, text FROM curr")},
pairs AS (SELECT from_path, to_path, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::INT AS distance FROM cand JOIN sim x ON x.key = 'a' || from_path JOIN sim y ON y.key = 'b' || to_path WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= {changes.RENAME_DISTANCE})"""


def _hashed_sides(spark, d):
    """Removed and added files, and the SimHashes of their texts."""
    prev, curr = _both(spark, d)
    removed, added = map(materialize, _sides(spark, d))
    old = hashing.simhash(prev.join(removed.select("path"), "path", "left_semi"), "path", "text").withColumnRenamed("id", "path")
    new = hashing.simhash(curr.join(added.select("path"), "path", "left_semi"), "path", "text").withColumnRenamed("id", "path")
    return removed, added, old, new


@query("simhash_rename_pairs", PAIRS + " SELECT * FROM pairs")
def simhash_rename_pairs(spark, d):
    return changes.similar_pairs(*_hashed_sides(spark, d))


@query(
    "simhash_greedy_renames",
    PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, o AS (SELECT *, row_number() OVER (ORDER BY to_path, distance, from_path) AS k FROM pairs),
g(k, froms, tos, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false UNION ALL
    SELECT o.k, CASE WHEN list_contains(froms, from_path) OR list_contains(tos, to_path) THEN froms ELSE list_append(froms, from_path) END,
        CASE WHEN list_contains(froms, from_path) OR list_contains(tos, to_path) THEN tos ELSE list_append(tos, to_path) END, NOT (list_contains(froms, from_path) OR list_contains(tos, to_path))
    FROM g JOIN o ON o.k = g.k + 1)
SELECT from_path, to_path, distance FROM o JOIN g USING (k) WHERE taken""",
)
def simhash_greedy_renames(spark, d):
    return changes.greedy_similar(*_hashed_sides(spark, d))


@query("changed_unified_patches")
def changed_unified_patches(spark, d):
    prev, curr = _both(spark, d)
    changed = changes.classify(prev, curr).where("op = 'changed'")
    return patches.make_patches(patches.patch_inputs(changed, prev.select("hash", "text").dropDuplicates(["hash"]), curr))


@query("oversize_diff_count", f"WITH {BASE} SELECT count(*) FILTER (WHERE strlen(a.text) + strlen(b.text) > 4000) AS n FROM prev a JOIN curr b ON a.path = b.path WHERE a.hash <> b.hash")
def oversize_diff_count(spark, d):
    prev, curr = _both(spark, d)
    changed = changes.classify(prev, curr).where("op = 'changed'")
    p = patches.make_patches(patches.patch_inputs(changed, prev.select("hash", "text").dropDuplicates(["hash"]), curr), patches.DiffOptions(max_bytes=4000))
    return p.agg(F.count_if("oversize").alias("n"))


FLAT = r"""coalesce(nullif(regexp_replace(regexp_replace(path, '[/\\:*?"<>|]', '_', 'g'), '^[._]+', ''), ''), 'patch')"""
#: Paths whose flat names clash, some with equal contents: digits go, and one of two characters that become the same stands before the last segment.
CLASH = "regexp_replace(path, '/d[0-9]*([0-9])[0-9]*[.]', CASE WHEN length(text) % 2 = 0 THEN ':' ELSE '?' END || 'd.')"


@query(
    "patch_names",
    f"""WITH {BASE}, x AS (SELECT path, min(hash) AS hash FROM (SELECT {CLASH} AS path, CASE WHEN lines % 2 = 0 THEN 'feedbeef' WHEN lines % 5 = 0 THEN '' ELSE hash END AS hash FROM curr) GROUP BY path),
b AS (SELECT path, coalesce(nullif(hash[1:8], ''), sha256(path)[1:8]) AS h, {FLAT} AS base FROM x),
i AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS i FROM b),
j AS (SELECT *, row_number() OVER (PARTITION BY base, h, i > 1 ORDER BY path) AS j FROM i)
SELECT path, CASE WHEN i = 1 THEN base || '.patch' WHEN j = 1 THEN base || '-' || h || '.patch' ELSE base || '-' || h || '-' || sha256(base || h)[1:8] || '.patch' END AS name FROM j""",
)
def patch_names(spark, d):
    curr = corpora.corpus(spark, d, "curr").select(F.expr(CLASH).alias("path"), F.expr("CASE WHEN lines % 2 = 0 THEN 'feedbeef' WHEN lines % 5 = 0 THEN '' ELSE hash END").alias("hash"))
    return patches.patch_names(curr.groupBy("path").agg(F.min("hash").alias("hash")))


@query("diff_inputs", f"WITH {BASE} SELECT b.path, a.text AS old, b.text AS new FROM prev a JOIN curr b ON a.path = b.path WHERE a.hash <> b.hash")
def diff_inputs(spark, d):
    prev, curr = _both(spark, d)
    changed = changes.classify(prev, curr).where("op = 'changed'")
    return patches.patch_inputs(changed, prev.select("hash", "text").dropDuplicates(["hash"]), curr)
