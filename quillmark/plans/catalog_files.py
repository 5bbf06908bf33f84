"""Queries over documents and pages as files: filters, fingerprints, budgets, names, slices, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import corpora
from ..catalog import query
from ..functions import hashing, paths
from ..operators import chat, checks, filters, patches, ranks, slices
from ..sources import bundles
from ..sources import lines as L
from .catalog_code import _lang_sql

TEXT, CURR, URLS = corpora.duck("text_files"), corpora.duck("curr"), corpora.URL_PATHS_DUCK
EXTENSIONS = (".go", ".html", ".Java")
PREFIXES = ("www", "es", "blog")
RULES = filters.ignore_rules("# comment\n*.html\n!**/1*.html\nfr/\n/m.*/de/\n**/9*\n!keep\n")
BUDGET = 300_000


def _files(spark, d):
    return corpora.corpus(spark, d, "text_files")


def _ignored_sql() -> str:
    def case(p: str, folder: bool) -> str:
        arms = " ".join(f"WHEN regexp_matches({p}, '{r.regex.replace(chr(39), chr(39) * 2)}') THEN {str(not r.negated).lower()}" for r in reversed(RULES) if folder or not r.folder_only)
        return f"(CASE {arms} ELSE false END)"

    above = "list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))"
    return f"({case(chr(39) + '.' + chr(39), True)} OR len(list_filter({above}, lambda p: {case('p', True)})) > 0 OR {case('path', False)})"


@query("content_hashes", f"SELECT path, hash, lines FROM ({TEXT})")
def content_hashes(spark, d):
    return _files(spark, d).select("path", "hash", "lines")


@query("bundle_id", f"SELECT sha256(coalesce(string_agg(path || ':' || hash || chr(10), '' ORDER BY path || ':' || hash || chr(10)), '')) AS bundle_id FROM ({CURR})")
def bundle_id(spark, d):
    return hashing.bundle_id(corpora.corpus(spark, d, "curr"))


@query("ext_filter", f"SELECT page_id, path FROM ({URLS}) WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.go', '.html', '.Java')")
def ext_filter(spark, d):
    return corpora.url_paths(spark, d).where(filters.has_extension(F.col("path"), EXTENSIONS))


@query("include_filter", f"SELECT page_id, path FROM ({URLS}) WHERE contains(lower(path), '/en/') OR contains(lower(path), 'net')")
def include_filter(spark, d):
    return corpora.url_paths(spark, d).where(filters.is_included(F.col("path"), ("/EN/", "net")))


@query("exclude_filter", f"SELECT page_id, path FROM ({URLS}) WHERE len(list_filter(string_split(path, '/'), lambda s: starts_with(s, 'www') OR starts_with(s, 'es') OR starts_with(s, 'blog'))) = 0")
def exclude_filter(spark, d):
    return corpora.url_paths(spark, d).where(~filters.is_excluded(F.col("path"), PREFIXES))


@query("ignore_filter", f"SELECT page_id, path, {_ignored_sql()} AS ignored FROM ({URLS})")
def ignore_filter(spark, d):
    return corpora.url_paths(spark, d).select("page_id", "path", filters.is_ignored(F.col("path"), RULES).alias("ignored"))


@query("size_filter", f"SELECT path, strlen(text) AS size FROM ({TEXT}) WHERE strlen(text) <= 2000")
def size_filter(spark, d):
    return _files(spark, d).select("path", F.octet_length("text").cast("long").alias("size")).where("size <= 2000")


@query("lang_tags", f"SELECT path, {_lang_sql()} AS lang FROM ({TEXT}) WHERE {_lang_sql()} IN ('go', 'py')")
def lang_tags(spark, d):
    return _files(spark, d).select("path", paths.lang_of(F.col("path")).alias("lang")).where("lang in ('go', 'py')")


@query("present_langs", f"""SELECT source, array_to_string(list_sort(list_distinct(list(tag))), ' ') AS langs FROM (
    SELECT source, CASE lower(regexp_extract(path, '[.]([^./]*)$', 1)) WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'tsx' WHEN 'py' THEN 'py' WHEN 'h' THEN 'cpp' WHEN 'cc' THEN 'cpp' END AS tag
    FROM (SELECT source, CASE doc_id % 6 WHEN 0 THEN path || 'x' WHEN 1 THEN path || '.TSX' WHEN 2 THEN path || '.h' WHEN 3 THEN path || '.js' ELSE path END AS path FROM ({TEXT}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id))) WHERE tag IS NOT NULL GROUP BY source""")
def present_langs(spark, d):
    s = corpora.table(spark, d, "documents").select("doc_id", "source")
    path = F.expr("CASE doc_id % 6 WHEN 0 THEN path || 'x' WHEN 1 THEN path || '.TSX' WHEN 2 THEN path || '.h' WHEN 3 THEN path || '.js' ELSE path END")
    f = _files(spark, d).join(s, "doc_id").select("source", path.alias("path"))
    return bundles.languages(f, "source").select("source", F.array_join("langs", " ").alias("langs"))


@query(
    "budget_pick",
    f"""WITH RECURSIVE o AS (SELECT path, strlen(text)::BIGINT AS size, row_number() OVER (ORDER BY string_split(path, '/')) AS k FROM ({TEXT})),
g(k, total, kept) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.k, CASE WHEN total < {BUDGET} AND total + size <= {BUDGET} THEN total + size ELSE total END, total < {BUDGET} AND total + size <= {BUDGET} FROM g JOIN o ON o.k = g.k + 1)
SELECT path, size FROM o JOIN g USING (k) WHERE kept""",
)
def budget_pick(spark, d):
    return chat.within_budget(_files(spark, d).select("path", F.octet_length("text").cast("long").alias("size")), BUDGET)


@query("walk_order", f"SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS k FROM ({TEXT})")
def walk_order(spark, d):
    return ranks.numbered(_files(spark, d).select("path"), [filters.walk_order(F.col("path"))])


@query("slices_chunked", f"SELECT path, 'chunk_' || start AS slice, start, least(start + 19, lines)::INT AS \"end\" FROM (SELECT path, lines, unnest(range(1, lines + 1, 20))::INT AS start FROM ({TEXT}) WHERE lines > 20)")
def slices_chunked(spark, d):
    return slices.slices(_files(spark, d).select("path", "lines"), None, 20)


@query(
    "path_functions",
    f"""WITH u AS (SELECT DISTINCT path AS p FROM ({URLS}) UNION SELECT './/' || replace(path, '/', '//') FROM ({URLS}) UNION SELECT 'C:' || chr(92) || '..' || chr(92) || path FROM ({URLS}))
SELECT p, regexp_replace(regexp_replace(replace(p, chr(92), '/'), '^\\./', ''), '/+', '/', 'g') AS normal,
    coalesce(nullif(regexp_replace(regexp_replace(p, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'anchor') AS slug,
    coalesce(nullif(regexp_replace(regexp_replace(p, '[/\\\\:*?"<>|]', '_', 'g'), '^[._]+', ''), ''), 'patch') AS patch, sha256(p)[1:8] AS short, sha256(p)[1:12] AS key,
    CASE WHEN regexp_replace(regexp_replace(p, '/?[^/]*$', ''), '^[/.]+|[/.]+$', '', 'g') = '' THEN 'main' ELSE regexp_extract(regexp_replace(regexp_replace(p, '/?[^/]*$', ''), '^[/.]+|[/.]+$', '', 'g'), '([^/]*)$', 1) END AS go_package,
    list_contains(string_split(p, '/'), '..') AS climbs, contains(p, '/test/') OR ends_with(p, '_test.go') AS is_test FROM u""",
)
def path_functions(spark, d):
    u = corpora.url_paths(spark, d).select("path").distinct()
    u = u.select(F.explode(F.array(F.col("path"), F.concat(F.lit(".//"), F.replace("path", F.lit("/"), F.lit("//"))), F.concat(F.lit("C:\\..\\"), "path"))).alias("p")).distinct()
    p = F.col("p")
    return u.select("p", paths.normal_path(p).alias("normal"), paths.slug(p).alias("slug"), paths.patch_base(p).alias("patch"), paths.short_hash(p).alias("short"), F.left(F.sha2(p.cast("binary"), 256), F.lit(12)).alias("key"), paths.go_package(p).alias("go_package"), paths.climbs(p).alias("climbs"), paths.is_test_path(p).alias("is_test"))


SAFE = "coalesce(nullif(list_reduce(list_prepend('', string_split(regexp_replace(replace({0}, chr(92), '/'), '^[A-Za-z]:', ''), '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END), ''), 'entry')"


@query(
    "zip_names",
    f"""WITH n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/../' || path WHEN 1 THEN 'c:' || chr(92) || 'a/./b.txt' ELSE '../x/../' || (page_id % 5) || '/n' END AS name FROM ({URLS})),
s AS (SELECT page_id, name, {SAFE.format('name')} AS safe FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY page_id) - 1 AS k FROM s)
SELECT page_id, name, CASE WHEN k = 0 THEN safe ELSE safe[1:length(safe) - length(regexp_extract(safe, '(\\.[^./]*)$', 1))] || '-' || k || regexp_extract(safe, '(\\.[^./]*)$', 1) END AS entry FROM k""",
)
def zip_names(spark, d):
    n = corpora.url_paths(spark, d).selectExpr("page_id", "case page_id % 3 when 0 then '/../' || path when 1 then 'c:' || chr(92) || 'a/./b.txt' else '../x/../' || (page_id % 5) || '/n' end as name")
    return patches.entry_names(n, "name", "page_id").select("page_id", "name", "entry")


BAD = f"""SELECT CASE WHEN doc_id % 17 = 0 THEN '/' || path WHEN doc_id % 19 = 0 THEN replace(path, '/', chr(92)) WHEN doc_id % 23 = 0 THEN 'a/../' || path WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 31 = 0 THEN 'twice' ELSE path END AS path,
    CASE WHEN doc_id % 7 = 0 THEN upper(hash) WHEN doc_id % 11 = 0 THEN '' ELSE hash END AS hash, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE lines END AS lines,
    CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'r' END AS name, CASE WHEN doc_id % 37 = 0 THEN 0 ELSE 1 END AS s, CASE WHEN doc_id % 41 = 0 THEN 9999 ELSE 1 END AS e FROM """


def _rules_sql(scope: str, rules: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{scope}' AS scope, path, '{name}' AS rule FROM {source} WHERE {cond}" for name, cond in rules)


_PATHS = [("path is empty", "path = ''"), ("path is absolute", "starts_with(path, '/')"), ("path has a backslash", "contains(path, chr(92))"), ("path climbs", "list_contains(string_split(path, '/'), '..')")]
MANIFEST = f"WITH m AS ({BAD} ({TEXT})) " + _rules_sql("file", [*_PATHS, ("hash is not 64 lower hex digits", "hash <> '' AND NOT regexp_full_match(hash, '[0-9a-f]{64}')"), ("lines below 1", "lines < 1")], "m")
MANIFEST += " UNION ALL SELECT 'file', path, 'path comes twice' FROM m GROUP BY path HAVING count(*) > 1 UNION ALL " + _rules_sql("region", [("region has no name", "trim(name) = ''"), ("region is out of range", "s < 1 OR e < s OR e > lines")], "m")


def _bad(spark, d):
    return spark.sql(BAD + "{files}", files=_files(spark, d))


@query("manifest_violations", MANIFEST)
def manifest_violations(spark, d):
    m = _bad(spark, d).select("path", "hash", "lines", F.array(F.struct("name", F.col("s").alias("start"), F.col("e").alias("end"))).alias("regions"))
    return checks.manifest_violations(m)


@query("symbol_violations", f"WITH m AS ({BAD} ({TEXT})) " + _rules_sql("symbol", [*_PATHS, ("symbol is blank", "trim(name) = ''"), ("range is wrong", "s < 1 OR e < s")], "m"))
def symbol_violations(spark, d):
    return checks.symbol_violations(_bad(spark, d).select(F.col("name").alias("symbol"), "path", F.col("s").alias("start"), F.col("e").alias("end")))


@query("order_violations", f"WITH o AS (SELECT doc_id, path, lag(path) OVER (ORDER BY doc_id) AS before FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, path FROM ({TEXT}))) SELECT doc_id, path FROM o WHERE path < before")
def order_violations(spark, d):
    rows = ranks.numbered(_files(spark, d).select("doc_id", "path"), [F.col("doc_id")]).select((F.col("k") - 1).alias("doc_id"), "path")
    return checks.out_of_order(rows, "doc_id", "path")


@query("toc_rows", f"SELECT '| ' || row_number() OVER (ORDER BY path) || ' | ' || path || ' | ' || lines || ' |' AS row FROM ({TEXT})")
def toc_rows(spark, d):
    return L.toc_rows(_files(spark, d)).select("row")


@query(
    "jsonl_slices",
    f"""SELECT '{{"path":"' || replace(replace(replace(path, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '","slice":"chunk_' || start || '","start":' || start || ',"end":' || least(start + 19, lines) || '}}' AS line
FROM (SELECT replace(path, 'src1', '<a&b>') AS path, lines, unnest(range(1, lines + 1, 20)) AS start FROM ({TEXT}) WHERE lines > 20)""",
)
def jsonl_slices(spark, d):
    f = _files(spark, d).select(F.replace("path", F.lit("src1"), F.lit("<a&b>")).alias("path"), "lines")
    return L.json_lines(slices.slices(f, None, 20), ["path", "slice", "start", "end"])


@query("text_functions", """SELECT turn, conv_id, CASE WHEN t <> '' AND NOT ends_with(t, chr(10)) THEN t || chr(10) ELSE t END AS fed, array_to_string(CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN i = len(string_split(t, chr(10))) THEN x ELSE x || chr(10) END) END, '|') AS pieces
FROM (SELECT turn, conv_id, regexp_replace(replace(text, ' ', CASE WHEN turn % 2 = 0 THEN chr(13) ELSE chr(13) || chr(10) END), '\\r\\n?', chr(10), 'g') AS t FROM conversations WHERE text IS NOT NULL)""")
def text_functions(spark, d):
    c = corpora.table(spark, d, "conversations").where("text is not null")
    c = c.withColumn("t", L.one_feed(F.replace("text", F.lit(" "), F.when(F.col("turn") % 2 == 0, F.lit("\r")).otherwise(F.lit("\r\n")))))
    return c.select("turn", "conv_id", L.fed(F.col("t")).alias("fed"), F.array_join(L.pieces(F.col("t")), "|").alias("pieces"))


_HEAD = """'# ' || path || chr(10) || CASE WHEN package <> '' OR class <> '' THEN '- Package: ' || coalesce(nullif(package, ''), '-') || chr(10) || '- Class: ' || coalesce(nullif(class, ''), '-') || chr(10) ELSE '' END
    || CASE WHEN len(exports) > 0 THEN '- Exports: ' || array_to_string(exports, ', ') || chr(10) ELSE '' END || chr(10) || '```' || CASE WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.ts') THEN 'ts' WHEN ends_with(path, '.py') THEN 'python' ELSE '' END || chr(10)"""
_FIELDS = "CASE WHEN doc_id % 2 = 0 THEN 'pkg.x' ELSE '' END AS package, CASE WHEN doc_id % 3 = 0 THEN 'T' ELSE '' END AS class"


@query(
    "chat_messages",
    f"""WITH m AS (SELECT path, text, {_FIELDS}, CASE WHEN doc_id % 5 = 0 THEN ['a', 'b'] WHEN doc_id % 5 = 1 THEN list_transform(range(0, 900), lambda i: 'é') ELSE [] END AS exports FROM ({TEXT})),
b AS (SELECT *, encode({_HEAD}) AS head, encode({_HEAD} || text) AS whole FROM m)
SELECT row_number() OVER (ORDER BY len(exports) > 0 DESC, contains(path, '/test/') OR ends_with(path, '_test.go'), path) AS message, path, octet_length(head)::INT AS head,
    sha256(CASE WHEN octet_length(head) < 2000 THEN array_slice(whole, 1, 2000) || encode(chr(10)) ELSE array_slice(whole, 1, 2000) END) AS body FROM b""",
)
def chat_messages(spark, d):
    """Headers of all kinds, and some that alone fill the message."""
    exports = F.expr("CASE WHEN doc_id % 5 = 0 THEN array('a', 'b') WHEN doc_id % 5 = 1 THEN array_repeat('é', 900) ELSE cast(array() AS array<string>) END")
    m = _files(spark, d).selectExpr("*", *_FIELDS.split(", ")).withColumn("exports", exports).select("path", "text", "package", "class", "exports")
    files = chat.ranked(m, degree=spark.createDataFrame([], "id string, degree long"))
    return files.select("path", F.col("rank").cast("long").alias("message"), F.octet_length(chat.head_and_fence()).alias("head"), F.sha2(chat.body(2000), 256).alias("body"))


_SPACE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_INNER = "regexp_replace(x, '" + _SPACE + "+', ' ', 'g')"
_STRIP = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_SPACED = "replace(replace(text, ' t', chr(9) || ' ' || chr(160) || 't'), '. ', chr(10) || '  ' || chr(10) || ' ')"


@query("similarity_lines", f"SELECT doc_id, sha256(array_to_string(x, chr(10))) AS lines, len(x)::INT AS n FROM (SELECT doc_id, list_filter(list_transform(string_split({_SPACED}, chr(10)), lambda x: {_STRIP(_INNER)}), lambda x: x <> '') AS x FROM documents WHERE text IS NOT NULL)")
def similarity_lines(spark, d):
    x = paths.similarity_lines(F.expr(_SPACED.replace("chr(160)", "'\u00a0'")))
    t = corpora.table(spark, d, "documents").where("text is not null").select("doc_id", x.alias("x"))
    return t.select("doc_id", F.sha2(F.array_join("x", "\n"), 256).alias("lines"), F.size("x").alias("n"))


@query("csv_lists", f"SELECT doc_id, array_to_string(x, '|') AS items, len(x)::INT AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, 'the', ' ,,'), ','), lambda x: {_STRIP('x')}), lambda x: x <> '') AS x FROM documents WHERE text IS NOT NULL)")
def csv_lists(spark, d):
    x = paths.csv_items(F.replace("text", F.lit("the"), F.lit(" ,,")))
    return corpora.table(spark, d, "documents").where("text is not null").select("doc_id", x.alias("x")).select("doc_id", F.array_join("x", "|").alias("items"), F.size("x").alias("n"))
