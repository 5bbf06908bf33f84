"""Queries over rendered source files: symbols, exports, regions, slices, pointers, imports, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import corpora
from ..catalog import query
from ..functions.matches import line_count, matches_sql
from ..operators import chat, imports, regions, slices
from ..operators import symbols as S

CODE = corpora.duck("code_files")
MAX_LINES = 20


def _re(p: str) -> str:
    return "'(?m)" + p.replace("'", "''") + "'"


def _lang_sql(path: str = "path") -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))"
    from ..functions.paths import LANG_BY_EXT

    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(repr('.' + e) for e in exts)}) THEN '{tag}'" for tag, exts in LANG_BY_EXT.items()) + " ELSE '' END"


def _filled(*parts: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"trim({p})" for p in parts) + "], lambda z: z <> ''), '.')"


def heads_sql() -> str:
    pk = " ".join(f"WHEN '{k}' THEN regexp_extract(text, {_re(p)}, 1)" for k, p in S.PACKAGE.items())
    ty = " ".join(f"WHEN '{k}' THEN regexp_extract(text, {_re(p)}, {n})" for k, (p, _, n) in S.TYPE.items())
    ki = " ".join(f"WHEN '{k}' THEN regexp_extract(text, {_re(p)}, {n})" for k, (p, n, _) in S.TYPE.items())
    return f"""files AS ({CODE}),
h0 AS (SELECT path, text, {_lang_sql()} AS lang, (1 + length(text) - length(replace(text, chr(10), '')))::INT AS lines FROM files),
h1 AS (SELECT *, CASE lang {pk} ELSE '' END AS pk, CASE lang {ty} ELSE '' END AS ty, CASE lang {ki} ELSE '' END AS ki,
    regexp_matches(text, {_re(S.TS_CLASS)}) AS tc, regexp_extract(text, {_re(S.TS_CLASS)}, 1) AS tcn, regexp_extract(text, {_re(S.TS_INTERFACE)}, 1) AS ti,
    regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS base FROM h0),
h AS (SELECT path, lang, text, lines,
    CASE lang WHEN 'cpp' THEN trim(replace(pk, '::', '.'), ':.') WHEN 'py' THEN concat_ws('.', nullif(replace(folder, '/', '.'), ''), CASE WHEN base <> '__init__.py' THEN regexp_replace(base, '\\.py$', '') END) ELSE pk END AS package,
    CASE WHEN lang <> 'ts' THEN ty WHEN tc THEN coalesce(nullif(tcn, ''), 'default') ELSE ti END AS class,
    coalesce(nullif(CASE WHEN lang <> 'ts' THEN ki WHEN tc THEN 'class' WHEN ti <> '' THEN 'interface' ELSE '' END, ''), 'file') AS kind FROM h1)"""


def symbols_sql() -> str:
    """CTEs that end in sym (path, symbol, kind, start, end, seq, export)."""
    parts = []
    for lang, rules in S.RULES.items():
        for k, r in enumerate(rules):
            m = f"unnest({matches_sql('text', r.re2, r.group)})"
            inner = f"SELECT path, lines, package, class, {m} AS m FROM h WHERE lang = '{lang}'"
            recv = "regexp_extract(m.whole, 'func\\s+(\\([^)]+\\))', 1)"
            last = f"regexp_extract(trim(regexp_replace(regexp_replace({recv}, '^\\(', ''), '\\)$', '')), '([^\\s]+)$', 1)"
            base = f"regexp_extract(regexp_replace(regexp_replace({last}, '^[*&]+', ''), '\\[.*$', ''), '([^.]*)$', 1)"
            owner = {"type": "class", "none": "''", "default": "'default'", "anonymous": "''", "receiver": base, "qualifier": f"regexp_extract(m.whole, '\\b({S._ID})::{S._ID}\\s*\\($', 1)"}[r.owner]
            name = "'default'" if r.owner == "anonymous" else "m.name"
            kind = f"CASE WHEN {base} <> '' THEN 'method' ELSE 'func' END" if r.owner == "receiver" else f"'{r.kind}'"
            where = {"": "true", "type": "m.name = class AND class <> ''", "has type": "class <> ''", "unqualified": "NOT contains(m.whole, '::')"}[r.only]
            pkg = "''" if lang == "ts" else "package"
            parts.append(f"SELECT path, lines, {k} AS rule, m.i AS i, m.start AS start, {_filled(pkg, owner, name)} AS symbol, {kind} AS kind, {name} || '()' AS export FROM ({inner}) WHERE {where}")
    first = matches_sql("text", "(?m)" + S.TYPE["cpp"][0], 2)
    parts.append(f"SELECT path, lines, -1, 0, ({first})[1].start, {_filled('package', 'class')}, kind, NULL FROM h WHERE lang = 'cpp' AND class <> ''")
    objects = matches_sql("text", "(?m)" + S.TS_OBJECT, 1)
    prefix = f"list_reduce(list_prepend('', list_transform(range(1, o.i + 2), lambda q: string_split_regex(text, {_re(S.TS_OBJECT)})[q] || regexp_extract_all(text, {_re(S.TS_OBJECT)}, 0)[q])), lambda x, y: x || y)"
    block = f"SELECT path, lines, o, string_split(substr(text, length({prefix}) + 1), '}}')[1] AS block FROM (SELECT path, lines, text, unnest({objects}) AS o FROM h WHERE lang = 'ts')"
    members = matches_sql("block", "(?m)" + S.TS_MEMBER, 1)
    parts.append(f"SELECT path, lines, {len(S.RULES['ts'])}, o.i * 1000000 + m.i, o.\"end\" + m.start - 1, {_filled('o.name', 'm.name')}, 'method', NULL FROM (SELECT path, lines, o, unnest({members}) AS m FROM ({block}))")
    return heads_sql() + ",\nu AS (" + "\nUNION ALL ".join(parts) + """),
s AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rule, i) AS seq FROM u),
sym AS (SELECT path, symbol, kind, start::INT AS start, greatest(start, coalesce(lead(start) OVER (PARTITION BY path ORDER BY start, seq) - 1, lines))::INT AS "end", seq::INT AS seq, export FROM s)"""


def _code(spark, d):
    return corpora.corpus(spark, d, "code_files")


SYMBOLS = symbols_sql()


@query("file_heads", f"WITH {heads_sql()} SELECT path, lang, lines, package, class, kind FROM h")
def file_heads(spark, d):
    return S.heads(_code(spark, d)).drop("text")


def _symbols_of(lang: str):
    return lambda spark, d: S.symbols(corpora.code_in(spark, d, (lang,)), (lang,))


for _lang in S.RULES:
    query(f"symbols_{_lang}", f"WITH {SYMBOLS} SELECT * FROM sym WHERE {_lang_sql()} = '{_lang}'")(_symbols_of(_lang))

EXPORTS = f"""WITH {SYMBOLS},
listed AS (SELECT path, list(export ORDER BY seq) AS listed FROM sym WHERE export IS NOT NULL GROUP BY path),
e AS (SELECT h.path, lang, coalesce(listed, []) AS listed,
    flatten(list_transform(regexp_extract_all(text, {_re(S.TS_REEXPORT)}, 1), lambda x: list_filter(list_transform(string_split(trim(x), ','), lambda y: trim(string_split(y, ' as ')[1])), lambda y: y <> ''))) AS items,
    regexp_extract_all(text, {_re(S.TS_LETVAR)}, 1) AS names, list_transform(regexp_extract_all(text, '{S.RULES["ts"][3].re2}', 1), lambda x: x || '()') AS arrows FROM h LEFT JOIN listed ON h.path = listed.path)
SELECT path, CASE WHEN lang = 'ts' THEN list_concat(list_concat(listed[1:len(listed) - len(arrows)], list_transform(items, lambda x: x || '()')), list_concat(names, arrows))
    WHEN lang = 'cpp' THEN list_filter(listed, lambda x, i: list_position(listed, x) = i) ELSE listed END AS exports FROM e"""


@query("exports", f"SELECT path, array_to_string(exports, ' ') AS exports FROM ({EXPORTS})")
def exports(spark, d):
    return S.exports(_code(spark, d)).select("path", F.array_join("exports", " ").alias("exports"))


LINE = r"^\s*(?://|#)\s*(region|endregion)\s*:?\s*([A-Za-z0-9_.-]+)\s*$"
BLOCK = r"/\*\s*(region|endregion)\s*:?\s*([A-Za-z0-9_.-]+)\s*\*/"
EXPLICIT = f"""lm AS (SELECT path, n, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM (SELECT path, text, 0 AS n FROM h)),
bm AS (SELECT path, unnest({matches_sql('text', '(?i)' + BLOCK, 2)}) AS m FROM h),
ev AS (SELECT path, 'line' AS form, line, 0 AS i, regexp_extract(t, '(?i){LINE}', 2) AS name, lower(regexp_extract(t, '(?i){LINE}', 1)) = 'region' AS opens FROM lm WHERE regexp_matches(t, '(?i){LINE}')
    UNION ALL SELECT path, 'block', m.start, m.i, m.name, lower(regexp_extract(m.whole, '(?i){BLOCK}', 1)) = 'region' FROM bm),
d1 AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w AS s FROM ev WINDOW w AS (PARTITION BY path, form, name ORDER BY line, i)),
d2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY path, form, name ORDER BY line, i)) AS after FROM d1),
d3 AS (SELECT *, CASE WHEN opens THEN after ELSE coalesce(lag(after) OVER (PARTITION BY path, form, name ORDER BY line, i), 0) END AS d FROM d2),
d4 AS (SELECT *, last_value(CASE WHEN opens THEN line END IGNORE NULLS) OVER (PARTITION BY path, form, name, d ORDER BY line, i ROWS UNBOUNDED PRECEDING) AS start FROM d3),
explicit AS (SELECT DISTINCT path, name, start::INT AS start, line::INT AS "end" FROM d4 WHERE NOT opens AND d > 0)"""


@query("explicit_regions", f"WITH {heads_sql()}, {EXPLICIT} SELECT * FROM explicit")
def explicit_regions(spark, d):
    return regions.explicit_regions(_code(spark, d))


def coarse_sql() -> str:
    parts = []
    for lang, rules in regions.COARSE.items():
        for k, (name, re2, _, only_first) in enumerate(rules):
            m = matches_sql("text", "(?m)" + re2)
            parts.append(f"SELECT path, {k} AS rule, '{name}' AS name, m[1].start::INT AS start, m[{'1' if only_first else 'len(m)'}].\"end\"::INT AS \"end\" FROM (SELECT path, {m} AS m FROM h WHERE lang = '{lang}') WHERE len(m) > 0")
    return "coarse AS (" + " UNION ALL ".join(parts) + ")"


IMPORTS = f"""im AS (SELECT path, 'IMPORTS' AS name, m[1].start::INT AS start, m[1]."end"::INT AS "end" FROM (SELECT path, {matches_sql('text', '(?m)' + regions.GO_IMPORT)} AS m FROM h WHERE lang = 'go') WHERE len(m) > 0
UNION ALL SELECT path, 'IMPORTS', m[1].start::INT, m[len(m)]."end"::INT FROM (SELECT path, text, {matches_sql('text', '(?m)' + regions.TS_IMPORT)} AS m FROM h WHERE lang = 'ts') WHERE len(m) > 0 AND length(string_split_regex(text, {_re(regions.TS_IMPORT)})[1]) < {regions.TS_IMPORT_OFFSET}
UNION ALL SELECT path, 'IMPORTS', min(n)::INT, max(n)::INT FROM (SELECT *, max(CASE WHEN other AND first IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS stopped FROM (
    SELECT *, min(CASE WHEN imports THEN n END) OVER (PARTITION BY path ORDER BY n) AS first FROM (
        SELECT path, n, starts_with(t, 'import ') AS imports, t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, 'import ') AS other FROM (
            SELECT path, generate_subscripts(string_split(text, chr(10)), 1) AS n, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS t FROM h WHERE lang = 'java') WHERE n <= {regions.JAVA_IMPORT_LINES}))) WHERE imports AND stopped = 0 GROUP BY path)"""
TESTS = "tests AS (" + " UNION ALL ".join(f"SELECT path, 'TEST' AS name, m.start::INT AS start, m.start::INT AS \"end\", m.i AS i FROM (SELECT path, unnest({matches_sql('text', '(?m)' + p)}) AS m FROM h WHERE lang = '{lang}'{' AND ends_with(path, ' + repr('_test.go') + ')' if lang == 'go' else ''})" for lang, p in regions.TESTS.items()) + ")"
CONFIG = regions.AutoConfig(min_lines=2, max_per_file=8)
AUTO = f"""cand AS (SELECT path, 0 AS branch, seq AS k, 'SYM:' || array_to_string(string_split(symbol, '.')[greatest(1, len(string_split(symbol, '.')) - 1):], '.') AS name, start, greatest("end", start) AS "end" FROM sym
    UNION ALL SELECT path, 1, 0, name, start, "end" FROM im UNION ALL SELECT path, 2, i, name, start, "end" FROM tests UNION ALL SELECT path, 3, rule, name, start, "end" FROM coarse),
best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start, "end", 'auto:' || name, branch, k) AS rank FROM cand WHERE "end" - start + 1 >= {CONFIG.min_lines}),
auto AS (SELECT DISTINCT b.path, 'auto:' || name AS name, greatest(start, 1)::INT AS start, least(greatest("end", start), lines)::INT AS "end" FROM best b JOIN h ON b.path = h.path WHERE rank <= {CONFIG.max_per_file})"""
ALL = f"""{SYMBOLS}, {EXPLICIT}, {coarse_sql()}, {IMPORTS}, {TESTS}, {AUTO},
regions AS (SELECT e.path, 0 AS origin, name, greatest(start, 1)::INT AS start, least(greatest("end", start), lines)::INT AS "end" FROM explicit e JOIN h ON e.path = h.path
    UNION ALL SELECT path, 1, name, start, "end" FROM auto WHERE (path, name, start, "end") NOT IN (SELECT path, name, start, "end" FROM explicit))"""


@query("coarse_regions", f"WITH {heads_sql()}, {coarse_sql()} SELECT * FROM coarse")
def coarse_regions(spark, d):
    return regions.coarse_regions(S.heads(corpora.code_in(spark, d, tuple(regions.COARSE))))


@query("import_regions", f"WITH {heads_sql()}, {IMPORTS} SELECT * FROM im")
def import_regions(spark, d):
    return regions.import_regions(S.heads(corpora.code_in(spark, d, regions.IMPORT_LANGUAGES)))


@query("test_regions", f"WITH {heads_sql()}, {TESTS} SELECT * FROM tests")
def test_regions(spark, d):
    return regions.test_regions(S.heads(corpora.code_in(spark, d, tuple(regions.TESTS))))


@query("all_regions_topk", f"WITH {ALL} SELECT * FROM regions")
def all_regions_topk(spark, d):
    return regions.all_regions(_code(spark, d), CONFIG)


@query(
    "slices_of_code",
    f"""WITH {ALL} SELECT DISTINCT path, name AS slice, start, "end" FROM regions
UNION ALL SELECT path, 'chunk_' || start, start, least(start + {MAX_LINES - 1}, lines)::INT FROM (SELECT path, lines, unnest(range(1, lines + 1, {MAX_LINES}))::INT AS start FROM h WHERE lines > {MAX_LINES} AND path NOT IN (SELECT path FROM regions))""",
)
def slices_of_code(spark, d):
    f = _code(spark, d)
    return slices.slices(f.select("path", line_count(F.col("text")).alias("lines")), regions.all_regions(f, CONFIG), MAX_LINES)


@query("region_pointers", f"""WITH {ALL}, g AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'anchor') AS slug FROM regions),
k AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY start, "end", name) AS k FROM g) SELECT replace(path, '/', '-') || '#' || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, path, start, "end" FROM k""")
def region_pointers(spark, d):
    return slices.region_pointers(regions.all_regions(_code(spark, d), CONFIG))


@query("symbol_pointers", f"""WITH {SYMBOLS}, k AS (SELECT *, replace(symbol, '.', '-') AS base, row_number() OVER (PARTITION BY replace(symbol, '.', '-') ORDER BY symbol, path, start, "end") AS k FROM sym)
SELECT DISTINCT base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, path, symbol AS sym, start, "end" FROM k""")
def symbol_pointers(spark, d):
    return slices.symbol_pointers(S.symbols(_code(spark, d)))


RESOLVER = imports.Resolver("src", (("pkg*", "src/brand12/f*"), ("side-*", "src/*/none")))
_FOLD = "list_reduce(list_prepend('', string_split({0}, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN CASE WHEN a = '' OR a = '..' OR ends_with(a, '/..') THEN CASE WHEN a = '' THEN '..' ELSE a || '/..' END ELSE regexp_replace(a, '/?[^/]*$', '') END WHEN a = '' THEN x ELSE a || '/' || x END)"


def graph_sql() -> str:
    js = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, {_re(x)}, 1)" for x in imports.JS[:2]) + "), list_concat(" + ", ".join(f"regexp_extract_all(text, {_re(x)}, 1)" for x in imports.JS[2:]) + "))"
    folder = "regexp_replace(regexp_replace(path, '/?[^/]*$', ''), '^[/.]+|[/.]+$', '', 'g')"
    suffixes = ", ".join(repr(s) for s in [*imports.SUFFIXES, *["/index" + s for s in imports.SUFFIXES]])
    return f"""{heads_sql()},
sp AS (SELECT path, 'java' AS kind, 'java:' || coalesce(nullif(regexp_extract(text, {_re(S.PACKAGE['java'])}, 1), ''), CASE WHEN {folder} = '' THEN 'default' ELSE replace({folder}, '/', '.') END) AS node, regexp_extract_all(text, {_re(imports.JAVA_IMPORT)}, 1) AS specs FROM h WHERE ends_with(path, '.java')
UNION ALL SELECT path, 'go', 'go:' || coalesce(nullif(regexp_extract(text, {_re(S.PACKAGE['go'])}, 1), ''), CASE WHEN {folder} = '' THEN 'main' ELSE regexp_extract({folder}, '([^/]*)$', 1) END), list_concat(regexp_extract_all(text, {_re(imports.GO_SINGLE)}, 1), flatten(list_transform(regexp_extract_all(text, '(?s)import\\s*\\(\\s*(.*?)\\s*\\)', 1), lambda x: regexp_extract_all(x, {_re(imports.GO_LINE)}, 1)))) FROM h WHERE ends_with(path, '.go')
UNION ALL SELECT path, 'js', 'js:' || regexp_replace(path, '\\.[^./]*$', ''), {js} FROM h WHERE regexp_matches(path, '\\.(ts|tsx|js)$')),
spec AS (SELECT DISTINCT path, kind, node, unnest(specs) AS spec FROM sp),
bare AS (SELECT DISTINCT spec FROM spec WHERE kind = 'js' AND NOT starts_with(spec, '.')),
bases AS (SELECT spec, 0 AS rank, replace('src/brand12/f*', '*', substr(spec, 4)) AS base FROM bare WHERE starts_with(spec, 'pkg')
    UNION ALL SELECT spec, 1, replace('src/*/none', '*', substr(spec, 6)) FROM bare WHERE starts_with(spec, 'side-') UNION ALL SELECT spec, 2, 'src/' || spec FROM bare),
tries AS (SELECT spec, rank, 0 AS place, base AS file FROM bases WHERE regexp_matches(base, '\\.[^./]*$') UNION ALL SELECT spec, rank, unnest(range(1, {2 * len(imports.SUFFIXES) + 1})), base || unnest([{suffixes}]) FROM bases),
hits AS (SELECT spec, arg_min(file, rank * 100 + place) AS file FROM tries WHERE file IN (SELECT path FROM h) GROUP BY spec),
t AS (SELECT spec.*, CASE WHEN kind <> 'js' THEN kind || ':' || spec.spec WHEN starts_with(spec.spec, '.') THEN 'js:' || regexp_replace({_FOLD.format("regexp_replace(path, '/?[^/]*$', '') || '/' || spec.spec")}, '\\.[^./]*$', '') WHEN file IS NOT NULL THEN 'js:' || regexp_replace(file, '\\.[^./]*$', '') ELSE 'npm:' || spec.spec END AS target FROM spec LEFT JOIN hits ON spec.spec = hits.spec),
edges AS (SELECT DISTINCT node AS src, target AS dst FROM t WHERE node <> target),
nodes AS (SELECT DISTINCT id FROM (SELECT node AS id FROM sp UNION ALL SELECT target FROM t)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"""


@query("import_edges", f"WITH {graph_sql()} SELECT * FROM edges")
def import_edges(spark, d):
    return imports.graph(_code(spark, d), None, RESOLVER)[1]


@query("import_nodes", f"WITH {graph_sql()} SELECT * FROM nodes")
def import_nodes(spark, d):
    return imports.graph(_code(spark, d), None, RESOLVER)[0]


@query("node_degree", f"WITH {graph_sql()} SELECT * FROM deg")
def node_degree(spark, d):
    return imports.degrees(imports.graph(_code(spark, d), None, RESOLVER)[1])


@query("bare_resolution", f"WITH {graph_sql()} SELECT spec, file FROM hits")
def bare_resolution(spark, d):
    f = _code(spark, d)
    s = imports.specifiers(f).where("kind = 'js' and spec is not null and not startswith(spec, '.')").select("spec").distinct()
    return imports.bare_targets(s, f, RESOLVER)


RANK = f"""WITH {graph_sql()}, m AS (SELECT path, lang, length(text) AS n, regexp_matches(text, 'public|export') AS has FROM h),
r AS (SELECT m.path, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, has DESC, contains(m.path, '/test/') OR ends_with(m.path, '_test.go'), m.path) AS rank, n FROM m LEFT JOIN deg ON lang = 'ts' AND deg.id = 'js:' || regexp_replace(m.path, '\\.[^./]*$', ''))"""


def _ranked(spark, d):
    f = _code(spark, d)
    m = f.select("path", F.when(F.col("text").rlike("public|export"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("exports"), F.length("text").alias("size"))
    return chat.ranked(m, imports.graph(f, None, RESOLVER)[1])


@query("chat_rank", RANK + " SELECT path, degree, rank FROM r")
def chat_rank(spark, d):
    return _ranked(spark, d).select("path", "degree", "rank")


@query(
    "chat_next_fit",
    RANK.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, g(rank, message, files, size) AS (SELECT 0::BIGINT, 1, 0, 0::BIGINT UNION ALL
    SELECT r.rank, CASE WHEN files > 0 AND (files = 10 OR size + n > 2000) THEN message + 1 ELSE message END, CASE WHEN files > 0 AND (files = 10 OR size + n > 2000) THEN 1 ELSE files + 1 END, CASE WHEN files > 0 AND (files = 10 OR size + n > 2000) THEN n ELSE size + n END
    FROM g JOIN r ON r.rank = g.rank + 1)
SELECT r.rank, path, message FROM g JOIN r ON g.rank = r.rank""",
)
def chat_next_fit(spark, d):
    return chat.next_fit(_ranked(spark, d), 10, 2000)
