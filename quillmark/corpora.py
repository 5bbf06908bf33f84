"""Corpora of files that are derived from plain tables, as SQL that Spark and DuckDB both run.

``~`` in a template stands for a line feed. Ordered aggregation is the one thing that the engines spell differently.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import LANG_BY_EXT
from .session import table

_EXT = "CASE lang WHEN 'en' THEN '.go' WHEN 'de' THEN '.java' WHEN 'fr' THEN '.ts' ELSE '.py' END"
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"


def text_files_sql() -> str:
    """(doc_id, path, text, hash, lines): documents as files."""
    return f"SELECT doc_id, source || '/' || lang || '/d' || CAST(doc_id AS STRING) || {_EXT} AS path, text, {{sha}} AS hash, CAST(1 + {_NL.format('text')} AS INT) AS lines FROM documents WHERE text IS NOT NULL"


def snapshots_sql(side: str) -> str:
    """prev or curr: files that came, went, changed and moved between two dates."""
    if side == "prev":
        return f"SELECT doc_id, path, text, hash, lines FROM ({text_files_sql()}) WHERE doc_id % 10 <> 0"
    edited = "CASE WHEN doc_id % 11 = 0 THEN text || chr(10) || 'edited' ELSE text END"
    moved = f"CASE WHEN doc_id % 13 = 0 THEN 'moved/' ELSE '' END || source || '/' || lang || '/d' || CAST(doc_id AS STRING) || {_EXT}"
    return f"SELECT doc_id, path, text, {{sha}} AS hash, CAST(1 + {_NL.format('text')} AS INT) AS lines FROM (SELECT doc_id, {moved} AS path, {edited} AS text FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0)"


#: language -> (extension, head, one piece per method, tail); fields: brand, k (part), n (method), supp
_TEMPLATES = [
    (".go", "package {brand}~~import (~  \"fmt\"~  al \"lib/{brand}\"~)~import \"os/s{k}\"~~// region api {k}~// region: Api{k}~const (~  A = 1~)~const B = 2~type T{k} struct {{~}}~~~", "func (s *T{k}) M{n}(x int) int {{~  return x + {supp}~}}~~func f{n}_{supp}(~) {{~}}~", "// endregion Api{k}~func TestAll{k}(t *T) {{~}}~"),
    (".java", "package com.{brand}.p{k};~~import java.util.List;~// more~import static com.{brand}.Tool.*;~~/* region: Core */~public class T{k} {{~  private int field{k};~~  public T{k}() {{~  }}~", "~  protected static List<String> m{n}(int x) {{~    return g(x, {supp});~  }}~", "}}~/* endregion Core */~"),
    (".ts", "import {{ A{k} }} from './lib/{brand}.service';~import 'side-{brand}';~const z = require(\"pkg{k}\");~export {{ q as r{k}, w }} from '../up/{brand}';~~// region Exports~export class T{k} {{~}}~export let v{k} = 1;~export default function ({{~}}~", "export async function f{n}(x) {{ return {supp} }}~export const a{n} = async (x) => x~export const o{n} = {{~  get{supp}() ,~  set{n} (x)~}}~", "// endregion Exports~describe('x', () => 1)~"),
    (".kt", "package com.{brand}~~internal class T{k} {{~", "  suspend fun m{n}(x: Int) = {supp}~  fun String.ext{n}() = 1~  private fun no{n}() = 2~", "}}~"),
    (".cs", "namespace Com.{brand}~{{~  public sealed class T{k}~  {{~    private int f{k};~", "    public override int M{n}(int x) {{ return {supp}; }}~", "  }}~}}~"),
    (".py", "# region py-{k}~import os~~class T{k}(Base):~", "    def m{n}(self):~        return {supp}~~async def no{n}():~    pass~def top{n} (x): return {supp}~", "# endregion py-{k}~"),
    (".cpp", "#include <x>~namespace com::{brand} {{~~class T{k}~{{~", "  virtual int decl{n}(int x);~  std::string T{k}::get{n}() {{ return x{supp}; }}~inline double free{n}(int y)~", "}};~}}~"),
]


@lru_cache(maxsize=1)
def _code_sql() -> str:
    def filled(t: str, method: bool) -> str:
        t = t.replace("{{", "\x01").replace("}}", "\x02").replace("'", "''")
        for name, expr in (("brand", "brand"), ("k", "CAST(p_partkey AS STRING)"), ("n", "CAST(rn AS STRING)"), ("supp", "CAST(l_suppkey AS STRING)")):
            t = t.replace("{" + name + "}", f"' || {expr} || '")
        return "'" + t.replace("\x01", "{").replace("\x02", "}") + "'"

    case = lambda i, method: "CASE p_partkey % 7 " + " ".join(f"WHEN {j} THEN {filled(t[i], method)}" for j, t in enumerate(_TEMPLATES)) + " END"
    ext = "CASE p_partkey % 7 " + " ".join(f"WHEN {j} THEN '{t[0]}'" for j, t in enumerate(_TEMPLATES)) + " END"
    return f"""
SELECT {{hint}}CASE WHEN p_partkey % 3 = 0 THEN 'src/test/' ELSE 'src/' END || brand || '/' || CASE WHEN p_partkey % 35 = 12 THEN 'k' || CAST(p_partkey AS STRING) || '/__init__' ELSE 'f' || CAST(p_partkey AS STRING) END || CASE WHEN p_partkey % 14 = 7 THEN '_test' ELSE '' END || {ext} AS path,
    replace({case(1, False)} || coalesce(body, '') || {case(3, False)}, '~', chr(10)) AS text
FROM (SELECT p_partkey, replace(lower(p_brand), '#', '') AS brand FROM part) p
LEFT JOIN (SELECT p_partkey AS pk, {{agg}} AS body FROM (
    SELECT p_partkey, rn, {case(2, True)} AS piece FROM (
        SELECT {{key}}, l_suppkey, row_number() OVER (PARTITION BY {{part}} ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM {{items}}) x) y GROUP BY p_partkey) b ON p.p_partkey = b.pk"""


#: Spark names the part before it numbers a part's rows, so that the rows it then puts together are dealt by the same column.
#: Parts are dealt likewise and looked up where the texts are: a table that looks small would be sent whole to the few tasks that
#: read the parts' one file, and all that is done with the texts would be theirs.
SPARK = {"hint": "/*+ SHUFFLE_HASH(p) */ ", "sha": "sha2(CAST(text AS BINARY), 256)", "agg": "listagg(piece, '') WITHIN GROUP (ORDER BY rn)", "key": "p_partkey", "part": "p_partkey", "items": "(SELECT *, l_partkey AS p_partkey FROM lineitem) i"}
DUCK = {"hint": "", "sha": "sha256(text)", "agg": "string_agg(piece, '' ORDER BY rn)", "key": "l_partkey AS p_partkey", "part": "l_partkey", "items": "lineitem"}
SQL = {"text_files": text_files_sql, "prev": lambda: snapshots_sql("prev"), "curr": lambda: snapshots_sql("curr"), "code_files": _code_sql}


def _fill(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def duck(name: str) -> str:
    """A corpus as a DuckDB query."""
    return _fill(SQL[name](), DUCK)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus as a DataFrame; the code goes through two tables' views of this call only."""
    tables = ["part", "lineitem"] if name == "code_files" else ["documents"]
    return _over(name, {t: table(spark, sf_dir, t) for t in tables})


def code_in(spark: SparkSession, sf_dir: str, languages: tuple[str, ...]) -> DataFrame:
    """All of ``code_files`` in these languages, and no others. A part's key tells its file's language, so rows that are in no such
    file are told when they are read; they are not sorted, sent and put together first.

    The number of partitions is named, so that Spark does not merge them by their size: what is sent is small, the texts and what is
    found in them are many times larger, and few tasks would have it all.
    """
    known = {f".{e}" for x in languages for e in LANG_BY_EXT[x]}
    kinds = [k for k, t in enumerate(_TEMPLATES) if t[0] in known]
    part, items = (table(spark, sf_dir, t).where((F.col(k) % len(_TEMPLATES)).isin(*kinds)) for t, k in (("part", "p_partkey"), ("lineitem", "l_partkey")))
    return _over("code_files", {"part": part, "lineitem": items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey")})


def _over(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    return tables[next(iter(tables))].sparkSession.sql(_rename(_fill(SQL[name](), SPARK), list(tables)), **tables)


def _rename(sql: str, tables: list[str]) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return sql


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): urls as relative paths."""
    return spark.sql("SELECT page_id, {path} AS path FROM {pages} WHERE url IS NOT NULL".replace("{path}", URL_PATH), pages=table(spark, sf_dir, "pages"))


URL_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
URL_PATHS_DUCK = f"SELECT page_id, {URL_PATH} AS path FROM pages WHERE url IS NOT NULL"
