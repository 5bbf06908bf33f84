"""Rendered source files have a method for each row of lineitem."""

import re

import duckdb

from quillmark import catalog, corpora
from quillmark.functions.paths import LANG_BY_EXT

from test_queries import canonical

LINES = 8


def tables(spark, tmp_path):
    parts = [(k, f"Brand#{k % 3}") for k in range(1, 22)]
    items = [(n, k, 100 * k + n, n % 7, 1.0 * n) for k, _ in parts[:-1] for n in range(1, LINES + 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double")
    rows.selectExpr("*", "timestamp_ntz'2020-01-01' AS l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return parts


def test_all_of_lineitem_is_rendered(spark, tmp_path):
    parts = tables(spark, tmp_path)
    want = []
    for k, brand in parts:
        _, head, method, tail = corpora._TEMPLATES[k % 7]
        text = head + "".join(method.format(n=n, supp=100 * k + n, k=k, brand="") for n in range(1, LINES + 1) if k < 21)
        text = head.format(brand=brand.lower().replace("#", ""), k=k) + text[len(head) :] + tail.format(k=k)
        want.append(text.replace("~", "\n"))
    assert sorted(r["text"] for r in corpora.corpus(spark, str(tmp_path), "code_files").collect()) == sorted(want)


def test_a_query_equals_its_sql(spark, tmp_path):
    tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    a = canonical(catalog.QUERIES["file_heads"](spark, str(tmp_path)).toPandas())
    b = canonical(con.execute(catalog.ORACLES["file_heads"]).df())
    assert a.equals(b)


def test_rows_of_other_languages_are_not_sent(spark, tmp_path):
    tables(spark, tmp_path)
    odd = spark.createDataFrame([(None, "Brand#1"), (-1, "Brand#1"), (27, None), (34, "Brand#2")], "p_partkey long, p_brand string")
    odd.write.mode("append").parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    whole = {tuple(r) for r in corpora.corpus(spark, str(tmp_path), "code_files").collect()}
    for lang, exts in LANG_BY_EXT.items():
        got = [tuple(r) for r in corpora.code_in(spark, str(tmp_path), (lang,)).where("path IS NOT NULL").collect()]
        assert got and sorted(got) == sorted(r for r in whole if r[0] and r[0].rsplit(".", 1)[1] in exts)
    assert {tuple(r) for r in corpora.code_in(spark, str(tmp_path), tuple(LANG_BY_EXT)).where("path IS NOT NULL").collect()} == {r for r in whole if r[0]}
    asked = catalog.QUERIES["symbols_cpp"](spark, str(tmp_path))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert re.search(r"Filter .*\(l_partkey#\d+L % 7\) = 6\)", plan) and len(sent) == 2 and any("REPARTITION_BY_NUM" in x for x in sent)
    assert canonical(asked.toPandas()).equals(canonical(con.execute(catalog.ORACLES["symbols_cpp"]).df()))


def test_regions_of_some_languages_have_no_other_rows_sent(spark, tmp_path):
    tables(spark, tmp_path)
    for name, kinds in {"import_regions": "0,1,2", "test_regions": "0,2", "coarse_regions": "0,1,2,4"}.items():
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"Filter .*\(l_partkey#\d+L % 7\) IN \({kinds}\)", plan), name
