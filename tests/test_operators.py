"""Small cases of single operators."""

import hashlib
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark import corpora
from quillmark.functions import hashing, paths, scans
from quillmark.functions.matches import line_count, matches
from quillmark.operators import changes, chat, checks, filters, imports, patches, regions, slices
from quillmark.operators import symbols as S
from quillmark.operators.ranks import numbered_within
from quillmark.plans import runs
from quillmark.sources import bundles, lines, project, schemas, state, tree


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def col(spark, f, *values):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_names_and_paths(spark):
    assert col(spark, paths.slug, "auto:SYM:A.b", "---", "é") == ["auto-SYM-A.b", "anchor", "anchor"]
    versions, numbers = ["1.8", "17.0.1", "1.8.0", "abc", "1.", "", " 21-ea"], ["8", "17", "8.0", "", "1", "", "21"]
    assert col(spark, paths.jdk_number, *versions) == numbers
    assert [project.jdk_number(x) for x in versions] == numbers
    assert col(spark, paths.csv_items, " a, b,,\tc ", "", " ", ",") == [["a", "b", "c"], [], [], []]
    assert col(spark, paths.similarity_lines, "  a \t b\n\n \u00a0\nc\u2003 d", "") == [["a b", "c d"], []]
    assert col(spark, lambda c: paths.relative_spec(F.lit("src/app/a.ts"), c), "./x.service", "../up/q", "../../../z") == ["js:src/app/x", "js:src/up/q", "js:../z"]
    assert col(spark, paths.safe_entry, "/../a", "c:\\a/./b.txt", "..", "x/../y") == ["a", "a/b.txt", "entry", "y"]
    assert [bundles.safe_entry(x) for x in ("/../a", "c:\\a/./b.txt", "..", "x/../y")] == ["a", "a/b.txt", "entry", "y"]
    assert col(spark, paths.receiver_type, "(s *Server)", "(p *pkg.T[K])", "(x)", "") == ["Server", "T", "x", ""]
    assert col(spark, paths.lang_of, "a.TSX", "b.hh", "c", ".go") == ["ts", "cpp", "", "go"]
    assert col(spark, paths.java_package, "a.java", "x/y/a.java") == ["default", "x.y"]
    assert col(spark, lambda c: paths.padded(c.cast("int")), "7", "12345") == ["0007", "12345"]


def test_simhash(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "..."), (3, "")], "id int, t string")
    got = {r.id: r.simhash for r in hashing.simhash(d, "id", "t").collect()}

    def fnv(s):
        h = hashing.FNV_START
        for b in s.encode():
            h = ((h ^ b) * hashing.FNV_PRIME) % 2**64
        return h

    votes = [sum((1 if fnv(t) >> i & 1 else -1) for t in ("a", "b", "a")) for i in range(64)]
    want = sum((v >= 0) << i for i, v in enumerate(votes))
    assert got[1] % 2**64 == want and got[2] == got[3] == -1


def test_simhash_stays_in_its_row(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, None), (3, "--")], "id long, t string")
    out = hashing.simhash(d, "id", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in out.where("simhash = -1").collect()} == {2, 3}


def test_matches_report_lines_from_leading_blanks(spark):
    t = "x\n\n\nfunc A() {\n}\nfunc B() {}\n"
    m = one(spark, matches(F.col("t"), S.RULES["go"][0].java, 2), t=t)
    assert [(r.name, r.start) for r in m] == [("A", 2), ("B", 6)]
    assert col(spark, line_count, "", "a", "a\n") == [1, 1, 2]


def test_symbol_ends_and_permissive_java(spark):
    java = "package p;\npublic class C {\n  public C() {}\n  int f(int x) {\n    return g(x);\n  }\n}\n"
    rows = S.symbols(spark.createDataFrame([("C.java", java)], "path string, text string"), ("java",)).collect()
    assert {(r.symbol, r.kind) for r in rows} == {("p.C.C", "method"), ("p.C.f", "method"), ("p.C.g", "method"), ("p.C.C", "ctor")}
    assert all(r.end >= r.start for r in rows) and max(r.end for r in rows) == 8


def test_long_blank_text_is_linear(spark):
    d = spark.createDataFrame([("a.java", " " * 100_000), ("b.cpp", "word " * 5_000)], "path string, text string")
    assert S.symbols(d, ("java", "cpp")).count() == 0


def test_explicit_regions_like_a_stack(spark):
    t = "// endregion A\n// region A\n// region A\n// endregion A\n/* region: B */ x\n\n/* endregion B */\n# REGION c\n"
    rows = regions.explicit_regions(spark.createDataFrame([("f", t)], "path string, text string")).collect()
    assert {tuple(r) for r in rows} == {("f", "A", 3, 4), ("f", "B", 5, 7)}


def test_no_test_regions_by_default(spark):
    d = spark.createDataFrame([("a_test.go", "package a\nfunc TestX(t *T) {\n}\n")], "path string, text string")
    assert regions.test_regions(S.heads(d)).count() == 1
    assert regions.auto_regions(d).count() == 0


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


CODE = [
    ("a.ts", "export class A {\n}\nexport const o = {\n  get() ,\n  set (x)\n}\nexport { q as r, w } from './b'\nexport let v = 1;\nexport const f = (x) => x\n"),
    ("b.cpp", "namespace x {\nclass T\n{\n  virtual int d(int x);\n  int T::g() { return 1; }\n"),
    ("c_test.go", "package a\n// region R\nfunc TestX(t *T) {\n}\n// endregion R\nfunc (s *S) M(x int) {\n}\n"),
    ("d.txt", "plain"),
]


def test_symbols_of_scripts_in_one_reading(spark):
    got = S.symbols(spark.createDataFrame(CODE, "path string, text string"), ("ts",))
    assert "Exchange" not in _plan(got) and _plan(got).count("Scan ExistingRDD") == 1
    assert sorted((r.symbol, r.start, r.end, r.seq) for r in got.collect()) == [("A.f", 9, 10, 1), ("o.get", 4, 4, 2), ("o.set", 5, 8, 3)]


def test_symbols_of_cpp_in_one_reading(spark):
    got = S.symbols(spark.createDataFrame(CODE, "path string, text string"), ("cpp",))
    assert "Exchange" not in _plan(got) and _plan(got).count("Scan ExistingRDD") == 1
    assert {("x.T", "class", 2), ("x.T.d", "method", 4), ("x.T.g", "method", 5)} <= {(r.symbol, r.kind, r.start) for r in got.collect()}


def test_exports_in_one_reading(spark):
    got = S.exports(spark.createDataFrame(CODE, "path string, text string"))
    assert "Exchange" not in _plan(got) and _plan(got).count("Scan ExistingRDD") == 1
    rows = {r.path: r.exports for r in got.collect()}
    assert rows["a.ts"] == ["q()", "w()", "v", "f()"] and rows["c_test.go"] == ["TestX()", "M()"] and rows["d.txt"] == []


def test_coarse_regions_in_one_reading(spark):
    got = regions.coarse_regions(S.heads(spark.createDataFrame(CODE, "path string, text string")))
    assert "Union" not in _plan(got)
    assert ("c_test.go", 3, "FUNCS", 3, 6) in set(map(tuple, got.collect()))


def test_all_regions_in_one_reading(spark):
    got = regions.all_regions(spark.createDataFrame(CODE, "path string, text string"), regions.AutoConfig(min_lines=2))
    assert "Exchange" not in _plan(got) and _plan(got).count("Scan ExistingRDD") == 1
    rows = set(map(tuple, got.where("path = 'c_test.go'").collect()))
    assert ("c_test.go", 0, "R", 2, 5) in rows and ("c_test.go", 1, "auto:FUNCS", 3, 6) in rows
    ids = {r.id for r in slices.region_pointers(got).collect()}
    assert {"c_test.go#R", "c_test.go#auto-FUNCS"} <= ids


def test_code_files_are_dealt_once_by_part(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _plan(corpora.corpus(spark, "/root/testdata/sf0.001", "code_files"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plan.count("Exchange hashpartitioning") == 2  # rows of each of the two tables, but no texts


def test_matches_by_their_first_word():
    t = "x func a(\n\n \n func b(\nfunc c( func d(\n\tfunc e(\n"
    java = S.RULES["go"][0].java
    assert scans.led_by_word(java)
    assert [(s, m[2]) for s, m in scans.at_lines(java, t, scans.line_starts(t))] == [(10, "b"), (22, "c"), (38, "e")]
    assert scans.led_by_word(S.RULES["cpp"][0].java) is None and scans.led_by_word(regions.java_form(regions.COARSE["cs"][0][1])) is None


def test_regions_seek_symbols_as_far_as_they_need(monkeypatch):
    t = "package a\n" + "func f(\n) {\n}\n" * 500
    starts, seen = scans.line_starts(t), []
    each = S.each_at_lines
    monkeypatch.setattr(S, "each_at_lines", lambda *a: (seen.append(x) or x for x in each(*a)))
    got = S.first_spans("go", "", t, starts, 1502, 2, 8)
    assert [(s, e) for s, e, _ in got] == [(2 + 3 * i, 4 + 3 * i) for i in range(8)] and len(seen) < 20
    assert len(S.first_spans("go", "", t, starts, 1502, 2, 0)) == 500


def test_regions_seek_members_of_objects_as_far_as_they_need(monkeypatch):
    over = "export const o = {\n get (\nexport const p = {\n set (\n\n}\n"  # the first block reaches over the second
    t = over + "export const q = {\n get (\n\n}\n" * 500
    starts, seen = scans.line_starts(t), []
    each = S.each_at_lines
    monkeypatch.setattr(S, "each_at_lines", lambda *a: (seen.append(x) or x for x in each(*a)))
    got = S.first_spans("ts", "", t, starts, len(starts), 2, 8)
    assert [(s, e) for s, e, _ in got] == [(2, 3), (4, 7)] + [(8 + 4 * i, 11 + 4 * i) for i in range(6)] and len(seen) < 40
    assert len(S.first_spans("ts", "", t, starts, len(starts), 2, 0)) == 502


def test_cpp_rules_of_one_pattern_share_their_matches(monkeypatch):
    tried = []
    each = S.each_at_lines
    monkeypatch.setattr(S, "each_at_lines", lambda java, *a: tried.append(java) or each(java, *a))
    t = CODE[1][1]
    got = S.emitted("cpp", "x", "T", "class", t, scans.line_starts(t))
    assert len(tried) == len(set(tried)) and ("x.T.d", "method") in {x[1:3] for x in got}


def test_texts_of_small_tables_are_not_sent_to_the_readers_of_parts(spark):
    got = corpora.corpus(spark, "/root/testdata/sf0.01", "code_files")  # its lineitem could be broadcast
    assert "Broadcast" not in _plan(got) and _plan(got).count("Exchange hashpartitioning") == 2


def test_heads_in_the_row_equal_heads(spark):
    blank = "\n" * 40
    more = [("e.java", "package a.b;\npublic enum E {\n"), ("f/g.py", "class C(\n"), ("f/__init__.py", ""), ("h.cs", "namespace N.M\n{\n  x sealed class Q\n"), ("i.kt", blank + "package p\nobject O"), ("j.h", "\n namespace a::b:: {\nenum class E\n"), ("k.tsx", "export interface I {"), ("l.js", "export default class {"), ("m.go", "package q\r\n"), ("n.cpp", "class Aé")]
    d = spark.createDataFrame(CODE + more, "path string, text string")
    want = {r.path: tuple(r)[1:] for r in S.heads(d).select("path", "lang", "lines", "package", "class", "kind", "text").collect()}
    assert {r.path: S.head(*tuple(r)[1:]) for r in S.with_text(d).collect()} == want
    assert want["k.tsx"][3:5] == ("I", "interface") and want["j.h"][2] == "a.b" and want["n.cpp"][3] == "A"
    assert "regexp_extract(text" not in _plan(regions.all_regions(d))


def test_matches_behind_line_feeds_are_those_at_the_starts_of_lines(monkeypatch):
    patterns = [r.java for rules in S.RULES.values() for r in rules] + [regions.java_form(*x[1:3]) for rules in regions.COARSE.values() for x in rules]
    t = "func a(\n\n \nint f(x) {\n\tdef g(h\n func b (\nexport const c = (\n) => d\nprivate int e;\n\n  private f , g ;\n  x y::z(\n"
    for text in (t, "\n" * 40 + t, t + " \n" * 40 + t):
        starts = scans.line_starts(text)
        assert starts == [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        got = [[(s, m.end(), m.groups()) for s, m in scans.at_lines(p, text, starts)] for p in patterns]
        ends = [scans.ends_at_lines(p, text, starts) for p in patterns]
        with monkeypatch.context() as c:
            c.setattr(scans, "long_blank", lambda text: True)
            assert got == [[(s, m.end(), m.groups()) for s, m in scans.at_lines(p, text, starts)] for p in patterns]
        assert [x and [(s, m.end(), m.groups()) for s, m in x] for x in ends] == [x[:1] + x[-1:] if x else None for x in got]
    assert scans.long_blank("\n" * 40) and not scans.long_blank(t)


def test_exports_seek_no_lines(monkeypatch):
    monkeypatch.delattr(S, "line_of")
    assert S.exported("go", "", CODE[2][1]) == ["TestX()", "M()"]
    assert S.exported("ts", "A", CODE[0][1]) == ["q()", "w()", "v", "f()"]
    assert S.exported("cpp", "T", CODE[1][1]) == ["g()", "d()"] and S.exported("cpp", "", CODE[1][1]) == ["g()", "d()"]
    assert S.exported("java", "C", "public C() {}\n int f(\n int f(\n") == ["f()", "f()", "C()"] and S.exported("", "", "x") == []


def test_files_of_a_language_are_told_by_one_look_at_their_paths(spark):
    got = S.symbols(spark.createDataFrame(CODE + [("e.HPP", "class E")], "path string, text string"), ("cpp",))
    told = [x for x in _plan(got).split("\n") if "Filter" in x]
    assert len(told) == 1 and told[0].count("regexp_extract") == 1 and {r.path for r in got.collect()} == {"b.cpp", "e.HPP"}


def test_slices_in_one_join(spark):
    f = spark.createDataFrame([("a", 45), ("c", 9)], "path string, lines int")
    r = spark.createDataFrame([("c", "x", -3, 99), ("c", "x", 1, 9)], "path string, name string, start int, end int")
    got = slices.slices(f, r, 20)
    assert _plan(got).count("Join") == 1
    assert sorted(map(tuple, got.collect())) == [("a", "chunk_1", 1, 20), ("a", "chunk_21", 21, 40), ("a", "chunk_41", 41, 45), ("c", "x", 1, 9)]


def test_numbers_of_a_key_that_many_ranges_have(spark):
    rows = [("b", i) for i in range(3000)] + [("a", i) for i in range(5)] + [("c", 1)]
    got = numbered_within(spark.createDataFrame(rows, "key string, v int").repartition(8), "key", [F.col("v")])
    assert "Exchange hashpartitioning(key" not in _plan(got)
    assert {tuple(r) for r in got.select("key", "v", "k").collect()} == {(k, v, v + 1 if k != "c" else 1) for k, v in rows}


def test_files_without_a_node_are_dealt_out(spark):
    m = spark.createDataFrame([(f"f{i}.go",) for i in range(400)] + [("a.ts",)], "path string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        j = chat.with_degree(m, spark.createDataFrame([("js:a", 7)], "id string, degree long"))
        sizes = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 200 and j.where("path = 'a.ts'").first()["degree"] == 7
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_slices(spark):
    f = spark.createDataFrame([("a", 45), ("b", 20), ("c", 9)], "path string, lines int")
    got = sorted(tuple(r) for r in slices.slices(f, None, 20).collect())
    assert got == [("a", "chunk_1", 1, 20), ("a", "chunk_21", 21, 40), ("a", "chunk_41", 41, 45)]
    r = spark.createDataFrame([("c", "x", -3, 99), ("c", "x", 1, 9)], "path string, name string, start int, end int")
    assert [tuple(x) for x in slices.slices(f, r, 0).where("path = 'c'").collect()] == [("c", "x", 1, 9)]


def test_pointer_ids(spark):
    s = spark.createDataFrame([("pkg.Type.F", "b.go", 1, 2), ("pkg.Type.F", "a.go", 1, 2)], "symbol string, path string, start int, end int")
    assert {(r.id, r.path) for r in slices.symbol_pointers(s).collect()} == {("pkg-Type-F", "a.go"), ("pkg-Type-F-2", "b.go")}


def test_delta_of_equal_and_empty_sides(spark):
    s = spark.createDataFrame([("a", "h1", 3), ("b", "h2", 4)], "path string, hash string, lines int")
    e = s.where("false")
    assert changes.delta(s, s).count() == 0
    assert [r.op for r in changes.delta(e, s).collect()] == ["added"] * 2
    assert [r.op for r in changes.delta(s, e).collect()] == ["removed"] * 2


def test_rename_candidates_by_length(spark):
    old = spark.createDataFrame([("o1", "x", 10), ("o2", "y", 0)], "path string, hash string, lines int")
    new = spark.createDataFrame([("n1", "a", 20), ("n2", "b", 21), ("n3", "c", 500), ("n4", "x", 10)], "path string, hash string, lines int")
    got = {(r.from_path, r.to_path) for r in changes.rename_candidates(old, new).collect()}
    assert got == {("o1", "n1"), ("o2", "n1"), ("o2", "n2"), ("o2", "n3"), ("o2", "n4")}


def test_greedy_rounds_equal_the_sequence(spark):
    import random

    r = random.Random(4)
    rows = {(f"f{r.randint(0, 9)}", f"t{r.randint(0, 9)}"): r.randint(0, 3) for _ in range(60)}
    df = pd.DataFrame([(a, b, d) for (a, b), d in rows.items()], columns=["from_path", "to_path", "distance"])
    got = changes.greedy_renames(spark.createDataFrame(df, "from_path string, to_path string, distance int")).toPandas()
    want = changes.greedy_in_order(df)
    assert sorted(map(tuple, got[["from_path", "to_path"]].values)) == sorted(map(tuple, want[["from_path", "to_path"]].values))


def _random_sides(spark, n):
    import random

    r = random.Random(9)
    near = [r.getrandbits(64) for _ in range(5)]
    rows = [[(f"{side}{i:03}", f"h{r.randint(0, 30)}", r.choice([0, 1, 2, 3, 9, 40])) for i in range(n)] for side in "ft"]
    bits = [[(x[0], (r.choice(near) ^ (1 << r.randint(0, 63)) ^ (1 << r.randint(0, 63))) - (1 << 63)) for x in side] for side in rows]
    frames = [spark.createDataFrame(x, "path string, hash string, lines int") for x in rows] + [spark.createDataFrame(x, "path string, simhash long") for x in bits]
    alike = lambda a, b: a[1] != b[1] and (a[2] == 0 or b[2] == 0 or max(a[2], b[2]) <= 2 * min(a[2], b[2]))
    known = dict(bits[0] + bits[1])
    distance = lambda a, b: ((known[a[0]] ^ known[b[0]]) & (1 << 64) - 1).bit_count()
    return frames, [(a, b, distance(a, b)) for a in rows[0] for b in rows[1] if alike(a, b)]


def test_rename_candidates_by_cells(spark, monkeypatch):
    monkeypatch.setattr(changes, "BLOCK", 30)
    frames, want = _random_sides(spark, 100)
    got = changes.rename_candidates(*frames[:2])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # no key, so no task that has most of the pairs
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0], a[1], b[1], a[2], b[2]) for a, b, _ in want)


def test_similar_pairs_by_cells(spark, monkeypatch):
    monkeypatch.setattr(changes, "BLOCK", 30)
    frames, want = _random_sides(spark, 100)
    got = changes.similar_pairs(*frames)
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()  # each pair is found once
    assert sorted(map(tuple, got.collect())) == sorted((a[0], b[0], d) for a, b, d in want if d <= 8)


def test_greedy_without_a_table_of_pairs(spark):
    frames, want = _random_sides(spark, 100)
    pairs = changes.greedy_in_order(pd.DataFrame([(a[0], b[0], d) for a, b, d in want if d <= 8], columns=["from_path", "to_path", "distance"]))
    assert sorted(map(tuple, changes.greedy_similar(*frames).collect())) == sorted(map(tuple, pairs.values))


def test_patches():
    o = patches.DiffOptions()
    text, big = patches.unified("a\nb\n", "a\nc\n", "x", o)
    assert not big and "@@ -1,3 +1,3 @@" in text and text.startswith("--- x")
    assert "@@ -0,0 +1,3 @@" in patches.unified("", "a\nb\n", "x", o)[0]
    assert patches.unified("a" * 50, "b" * 50, "x", patches.DiffOptions(max_bytes=99))[1]
    assert patches.keep_feeds("a\nb\n") == ["a\n", "b\n", ""] and patches.keep_feeds("") == []


def test_patches_that_show_nothing():
    o, one = patches.DiffOptions(), patches.DiffOptions(max_bytes=3, no_prefix=False)
    assert patches.unified("", "", "x", o) == ("--- /dev/null\n+++ x\n@@\n# diff omitted (oversize)\n", False)
    assert patches.unified("a\n", "a\n", "x", o) == ("--- x\n+++ x\n@@\n# diff omitted (oversize)\n", False)
    assert patches.unified("ab", "cd", "d/x", one) == ("--- a/d/x\n+++ b/d/x\n@@\n# diff omitted (oversize)\n", True)
    assert patches.unified(None, "abcd", "x", one) == ("--- /dev/null\n+++ b/x\n@@\n# diff omitted (oversize)\n", True)
    assert patches.unified(None, "abc", "x", one) == ("--- /dev/null\n+++ x\n@@ -0,0 +1 @@\n+abc", False)
    lines = "".join(f"{i}\n" for i in range(20))
    assert patches.unified(lines, lines.replace("9\n", "x\n", 1), "f", patches.DiffOptions(context=0)) == patches.unified(lines, lines.replace("9\n", "x\n", 1), "f", o)
    assert "@@ -6,9 +6,9 @@" in patches.unified(lines, lines.replace("9\n", "x\n", 1), "f", o)[0]


def test_patch_names(spark):
    rows = [("a/b", "0123456789"), ("a_b", "0123456789"), ("a:b", "0123456789"), ("a?b", ""), ("..", None)]
    got = dict(map(tuple, patches.patch_names(spark.createDataFrame(rows, "path string, hash string")).collect()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:8]
    assert got == {"a/b": "a_b.patch", "a:b": "a_b-01234567.patch", "a?b": f"a_b-{sha('a?b')}.patch", "a_b": f"a_b-01234567-{sha('a_b01234567')}.patch", "..": "patch.patch"}


def test_chat_bodies(spark):
    rows = [(1, "a.go", "p", "", ["x", "y"], "text é"), (2, "b.md", "", "", [], "")]
    m = spark.createDataFrame(rows, "rank int, path string, package string, class string, exports array<string>, text string")
    head = b"# a.go\n- Package: p\n- Class: -\n- Exports: x, y\n\n```go\n"
    bodies = lambda n: [bytes(r["body"]) for r in chat.one_per_message(m, n).orderBy("message").collect()]
    assert bodies(1000) == [head + "text é\n".encode(), b"# b.md\n\n```markdown\n\n"]
    assert bodies(len(head) + 6)[0] == head + b"text \xc3\n"  # cut in bytes, then a line feed
    assert bodies(len(head) + 1)[0] == head + b"t\n"
    assert bodies(len(head))[0] == head and bodies(10)[0] == head[:10]


def test_bundle_texts(spark):
    index = {"changed": [{"path": "a", "diff": "diffs/a.patch", "oversize": True}], "added": [{"path": "n"}], "removed": [], "renamed": [{"from": "x", "to": "y"}]}
    assert bundles.summary(index) == "# SUMMARY\n\nChanged (1):\n- a -> diffs/a.patch\n\nAdded (1):\n- n -> added/n\n\nRemoved (0):\n\nRenamed (1):\n- x -> y\n\nOversize diffs (1)\n"
    text = bundles.readme(" m ", "delta", bundles.DELTA_LAYOUT, ["ts", " go ", ""], patches.DiffOptions(context=0, no_prefix=False), True)
    assert text.startswith("# m\n") and "bundle: go, ts." in text and "with 4 lines" in text and "the prefixes" in text and "bench.txt" in text and "\r" not in text
    p = spark.createDataFrame([("--- a/x.ts\n+++ b/x.ts\n@@",), ("--- /dev/null\n+++ y.h\n",), ("+++ <new>\n",), ("none",)], "patch string")
    assert bundles.present_languages(bundles.patched_paths(p)) == ["cpp", "ts"]
    assert bundles.present_languages(p.select(F.lit("a.js").alias("path"))) == []


def test_schemas(spark):
    m, s = schemas.document("manifest"), schemas.document("symbols")
    assert m["title"] == "Manifest" and m["required"] == ["module", "files"] and m["properties"]["jdk"] == {"type": "string"}
    anchor = m["properties"]["files"]["items"]["properties"]["anchors"]["items"]
    assert anchor == {"type": "object", "required": ["name", "start", "end"], "properties": {"name": {"type": "string"}, "start": {"type": "integer"}, "end": {"type": "integer"}}}
    assert s["properties"]["symbols"]["items"]["required"] == ["symbol", "kind", "path", "start", "end"]
    assert schemas.faults({"module": "", "files": [{"path": "a", "lines": 1}]}, m) == []
    assert schemas.faults({"files": [{"path": 1}, {}], "jdk": True}, m) == ["$: has no module", "$.jdk: is no string", "$.files[0].path: is no string", "$.files[1]: has no path"]


def test_blobs_by_hash(spark, tmp_path):
    where = str(tmp_path / "blobs")
    state.save_blobs(where, spark.createDataFrame([("abcdef01", b"x"), ("nohash", b"y")], "hash string, content binary"))
    asked = spark.createDataFrame([("abcdef01",), ("abcdef02",), (None,)], "hash string")
    assert {r.hash: r.content for r in state.read_blobs(spark, where, asked).collect()} == {"abcdef01": b"x", "abcdef02": None, None: None}
    bad = spark.createDataFrame([("ABC",)], "hash string")
    assert [r.known for r in state.has_blobs(spark, where, asked.unionByName(bad)).orderBy("hash").collect()] == [False, False, True, False]
    with pytest.raises(Exception, match="not a hash"):
        state.read_blobs(spark, where, bad).collect()


def test_filters(spark):
    ok = lambda f, *v: col(spark, f, *v)
    assert ok(filters.is_excluded, "build.gradle", "a/output.go", ".github/x.md", "src/a.go") == [True, True, True, False]
    rules = filters.ignore_rules("*.log\n!keep.log\ntmp/\n")
    assert ok(lambda c: filters.is_ignored(c, rules), "a.log", "x/keep.log", "tmp/keep.log", "tmp", "a.go") == [True, False, True, False, False]
    assert ok(lambda c: filters.is_ignored(c, filters.ignore_rules("*")), "a.go") == [True]


def test_budget_and_packing(spark):
    d = spark.createDataFrame([("a", 6), ("b", 5), ("c", 3)], "path string, size long")
    assert {r.path for r in chat.within_budget(d, 10).collect()} == {"a", "c"}
    i = spark.createDataFrame([(1, "a", 6), (2, "b", 5), (3, "c", 3), (4, "d", 99)], "rank long, path string, size long")
    assert [r.message for r in chat.next_fit(i, 10, 10).orderBy("rank").collect()] == [1, 2, 2, 3]
    assert [r.message for r in chat.next_fit(i, 1, 1000).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_manifest_rules(spark):
    h = "0" * 64
    rows = [("a", h, 2, [("r", 1, 2)]), ("a", h, 2, []), ("x\\y", h, 1, []), ("../x", h, 1, []), ("q", h[1:], 1, []), ("z", "", 1, [("r", 1, 5)])]
    m = spark.createDataFrame(rows, "path string, hash string, lines int, regions array<struct<name:string,start:int,end:int>>")
    assert {(r.path, r.rule) for r in checks.manifest_violations(m).collect()} == {("a", "path comes twice"), ("x\\y", "path has a backslash"), ("../x", "path climbs"), ("q", "hash is not 64 lower hex digits"), ("z", "region is out of range")}
    assert checks.report(checks.manifest_violations(m.limit(0), "")) == "manifest : module is blank"


def test_bare_specifiers(spark):
    r = imports.Resolver.from_json(json.dumps({"compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["lib/*", "no"], "one": ["lib/one.ts"]}}}))
    listing = spark.createDataFrame([("lib/x.ts",), ("lib/one.ts",), ("src/y/index.js",)], "path string")
    s = spark.createDataFrame([("@a/x",), ("one",), ("y",), ("react",)], "spec string")
    assert {(x.spec, x.file) for x in imports.bare_targets(s, listing, r).collect()} == {("@a/x", "lib/x.ts"), ("one", "lib/one.ts"), ("y", "src/y/index.js")}
    assert imports.Resolver.from_json("// no\n{}") is None


@pytest.fixture
def project_tree(tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "src" / "a.go").write_text("package a\n\nimport \"fmt\"\n\n// region R\nfunc A() {\n}\n// endregion R\n")
    (root / "src" / "b.ts").write_text("import { q } from './c'\nexport function f() {}\n")
    (root / "src" / "_c.ts").write_text("export class C {}\n")
    (root / ".hidden" / "d.md").write_text("<x & y>\n")
    (root / "build.md").write_text("no\n")
    (root / "go.mod").write_text("module example.org/p\n\ngo 1.22\n")
    return root


def test_tree_keeps_hidden_names(spark, project_tree):
    got = {r.path: r for r in tree.scan(spark, str(project_tree)).collect()}
    assert set(got) == {"src/a.go", "src/b.ts", "src/_c.ts", ".hidden/d.md"}
    assert got["src/b.ts"].lines == 3 and len(got["src/a.go"].sha256) == 64


def test_three_runs(spark, project_tree, tmp_path):
    c = runs.Config(str(project_tree), cache=str(tmp_path / "cache"), emit_sources=True, store_blobs=True)
    out = [str(tmp_path / f"{i}.zip") for i in range(5)]
    assert runs.full(spark, c, out[0]) and runs.full(spark, c, out[1])
    assert open(out[0], "rb").read() == open(out[1], "rb").read()
    with zipfile.ZipFile(out[0]) as z:
        assert z.namelist()[:6] == ["manifest.json", "symbols.json", "BUNDLE.ID", "graph.json", "pointers.jsonl", "README.md"] or z.namelist()[4] == "slices.jsonl"
        m = json.loads(z.read("manifest.json"))
        assert [f["path"] for f in m["files"]] == sorted(f["path"] for f in m["files"]) and m["build"] == "go" and m["module"] == "proj"
        assert {"js:src/c", "go:fmt"} <= set(json.loads(z.read("graph.json"))["nodes"])
    assert runs.delta(spark, c, out[2])["changed"] == []
    (project_tree / "src" / "b.ts").write_text("import { q } from './c'\nexport function g() {}\n")
    (project_tree / "src" / "_c.ts").rename(project_tree / "src" / "moved.ts")
    (project_tree / "src" / "new.go").write_text("package a\n")
    index = runs.delta(spark, c, out[3])
    assert [x["path"] for x in index["changed"]] == ["src/b.ts"] and [(x["from"], x["to"]) for x in index["renamed"]] == [("src/_c.ts", "src/moved.ts")]
    assert [x["path"] for x in index["added"]] == ["src/new.go"] and index["removed"] == []
    with zipfile.ZipFile(out[3]) as z:
        assert "-export function f() {}" in z.read("delta.patch").decode() and "added/src/new.go" in z.namelist()
    assert runs.chat_bundle(spark, c, out[4])
    with zipfile.ZipFile(out[4]) as z:
        assert "chat/0001.md" in z.namelist() and z.read("README.md").startswith(b"# Chat Bundle\n\n- Module: ")
        assert z.read("TOC.md").decode().startswith("# CHAT TOC\n\n| Message | Files |\n|:--------|:------|\n| chat/0001.md | ")
    assert state.load_snapshot(spark, c.folder)[0].count() == 5


def test_snapshot_stream(spark, tmp_path):
    from quillmark.streaming import snapshots

    src = tmp_path / "in"
    spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1)], "path string, hash string, lines int, ts long").coalesce(1).write.parquet(str(src / "p=0"))
    seen = []
    ev = spark.readStream.schema("path string, hash string, lines int, ts long").parquet(str(src / "*"))
    q = snapshots.follow(ev, str(tmp_path / "state"), lambda d, n: seen.append({(r.path, r.op) for r in d.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    spark.createDataFrame([("a", "9", 1, 2), ("b", None, None, 2), ("c", "3", 1, 2)], "path string, hash string, lines int, ts long").coalesce(1).write.parquet(str(src / "p=1"))
    q = snapshots.follow(ev, str(tmp_path / "state"), lambda d, n: seen.append({(r.path, r.op) for r in d.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    assert seen == [{("a", "added"), ("b", "added")}, {("a", "changed"), ("b", "removed"), ("c", "added")}]


def test_line_forms(spark):
    assert col(spark, lines.fed, "", "a", "a\n") == ["", "a\n", "a\n"]
    assert col(spark, lines.pieces, "", "a\nb", "a\n") == [[], ["a\n", "b"], ["a\n", ""]]
    assert lines.joined(["a", "b\n", "c"]) == "a\nb\nc"
