"""License scan, URL filter, preference formatting and decontamination: against their SQL and plain Python."""

import hashlib
import random

import pytest

from quillmark.llm import decontaminate, licenses, preferences, queries, urls

from .helpers import SF, documents, duck, same, words

ODD_TEXTS = [None, "", " ", "\n\n", "mit", "MIT License", "mit license mit license", "x " * 5000 + "Apache, License!", "cc by\ncc-by cc", "é ü gnu General Public LICENSE", "licensed under the apache license version 2 0 you may not use this file except in compliance with it"]


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df())


def test_licenses_equal_plain_search(spark):
    texts = ODD_TEXTS + [" ".join(t.split()[: len(t.split()) * k // 10]) for t in licenses.TEMPLATES.values() for k in (7, 8, 9, 10)]
    texts += [("filler " * 200 + t + " filler" * 200) for t in licenses.TEMPLATES.values()]
    docs = list(enumerate(texts)) + [(2, " "), (None, "mit license")]
    got = {(r["id"], r["n_words"]): r for r in licenses.scan_licenses(documents(spark, docs)).collect()}
    assert len(got) == len(texts) + 1
    size = licenses.block_size(licenses.TEMPLATES)
    for d, t in docs:
        w = words(t)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        blocks = [w[a : a + 2 * size] for a in range(0, len(w) - size, size)] if len(w) > 2 * size else [w]
        met = {k: max(len(set(b) & set(p.split())) for b in blocks) / len(set(p.split())) for k, p in licenses.TEMPLATES.items()}
        met = {k: s for k, s in met.items() if s * len(set(licenses.TEMPLATES[k].split())) >= licenses.need(licenses.TEMPLATES[k])}
        r = got[d, len(w)]
        base = sorted({label for _, label in places})
        assert r["n_base"] == len(places) and r["base_labels"] == ",".join(base) and r["labels"] == ",".join(sorted({*base, *met}))
        assert r["first_word"] == min((i for i, _ in places), default=None) and r["last_word"] == max((i for i, _ in places), default=None)
        assert r["score"] == pytest.approx(1 if places else max(met.values(), default=0))
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n# ", "\n\n"])
def test_wrapped_notices_are_found(spark, end):
    docs = []
    for i, t in enumerate(licenses.TEMPLATES.values()):
        w = t.split()
        docs.append((i, "other words " * 40 + end + end.join(" ".join(w[k : k + 5]) for k in range(0, len(w), 5)) + end + "more words " * 40))
    got = {r["id"]: r for r in licenses.scan_licenses(documents(spark, docs)).collect()}
    for i, label in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1


def test_literal_wordings(spark):
    """Not from the module's own tables."""
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the \"Software\")"
    gpl = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published"
    docs = [(1, mit), (2, gpl), (3, "Permission is granted to any person"), (4, mit), (4, mit)]
    rows = sorted((r["id"], r["base_labels"], r["labels"], r["score"], r["n_base"]) for r in licenses.scan_licenses(documents(spark, docs)).collect())
    assert rows == [(1, "", "mit-terms", 1.0, 0), (2, "gpl", "gpl,gpl-notice", 1.0, 1), (3, "", "", 0.0, 0), (4, "", "mit-terms", 1.0, 0), (4, "", "mit-terms", 1.0, 0)]


def test_templates_beyond_one_plan(spark, monkeypatch):
    docs = documents(spark, [(i, t) for i, t in enumerate(licenses.TEMPLATES.values())] + [(None, "mit license")])
    want = sorted(map(str, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(licenses, "MAX_TEMPLATES", 2)
    assert sorted(map(str, licenses.scan_licenses(docs).collect())) == want


def test_urls_equal_plain_rules(spark):
    rules = [*urls.RULES, urls.Rule("allow", "", "/en/"), urls.Rule("block", "a.b.com", "/x/y"), urls.Rule("allow", "b.com", "/x/"), urls.Rule("block", "", "")]
    g = random.Random(3)
    hosts = ["com", "example.com", "www.EXAMPLE.com", "a.b.com", "b.com", "ab.com", "x.net", "example.net", "org", "", "a..com"]
    paths = ["", "/", "/en/7", "/en/77", "/en", "/de/8/9", "/es/", "/x/y", "/x/yz", "/x/", "//en/", "/EN/"]
    rows = [f"{s}://{h}{p}{q}" for s in ("http", "") for h in hosts for p in paths for q in ("", "?a=/en/", "#://x")] + [None, "", "no scheme", "://", "a://b://c/en/", "http://x\n.com/en/"]
    g.shuffle(rows)
    pages = spark.createDataFrame([(i, u, "H", "r") for i, u in enumerate(rows + rows[:5])], "page_id long, url string, HOST string, Rule string")
    for subset in (list(urls.RULES), rules):
        a = urls.judge_urls(pages, subset).select("page_id", "host", "path", "rule", "verdict").toPandas()
        same(a, urls.judge_urls(pages, subset, max_broadcast=0).select("page_id", "host", "path", "rule", "verdict").toPandas())
        for r in a.where(a.notna(), None).itertuples():
            u = (rows + rows[:5])[r.page_id] or ""
            host = path = ""
            if "://" in u:
                rest = u.split("://", 1)[1]
                n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
                host, path = rest[:n], rest[n:]
                host = "".join(c.lower() if c.isascii() else c for c in host)
                path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
            assert (r.host, r.path) == (host, path)
            fit = [x for x in subset if (not x.host or host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
            best = max(fit, key=lambda x: x.rank, default=None)
            assert (r.rule, r.verdict) == ((best.key, best.action) if best else (None, "allow"))
    assert urls.judge_urls(pages.where("false")).collect() == []


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, None, None),
        (2, "chosen", 0, "user", "only one side"), (3, "chosen", 5, "user", ""), (3, "rejected", 5, "user", None), (4, "chosen", 0, "assistant", "x"), (4, "rejected", 1, "assistant", "x"),
        (None, "chosen", 0, "user", "no pair"), (5, "other", 0, "user", "x"), (5, None, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, side string, turn long, role string, text string, C int")
    got = {r["pair_id"]: r for r in preferences.format_preferences(df).collect()}
    assert got.keys() == {1, 3, 4}
    r = got[1]
    assert (r["n_prompt_turns"], r["prompt"], r["chosen"]) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\ngood<|end|>\n")
    assert r["rejected"] == "<|assistant|>\nbad<|end|>\n<||>\n<|end|>\n" and r["rejected_mask"] == "14:11:1,5:8:0" and r["chosen_mask"] == "14:12:1"
    assert (got[3]["n_prompt_turns"], got[3]["chosen"], got[3]["rejected"]) == (1, "", "")
    assert (got[4]["n_prompt_turns"], got[4]["n_chosen_turns"], got[4]["n_rejected_turns"]) == (0, 1, 1)
    assert preferences.format_preferences(df.where("false")).collect() == []


def hits_of(docs, bench, size=13):
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for item, text in bench:
            x = words(text)
            n = min(size, len(x))
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1) if grams else ():
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    items.add(item)
        out[d] = len(w), hit, items
    return out


def leaks():
    g = random.Random(6)
    v = [f"t{i}" for i in range(300)]
    bench = [(i, " ".join(g.choice(v) for _ in range(g.choice([3, 9, 13, 14, 40])))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (103, "a b c"), (None, "q r s")]
    docs = []
    for d in range(60):
        w = [g.choice(v) for _ in range(g.randint(0, 120))]
        x = words(g.choice(bench)[1])
        i, a = g.randint(0, len(w)), g.randint(0, 3)
        w[i:i] = x[a : len(x) - g.randint(0, 3)]
        docs.append((d, g.choice([" ", ", ", "\n"]).join(w).upper()))
    docs += [(200, None), (201, ""), (202, "A, b: C"), (203, "a b c " * 30), (204, "z " * 3000 + "a b c"), (205, "q r s")]
    return docs, bench


def test_decontamination_equals_plain_search(spark):
    docs, bench = leaks()
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, W int")
    want = hits_of(docs, bench)
    for most in (0, 10**6):
        rows = decontaminate.find_hits(documents(spark, docs), b, max_broadcast=most).collect()
        assert len(rows) == len(docs)
        for r in rows:
            n, hit, items = want[r["id"]]
            spans = [(s["start"], s["end"]) for s in r["spans"]]
            assert r["n_words"] == n and r["n_hit"] == len(hit) and set(r["items"]) == items
            assert {k for s, e in spans for k in range(s, e)} == hit and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    out = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(documents(spark, docs), b).collect()}
    for d, t in docs:
        n, hit, _ = want[d]
        if hit and 20 * len(hit) >= n:
            assert d not in out
        else:
            assert out[d] == t if not hit else words(out[d]) == [w for i, w in enumerate(words(t)) if i not in hit]


def test_repeated_rows_and_columns_named_as_those_inside(spark):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, t, 1, "k", "s", 0), (1, t, 2, None, "s", 0), (None, t + " x", 3, "k", "s", 0), (2, "clean", 4, "k", "s", 0)], "doc_id long, text string, _q_id long, _q_key string, _Q_SPANS string, _q_out int")
    bench = spark.createDataFrame([(7, t)], "item_id long, text string")
    hits = decontaminate.find_hits(docs, bench).collect()
    assert sorted((r["id"] or 0, r["n_hit"]) for r in hits) == [(0, 13), (1, 13), (1, 13), (2, 0)]
    assert [tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()] == [(2, "clean", 4, "k", "s", 0)]
    pages = spark.createDataFrame([(1, "http://a.com/en/1", 5)], "page_id long, url string, _q int")
    assert urls.judge_urls(pages).collect() == urls.judge_urls(pages, max_broadcast=0).collect() == [(1, "http://a.com/en/1", 5, "a.com", "/en/1", "com/en/", "block")]


def test_decontamination_of_empty_tables(spark):
    docs, bench = leaks()
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.find_hits(documents(spark, []), b).collect() == []
    rows = decontaminate.find_hits(documents(spark, docs), b.where("false")).collect()
    assert len(rows) == len(docs) and not any(r["n_hit"] for r in rows)


def test_query_digests(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = hits_of(docs, bench)
    for r in queries.op9_decontamination(spark, SF).collect():
        _, hit, items = want[r["doc_id"]]
        assert (r["n_hit"], r["n_items"]) == (len(hit), len(items))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
