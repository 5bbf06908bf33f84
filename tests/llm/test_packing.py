import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillmark.llm import packing, queries
from quillmark.llm.tokens import CachedEncoder

from .helpers import SF, documents


def reference_ids(texts, name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= capacity
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


ODD = ["", None, " ", "  ", "a ", "\n\n", "a\nb", "a\n b", "a \nb", "x   y", "x \t y", "a\xa0b", "a\u2003b", "é\nb", "à\u3000b", "can't stop", "'s.", "'sx.y", "a1b2", "foo.bar,baz", "...a", "$$$ %% a$$$", "hello <|endoftext|> world", "<|startoftext|>x", "<|STARTOFTEXT|> a", "a\x00b c", "\x1c a", "İstanbul STRASSE", "ΑΣ ΟΔΟΣ.", "é á.", "a \u0301b", "日本語 テスト\nです", "😀 x", "a" * 300, "x\u0338 y", "don'T WE'LL", "a\r\nb", "a\x85b", "A.B.C", "ǅ ﬁ", "Grüße, ÉTÉ été."]
SOME = [*"abA'. ,\n\té1$", "'s", "\u0301", "\xa0", "<|endoftext|>", "word", " "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    g = random.Random(5)
    texts = ODD + [a + s + b for a in ("x", "é", "'", "1", ".") for b in ("y", "é", "'s", "9") for s in (" ", "\n", "  ", "\n\n", " \n", "\n ", " \t", "'", "\u3000 ")]
    texts += ["".join(g.choice(SOME) for _ in range(g.randint(1, 30))) for _ in range(2000)]
    small = CachedEncoder(queries.tokenizer_path(name), most=1)
    small.table.most = 100  # starts anew again and again
    for part in (texts, texts[::-1]):
        got = small.encode(part)
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in got] == reference_ids(part, name)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_a_plain_search(seed):
    g, fit, free = random.Random(seed), packing.BestFit(100, 10**9), []
    for _ in range(400):
        n = g.choice([1, 2, 5, 100, g.randint(1, 100)])
        number, offset = fit.place(n)
        best = min((x for x in free if x >= n), default=None)
        if best is None:
            assert number == len(free) and offset == 0
            free.append(100 - n)
        else:
            assert free[number] == best and offset == 100 - best
            free[number] -= n


def test_the_fullest_bin_closes():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (9, 4, 3)] == [(0, 0), (1, 0), (1, 4)]
    assert fit.place(8) == (2, 0)  # three are open: the one with a space of 1 closes
    assert fit.place(1) == (2, 8)
    with pytest.raises(ValueError):
        fit.place(11)


def test_pieces_and_sequences(spark):
    long = "Weather and water, again and again. " * 900
    texts = [None, "", "One two.", "One two.", "a  b\n\n c \t d", " lead", "<|endoftext|> no mark", "é" * 3000, long, "x" * 5000, "\n", " "]
    docs = documents(spark, list(enumerate(texts)) + [(2, "One two."), (None, "no id")])
    p = packing.encode_pieces(docs, queries.tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(p).collect()
    want = [x for i, x in enumerate(reference_ids([*texts, "no id"]))]
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == {*range(len(texts)), None}
    for doc, pieces in got.items():
        ids = want[-1 if doc is None else doc]
        if doc == 2:
            assert len(pieces) == 2 and pieces[0]["ids"] == pieces[1]["ids"]
            pieces = pieces[:1]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == ids
        assert [r["start"] for r in pieces] == np.concatenate(([0], np.cumsum([r["length"] for r in pieces])))[:-1].tolist()
        assert all(r["length"] == 1024 for r in pieces[1:])
    check_packed(rows, 1024)
    whole = packing.sequences(packing.pack(p)).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)


def test_an_empty_table(spark):
    p = packing.encode_pieces(documents(spark, []), queries.tokenizer_path("byte_bpe_50k.json"))
    assert packing.pack(p).collect() == []


def test_few_open_bins_still_pack_all(spark):
    p = spark.createDataFrame([(i, 0, 1 + i * 37 % 50) for i in range(500)], "doc_id long, piece int, length long")
    rows = packing.pack(p, capacity=50, open_bins=3, block=16).collect()
    assert len(rows) == 500
    check_packed(rows, 50)


def test_query(spark):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d, ids in zip(docs, reference_ids([d["text"] for d in docs]), strict=True):
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[d["doc_id"], k] = a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    n = check_packed(rows, 1024)
    least = -(-sum(x[1] for x in want.values()) // 1024)
    assert n <= 1.15 * least + 8
