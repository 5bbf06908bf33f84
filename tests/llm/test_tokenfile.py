import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import queries, tokenfile
from quillmark.llm.rangecoder import BLOCK_IDS, BlockError, decode_blocks, encode_blocks
from quillmark.session import scratch

from .helpers import SF, documents


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=300), max_size=6))
def test_round_trip(blocks):
    back = decode_blocks(encode_blocks([np.array(b, np.uint32) for b in blocks]))
    assert [b.tolist() for b in back] == blocks


def test_round_trip_of_full_blocks_and_size():
    g = np.random.default_rng(3)
    text = np.resize(g.integers(0, 40, 300), BLOCK_IDS).astype(np.uint32)  # repeats itself
    noise = g.integers(0, 2**32, BLOCK_IDS, dtype=np.uint32)
    steep = np.minimum(g.geometric(0.2, BLOCK_IDS), 500).astype(np.uint32)
    one = np.full(BLOCK_IDS, 7, np.uint32)
    data = encode_blocks([text, noise, steep, one])
    for a, b in zip(decode_blocks(data), (text, noise, steep, one), strict=True):
        assert (a == b).all()
    sizes = [len(x) for x in data]
    assert sizes[3] < 300 and sizes[0] < BLOCK_IDS // 2 and sizes[2] < BLOCK_IDS * 2


def test_damage_is_noticed():
    data = encode_blocks([np.arange(500, dtype=np.uint32) % 17])[0]
    for place in (0, 7, 20, 40, len(data) - 1):
        bad = bytearray(data)
        bad[place] ^= 4
        with pytest.raises(BlockError):
            decode_blocks([bytes(bad)])
    with pytest.raises(BlockError):
        decode_blocks([data[:-3]])


def test_a_block_is_coded_on_its_own():
    a, b = np.arange(900, dtype=np.uint32) % 11, np.arange(700, dtype=np.uint32) % 13
    assert encode_blocks([a, b])[1] == encode_blocks([b])[0]


def check(spark, texts_by_id, docs):
    path = scratch(spark)
    tokenfile.write_tokens(docs, path, queries.tokenizer_path("word_bpe_49k.json"))
    rows = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r, (doc, text) in zip(rows, texts_by_id, strict=True):
        ids = reference_ids([text])[0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (doc, at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)


def test_file_set(spark):
    long = "Weather and water, again and again. " * 3000
    texts = [None, "", "Über  den\tWolken", "A B", long, "<|endoftext|>", "mixed\nLines\r\nof text", "x" * 3000]
    check(spark, list(enumerate(texts)), documents(spark, list(enumerate(texts))))


def test_repeated_rows_and_an_empty_table(spark):
    check(spark, [(1, "a b"), (1, "a b"), (4, None)], documents(spark, [(4, None), (1, "a b"), (1, "a b")]))
    check(spark, [], documents(spark, []))


def test_query(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d["doc_id"])
    at, want = 0, []
    for d, ids in zip(docs, reference_ids([d["text"] for d in docs]), strict=True):
        want.append((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    rows = queries.op2_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == want
