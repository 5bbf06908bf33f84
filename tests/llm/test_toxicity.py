import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import toxicity as T
from quillmark.llm.bytetools import runs

from .helpers import documents, words


def inputs(texts, most=1 << 20):
    return T.joined([T.prepare(data, at) for _, _, data, at in runs(pa.array(texts, pa.large_string()), most)])


def test_gradient_equals_differences():
    net, g = T.Network(), np.random.default_rng(1)
    net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
    x = inputs(["you are a nice river", "stone by stone the wall grows " * 20, "é", "", "bad bad words"])
    which, y = np.arange(len(x.windows)), g.integers(0, 2, len(x.windows)).astype(np.float64)
    _, grads, rows, tri = net.loss_gradient(x, which, y)
    for name, d in grads.items():
        real = rows if name == "word" else tri if name == "tri" else np.arange(len(d))
        for _ in range(4):
            at = tuple(int(g.integers(0, n)) for n in d.shape)
            cell = (int(real[at[0]]), *at[1:])
            old, loss = net.p[name][cell], []
            for step in (1e-4, -1e-4):
                net.p[name][cell] = old + step
                loss.append(net.loss_gradient(x, which, y)[0])
            net.p[name][cell] = old
            assert d[at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=0.05, abs=2e-5), name


def plain_score(net, text):
    """The network in plain loops, a word at a time."""
    p, H, ws = net.p, T.HIDDEN, [w.encode() for w in words(text)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def embedded(w):
        one = np.frombuffer(w, np.uint8)
        bucket = int(T.word_hashes(one, np.array([0, len(one)]))[0][0]) % T.WORDS
        padded = b"\x01" + w + b"\x02"
        tri = [((padded[i] * 65536 + padded[i + 1] * 256 + padded[i + 2]) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % T.TRIGRAMS for i in range(len(w))]
        return p["word"][bucket].astype(float) + sum(p["tri"][t].astype(float) for t in tri) / len(tri)

    def states(es, d):
        h, out = np.zeros(H), []
        for e in es:
            a, b = e @ p[f"{d}x"] + p[f"{d}c"], h @ p[f"{d}h"]
            z, r = sigmoid(a[:H] + b[:H]), sigmoid(a[H : 2 * H] + b[H : 2 * H])
            c = np.tanh(a[2 * H :] + r * b[2 * H :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    tops = []
    for a in range(0, max(1, len(ws) - T.STRIDE), T.STRIDE):
        es = [embedded(w) for w in ws[a : a + T.WINDOW]]
        both = [np.concatenate(x) for x in zip(states(es, "f"), states(es[::-1], "b")[::-1], strict=True)]
        weight = np.exp([np.tanh(h @ p["ax"] + p["ac"]) @ p["av"] for h in both])
        pooled = sum((w / weight.sum() * h for w, h in zip(weight, both, strict=True)), np.zeros(2 * H))
        tops.append(pooled @ p["o"] + p["oc"][0])
    return sigmoid(net.scale * max(tops) + net.shift)


def test_scores_equal_plain_loops():
    texts = ["you are a nice river", "Stone, by stone; the WALL grows é " * 30, "", "...", "x", *(" ".join(f"w{i}" for i in range(n)) for n in (31, 32, 33, 64, 65, 97, 161))]
    net = T.fit(["you are bad " * 20, "stone by stone " * 30, "bad river", "a nice wall"], np.array([1, 0, 1, 0]), steps=20)
    assert net.scores(inputs(texts), len(texts)) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_windows_cover_every_word_and_runs_do_not_matter():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 31, 32, 63, 64, 65, 96, 97, 500)]
    x, y, net = inputs(texts), inputs(texts, 100), T.Network()
    for k, t in enumerate(texts):
        n = len(t.split())
        covered = sum(len(set(w[w >= 0].tolist())) for w in x.windows[x.text == k])
        assert covered >= n and len(set(x.windows[x.text == k].reshape(-1).tolist()) - {-1}) == n
    assert np.allclose(net.scores(x, len(texts)), net.scores(y, len(texts)), atol=1e-6)


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_held_out_rows(spark, sf, least):
    """The smaller table has some 30 toxic texts to learn from; the README states what comes of that."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    df, share = T.sample(docs, labels)
    assert not any(T.held_out(d) for d in df["doc_id"]) and 0 < share < 0.5
    net = T.train(docs, labels)
    scored = T.score(docs.join(labels.select("doc_id"), "doc_id"), net).join(labels, "doc_id").where("toxic is not null").select("doc_id", "score", "toxic").collect()
    out = [r for r in scored if T.held_out(r["doc_id"])]
    y, s = np.array([r["toxic"] for r in out]), np.array([r["score"] for r in out])
    assert len(y) > 50 and ((s >= 0) & (s <= 1)).all()
    auc = np.mean([float(a > b) + 0.5 * float(a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc >= least


def test_odd_rows(spark):
    net = T.Network()
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "long " * 60_000), (None, "é")]
    got = T.score(documents(spark, rows), net, name="score").collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 6 and by[1] == by[2] and all(0 < s < 1 for s in by.values())
    assert T.score(documents(spark, []), net).collect() == []


def test_constant_without_both_labels():
    net = T.fit(["a", "b"], np.array([0, 0]), share=0.25)
    assert net.scores(inputs(["x", ""]), 2) == pytest.approx([0.25, 0.25])
    assert T.fit([], np.zeros(0, int)).scores(inputs(["x"]), 1) == pytest.approx([1e-6], abs=1e-6)
