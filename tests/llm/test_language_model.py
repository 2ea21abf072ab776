"""Corpus counts against a plain count; the network against differences and a walk in single steps."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from surveyloom.llm import language_model as lm

ODD = [(1, None), (2, ""), (3, " \n"), (4, "The THE the"), (5, "é É ß"), (None, "the unheard-of"), (6, "never seen here"), (7, "la " * 30_000), (8, "dup"), (8, "dup")]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id bigint, text string, rare string, score double")
    got = lm.score(docs).collect()
    counts = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    total = sum(counts.values())
    unit = np.log10(total + len(counts) + 1)
    want = sorted(((i, held_out(i), len(w), sum(counts[x] > 0 for x in w), total, sum(np.log10(counts[x] + 1) - unit for x in w))
                   for i, t in rows for w in [tokens(t)]), key=lambda r: (r[0] or -1, r[2]))
    have = sorted((tuple(r)[:6] for r in got), key=lambda r: (r[0] or -1, r[2]))
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in got)
    return got


def test_documents_and_odd_texts(spark):
    docs = [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = check(spark, docs + ODD)
    apart = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == pytest.approx(by_id[2]) and by_id[1] == pytest.approx(by_id[3])


def test_tiny_and_empty_tables(spark):
    check(spark, ODD)
    assert lm.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def network(seed=2):
    rng = np.random.default_rng(seed)
    net = lm.Network(rng.integers(0, 50, lm.HEAD + lm.TAIL).astype(float))
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(0, 0.2, net.p[k].shape)
    return net, rng


def test_gradients_equal_differences():
    net, rng = network()
    inputs, targets = rng.integers(0, lm.START + 1, (5, 3)), rng.integers(0, lm.START, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0, 0] = fresh[2, 1] = True
    h = rng.normal(0, 0.3, (3, lm.HIDDEN))
    g, _, _ = net.gradients(inputs, targets, fresh, h)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            if name == "x":
                at = (int(inputs[2, 1]), at[1])
            old, losses = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = old + d
                losses.append(net.gradients(inputs, targets, fresh, h)[2])
            value[at] = old
            assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_windows_carry_the_state():
    net, rng = network()
    texts = [rng.integers(0, lm.START, n) for n in (1, 2, lm.WINDOW, lm.WINDOW + 1, 5 * lm.WINDOW - 1, 7, 200)]
    got = lm._text_scores(net, texts)
    for text, score in zip(texts, got):
        h, before, total = np.zeros((1, lm.HIDDEN)), lm.START, 0.0
        for s in text:
            h, _ = net.step(net.p["x"][[before]] + net.p["b"], h)
            every = net.log_likelihood(np.repeat(h, lm.START, 0), np.arange(lm.START))
            assert np.exp(every).sum() == pytest.approx(1)
            total += every[s]
            before = s
        assert score == pytest.approx(total / np.log(10), rel=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts = [np.array([5, 900, 40, 1030] * int(rng.integers(5, 40))) for _ in range(3000)]
    losses = lm.train(lm.Network(np.ones(lm.HEAD + lm.TAIL)), texts)
    assert losses[-1] < 0.2 * losses[0]


def test_every_training_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 20_000)  # several tasks and rounds
    rows = [(i if i % 5 else 8, "one two three four five six seven eight nine ten " * 2) for i in range(1, 4001)] + [(None, "last words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    words = lm.vocabulary(lm.corpus_counts(docs))
    network = lm.fit(docs, words)
    assert network.read == words.total == sum(len(t.split()) + 1 for i, t in rows if not held_out(i))
    texts = [np.array([words.symbol(w) for w in lm.tokens_of(rows[0][1].encode())])]
    assert lm._text_scores(network, texts)[0] > lm._text_scores(lm.Network(words.symbol_counts), texts)[0] + 5


def test_chunks_hold_every_token_once():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.START, n).astype("<u2") for n in (1, 700, 3, 64, 2)]
    chunks = list(lm._chunks(texts, 100))
    assert np.concatenate([c[1] for c in chunks]).tolist() == np.concatenate(texts).tolist()
    want = [x for t in texts for x in [lm.START, *t[:-1].tolist()]]
    assert np.concatenate([c[0] for c in chunks]).tolist() == want and sum(c[2].sum() for c in chunks) == len(texts)
    network, seen = lm.Network(np.ones(lm.HEAD + lm.TAIL)), []
    known = network.gradients
    network.gradients = lambda x, y, f, h: seen.append(y.size) or known(x, y, f, h)
    lm.train(network, texts, passes=1)
    assert sum(seen) == sum(map(len, texts))


def test_the_model_does_not_depend_on_files_or_order(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 12_000)  # several tasks
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = lm.vocabulary(lm.corpus_counts(docs))
    assert words.total // lm.SHARE >= 3
    one, other = lm.fit(docs, words), lm.fit(docs.orderBy(docs.text.desc()).repartition(7), words)
    assert one.read == other.read == words.total and all(np.array_equal(one.p[k], other.p[k]) for k in one.p)
