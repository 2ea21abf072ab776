"""Near duplicates against all pairs of word shingle sets."""

import random
import re

import numpy as np
from pyspark.sql import types as T

from surveyloom.llm import minhash

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rep", T.StringType()),
    T.StructField("component", T.LongType())])


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    live = [(i, s) for i, s in sets if s and i is not None]
    for x, (i, s) in enumerate(live):
        for j, t in live[x + 1:]:
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else root(i), i is not None and root(i) == i) for i, s in sets), key=repr)


def check(spark, rows, n=3, percent=85):
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), n, percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, n, percent)


def test_odd_texts_and_chains(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)  # several block pairs per bucket
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(160)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One\tTwo"), (7, "é É"), (None, "one"), (9, " ".join(base * 60))]
    chain = list(base)
    for i in range(60):  # each near the one before, the ends apart
        rows.append((1000 - i, " ".join(chain)))
        chain[rng.randrange(160)] = word()
    for i in range(60):  # one crowd of near copies, and some copies of them
        near = list(base[::-1])
        for _ in range(rng.randrange(5)):
            near[rng.randrange(160)] = word()
        rows.append((2000 + i, " ".join(near)))
    rows += [(3000 + i, rows[70 + i][1].upper()) for i in range(20)] + [rows[80], rows[80]]
    check(spark, rows)
    check(spark, rows, 5, 80)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = minhash.keep_one(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), 3, 85)
    assert kept.columns == SCHEMA.names
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _, k in brute(rows, 3, 85) if k}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_posterior_bounds_keep_similar_pairs():
    rng = np.random.default_rng(3)
    bounds = minhash.least_matches(0.85)
    assert [n for n, _ in bounds] == [24, 48, 72, 96, 120] and all(0 < m < 0.85 * n for n, m in bounds)
    one = rng.integers(0, 2**32, (4000, minhash.HASHES), dtype=np.uint32)
    for similarity, least in ((0.86, 1.0), (0.3, 0.0)):
        other = np.where(rng.random(one.shape) < similarity, one, one + 1)
        share = len(minhash._survives(one, other, bounds)) / 4000
        assert share >= 0.9999 if least else share == 0
