"""Runs and collapsed texts against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st

from surveyloom.llm import periodic as P, queries as Q


def plain_runs(w):
    found = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(
                    all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def plain(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=12), st.integers(1, 9)), max_size=8))
def test_runs_of_few_words(parts):
    words = [w for cycle, times in parts for w in cycle * times]
    assert P.runs_of(words) == plain_runs(words)


def test_runs_of_random_texts():
    rng = random.Random(5)
    for size, kinds in ((200, 2), (300, 3), (300, 40), (400, 1)):
        words = [b"%d" % rng.randrange(kinds) for _ in range(size)]
        at = rng.randrange(size // 2)
        words[at:at + 90] = (words[at:at + 17] * 6)[:90]
        assert P.runs_of(words) == plain_runs(words)


def test_splitting_is_that_of_the_plain_recursion():
    def plain_split(ids, low, high):
        if high - low < 24:
            return []
        part = ids[low:high].tolist()
        rare = [low + i for i, x in enumerate(part) if part.count(x) < 3]
        if not rare:
            return [(low, high)]
        return [s for a, b in zip([low - 1, *rare], [*rare, high]) for s in plain_split(ids, a + 1, b)]
    rng = np.random.default_rng(3)
    for kinds in (5, 20, 60, 90):
        ids = rng.integers(0, kinds, 400)
        ids[100:180] = np.tile(ids[100:110], 8)
        assert sorted(P.surviving_segments(ids)) == plain_split(ids, 0, len(ids))


def test_a_long_text_of_two_words_is_near_linear():
    words = [b"a" if x else b"b" for x in np.random.default_rng(1).integers(0, 2, 300_000)]
    words[1000:200_000] = (words[1000:41_000] * 5)[:199_000]
    assert (1000, 199_000, 40_000) in [(max(s, 1000), length - (1000 - s) if s < 1000 else length, q) for s, length, q in P.runs_of(words)] \
        or any(q == 40_000 and s <= 1000 and s + length >= 200_000 for s, length, q in P.runs_of(words))


def test_query_equals_plain_program(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    odd = [None, "", "  \n", "a " * 30, "x\ty\n" * 12, "a b " * 25, " ".join(map(str, range(200))), "w " * 24, "w " * 23]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(odd * 12, 10**6)], docs.schema)
    docs.unionByName(more).unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in Q.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    want = [plain(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 20


def test_odd_tables(spark):
    odd = spark.createDataFrame([(None, "a " * 40, 1, "z"), (None, None, 2, "z")], "doc_id bigint, text string, runs int, n_words string")
    got = P.digest(P.detect(P.repeat_tails(odd))).collect()
    assert sorted((r["doc_id"], r["n_runs"], r["length"]) for r in got if r["n_runs"]) == [(None, 1, 40)] and len(got) == 2
    assert P.digest(P.detect(P.repeat_tails(odd.limit(0)))).count() == 0
