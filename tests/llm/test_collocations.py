"""Counts of the trie, and mined phrases against a plain program."""

import random
import re
from collections import Counter

from surveyloom.llm import collocations as C


def test_trie_counts_bursts_and_spills():
    rng = random.Random(4)
    trie, want, got = C.HatTrie(burst=8), Counter(), Counter()
    for _ in range(20_000):
        gram = tuple(rng.randrange(1, 6) for _ in range(rng.randrange(1, 6)))
        trie.add(gram, 2)
        want[gram] += 2
        if trie.entries > 900:
            for run in trie.spill(400):
                firsts = {g[0] for g, _ in run}
                assert len(firsts) == 1 and firsts.pop() not in trie.root
                for g, n in run:
                    got[g] += n
            assert trie.entries <= 400
    assert any(type(child) is dict for child in trie.root.values())
    for run in trie.spill(0):
        for g, n in run:
            got[g] += n
    assert got == want and trie.entries == 0 and not trie.root


def plain(rows, least, top):
    found = []
    for lang in {"und" if lang is None else lang for lang, _ in rows}:
        f, n = Counter(), 0
        for text in (t or "" for own, t in rows if ("und" if own is None else own) == lang):
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        often = [g for g in f if len(g) > 1 and f[g] >= least]
        inside = {}
        for g in often:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i:i + k]] = max(f[g], inside.get(g[i:i + k], 0))
        scored = []
        for g in often:
            if inside.get(g, 0) < f[g]:
                cut = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-cut[0], -f[g], " ".join(g).encode(), f[g[:cut[1]]], f[g[cut[1]:]]))
        found += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found)


ODD = [("en", None), ("en", ""), (None, "A b,a B.a\tb\x0ba b!c"), (None, None), ("", "x y x y"), ("en", "...!!"), ("en", "w " * 3000),
       ("é", "naïve Ärger naïve Ärger 日本 語 日本 語"), (None, "one two three " * 9)]


def test_phrases_equal_plain_program(spark):
    sample = [(r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000").collect()]
    rows = sample + ODD + ODD + sample[:20]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, gram string, n int").repartition(5)
    for least, top, room in ((2, 300, 500), (3, 50, 10**6), (100, 2000, 100)):
        got = sorted(tuple(r) for r in C.mine(docs, least, top=top, room=room).collect())
        assert got == plain(rows, least, top) and got


def test_long_texts_are_cut_at_breaks_only(spark, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c d e. f, g".split()) for _ in range(3000)) for _ in range(3)]
    lots = lambda size: (monkeypatch.setattr(C, "BLOCK", size), list(C._blocks(iter(
        [C.pa.RecordBatch.from_arrays([C.pa.array(["x"] * 3), C.pa.array([t.encode() for t in texts])], ["lang", "text"])]))))[1]
    counts = []
    for size in (50, 10**9):
        counter = C.Counter([], 1)
        total = Counter()
        for lot in lots(size):
            for _, data in lot:
                words = data.replace(b".", b" . ").split()
                total.update(zip(words, words[1:]))
        counts.append({p: n for p, n in total.items() if b"." not in p})
    assert counts[0] == counts[1] and counter is not None


def test_empty_table(spark):
    assert C.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
