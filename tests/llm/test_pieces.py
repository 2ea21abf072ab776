"""Round trips, and the search against all segmentations of short words."""

import zlib

import numpy as np
import public_tokenizers

from surveyloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  two  blanks ", "naïve café\n\ttab", "日本語 😀 ▁mark", "x" * 3000, "the then there the", "é" * 50]


def best(model, word):
    """Greatest sum of scores over all segmentations, prefix by prefix."""
    top = [0.0]
    for end in range(1, len(word) + 1):
        ways = [top[begin] + model.score[word[begin:end]][0] for begin in range(end) if word[begin:end] in model.score]
        top.append(max([*ways, top[end - 1] + model.fallback]))
    return top[-1]


def scored(model, ids, word):
    """The score of ids that spell ``word``; bytes of a character count once."""
    total, at = 0.0, 0
    while ids:
        if ids[0] in model.text:
            piece = model.text[ids.pop(0)]
            total += model.score[piece][0]
        else:
            piece = word[at]
            assert bytes(model.of_byte[i] for i in ids[:len(piece.encode())]) == piece.encode()
            del ids[:len(piece.encode())]
            total += model.fallback
        assert word.startswith(piece, at)
        at += len(piece)
    return total


def test_round_trip():
    model = P.Pieces(PATH)
    ids = model.encode(ODD)
    assert model.decode(ids) == [t or "" for t in ODD] and [model.decode([i])[0] for i in ids] == [t or "" for t in ODD]


def test_every_word_has_the_best_score(spark):
    model = P.Pieces(PATH)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    words = {w for t in texts for w in t.split(" ")} | {"the", "then", "qzxj", "éa", "😀日本", "a\n\tb", ""}
    found = model.search(list(words))
    assert found.keys() == words and len(words) > 50_000
    for w in words:
        assert abs(scored(model, np.frombuffer(found[w], "<i4").tolist(), P.MARK + w) - best(model, P.MARK + w)) < 1e-3, w


def test_frequent_words_stay_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "HELD", 50)
    model, asked = P.Pieces(PATH), []
    search = model.search
    monkeypatch.setattr(model, "search", lambda words: asked.extend(words) or search(words))
    for i in range(100):
        text = "the often met words " + " ".join(f"w{i}x{k}" for k in range(20))
        assert model.decode(model.encode([text])) == [text]
        assert len(model.young) <= 50 + 24 and len(model.old) <= 50 + 24
    assert asked.count("often") == 1 and len(asked) == 2004


def test_a_long_word_takes_time_in_proportion():
    text = "abcdefghij" * 40_000
    assert P.Pieces(PATH).decode(P.Pieces(PATH).encode([text])) == [text]


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, "y", 2)], "doc_id int, text string, ids string, n_ids int")
    got = P.decode(P.encode(rows, PATH), PATH)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, "a b"), (1, "a b")]
    assert P.digest(got).filter("doc_id IS NULL").first()["n_ids"] == 0
    assert P.digest(P.decode(P.encode(rows.limit(0), PATH), PATH)).count() == 0
    assert P.decode(P.encode(rows, PATH).selectExpr("doc_id", "cast(null AS binary) AS ids", "1 AS text"), PATH).count() == 3


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = P.encode(docs, PATH).collect()
    assert len(got) == len(want) and all(P.pieces(PATH).decode([bytes(r["ids"])]) == [want[r["doc_id"]]] for r in got)


def test_tables_decode_to_their_texts(spark):
    odd = [*ODD, "a\0b ▁ \0", "\0", "▁", " ▁\0▁ ", "\ufffd\uffff\U0010ffff"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(odd)] + [(None, "no id")], "doc_id bigint, text string")
    got = P.decode(P.encode(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = sorted((r["doc_id"], len(r["text"] or ""), zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    found = P.digest(P.decode(P.encode(docs, PATH), PATH)).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["text_crc32"]) for r in found) == want
