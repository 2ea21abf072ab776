"""Packed sequences give back every document's ids; the curve is one step at a time."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from surveyloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "<|endoftext|> x<|startoftext|>", "naïve café's don't i'll", "tab\tnl\n\x0b\x0cé́é", "\x1c\x1d a b　c \x85",
       "İstanbul ſt ǅ ŉ ß ẞ", "日本語 テキスト 123abc", "x" * 30000, "w1 w2 " * 9000, "...!!!", "-- (a) 'tis", "ﬁ ℌ Å", "e" + "́" * 5, "😀👍🏽 ok", "dup", "dup"]


def pieces_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, ids string, _row int")
    pieces = packing.pack(docs, PATH)
    return pieces, pieces.collect()


def check(spark, rows):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)
    pieces, got = pieces_of(spark, rows)
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for i, docs in by_id.items():
        if len(docs) == 1:
            at = 0
            for start, ids, n in sorted(parts[i]):
                assert start == at and docs[0][start:start + len(ids)] == ids and n == len(docs[0])
                at += len(ids)
            assert at == len(docs[0])
        else:
            assert sum(len(x[1]) for x in parts[i]) == sum(map(len, docs))
    assert sum(r["length"] for r in got) == sum(map(len, want))
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(pieces).collect() if len(by_id[r["doc_id"]]) == 1}
    for r in got:
        if len(by_id[r["doc_id"]]) == 1:
            wide = np.frombuffer(bytes(r["ids"]), "<u2").astype("<u4").tobytes()
            assert crc[r["doc_id"], r["start"]] == zlib.crc32(wide)


def test_odd_texts(spark):
    check(spark, [*enumerate(ODD), (None, "no id"), (17, "again"), (17, "again")])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(spark):
    assert pieces_of(spark, [])[1] == []


def test_copies_lie_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()
    _, got = pieces_of(spark, [(r["doc_id"] + 1000 * k, r["text"]) for r in docs for k in (0, 1)])
    first = {r["doc_id"]: r["sequence_id"] for r in got if r["start"] == 0}
    apart = [abs(first[i] - first[i + 1000]) for i in first if i < 1000]
    assert np.mean([a <= 12 for a in apart]) > 0.95


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve(d, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=d)))
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
