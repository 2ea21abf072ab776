"""Each stage of the pipeline against its operator or a plain program, over what the stage before kept."""

import os
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from surveyloom.llm import quality, toxicity  # noqa: E402
from surveyloom.session import cut_lineage  # noqa: E402
from test_minhash import brute  # noqa: E402
from test_native import base_spans  # noqa: E402

SF = "/root/testdata/sf0.001"


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(cut_lineage(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == docs.columns
    start, good, mild, single, clean = map(texts, kept)
    assert set(good) == {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()} and len(good) < len(start)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert set(mild) == {r["doc_id"] for r in toxicity.score(kept[1], labels).filter("score < 0.3").collect()}
    assert set(single) == {i for i, _, _, first in brute(list(mild.items()), 5, 80) if first}
    assert set(clean) == set(single) and all(good[i] == start[i] == mild[i] for i in mild)
    for i, text in clean.items():
        assert not any(base_spans(text)) and (text == single[i] or any(base_spans(single[i])) or "[SECRET]" in text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(clean)
    for i, parts in pieces.items():
        ids, at = [*tokenizer.encode(re.sub("\x00", "", clean[i]), add_special_tokens=False).ids, 2], 0
        for start_at, length, crc in sorted(parts):
            assert start_at == at and crc == zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
