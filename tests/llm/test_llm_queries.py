"""The registered queries: the SQL of those that have one, and the contract's columns of all."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check_queries  # noqa: E402
from surveyloom.llm import queries as llm  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "op1": "vec_id n_links component_id kept", "op2": "doc_id held_out score predicted",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "doc_id held_out n_tokens n_known train_tokens base_score score", "op5": "doc_id n_shingles component_id kept",
    "op6": "page_id text", "op7": "doc_id n_ids ids_crc32", "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10": "page_id host path rule verdict",
    "op11": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op12": "lang rank phrase a l r n score",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"}


@pytest.mark.parametrize("name", list(llm.CHECKS))
def test_equals_sql(spark, name):
    df = llm.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = check_queries.connect(SF).execute(llm.CHECKS[name])
    columns = [d[0] for d in cur.description]
    want_c, want = check_queries.sorted_rows(columns, cur.fetchall())
    got_c, got = check_queries.sorted_rows(df.columns, got)
    assert got_c == want_c and got == want


def test_columns(spark):
    for name, query in llm.QUERIES.items():
        got = query(spark, "/root/testdata/sf0.001").columns
        want = COLUMNS[name.split("_")[0]].split()
        assert got[:len(want)] == want, name
