"""Exact groups of questions are made of digests, their lines are numbered without a sort of texts."""

from surveyloom.operators import questions as Q
from surveyloom.queries import question_forms as forms

SF = "/root/testdata/sf0.001"


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_lines_are_numbered_in_reading_order(spark, capsys):
    rows = forms.line_questions(spark, SF)
    want = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "posexplode(split(text, '\n'))").orderBy("doc_id", "pos").collect()
    got = rows.orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1, len(want) + 1))
    assert [(r.q_no, r.question_text) for r in got] == [(w.pos + 1, w.col) for w in want]
    assert "rangepartitioning" not in _plan(rows, capsys)


def test_texts_are_stored_once_and_grouped_by_digest(spark, monkeypatch):
    """What the tables of exact groups store and shuffle holds a text once, as it is and normalized."""
    stored = []
    cut = Q.cut_lineage
    for module in (Q, forms):
        monkeypatch.setattr(module, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    for query in (forms.canonical_question, forms.question_mapping_long, forms.mapping_wide):
        query(spark, SF).count()
    assert all({"comparison", "topic", "normalized_key"}.isdisjoint(columns) for columns in stored) and stored


def test_group_table_equals_numbers_and_representatives(spark):
    rows = [(1, "f1", "x", "a", 3, "单选题", "Same"), (2, "f2", "x", "b", 1, "单选题", "same:"), (3, "f3", "x", "b", 2, "单选题", "same"),
            (4, "f1", "y", "a", 1, "单选题", "same"), (5, "f1", "x", None, 9, "单选题", "other"), (6, "f2", "x", "c", 7, "单选题", "Other one"),
            (7, "f3", None, "c", 7, "单选题", "Other one"), (8, "f3", "x", "c", 8, "填空题", "")]
    questions = spark.createDataFrame(rows, "idx bigint, source_file string, role string, subject string, q_no bigint, question_type string, question_text string")
    columns = ["group_id", "norm_id", "subject_count", "match_method", "canonical_question"]
    old = Q.with_text_features(questions)
    old = old.join(Q.exact_groups(old).select("normalized_key", "group_id"), "normalized_key")
    want = Q.number_groups(old).join(Q.representatives(old).drop("representative"), "group_id").select(*columns).collect()
    members = Q.keyed(questions)
    groups = Q.exact_group_table(members)
    got = Q.canonical_questions(members, groups).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7
    mapped = {r.idx: (r.norm_id, r.canonical_question) for r in Q.exact_mapping(members, groups).collect()}
    assert mapped == {r.idx: (w.norm_id, w.canonical_question) for r in old.collect() for w in want if w.group_id == r.group_id}
