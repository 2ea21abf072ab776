"""Merging the same question across many forms.

Questions carry the features of ``questions.with_text_features`` plus signature
and signature_size. Pairs are handled between distinct keys or classes of equal
questions, each with the number of question pairs it stands for, so copies of a
question never multiply: a pair of keys held by millions of questions is one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveyloom import fixed_values as V
from surveyloom.functions import text
from surveyloom.operators import graph, questions as Q
from surveyloom.operators.ordering import number_globally
from surveyloom.operators.similarity import similar_char_sets, similar_pairs, text_cosine
from surveyloom.session import cut_lineage, shuffled

def block_of() -> Column:
    """Only questions of one role and type are ever compared."""
    return F.concat_ws("|", "role", "question_type")


# --- similar keys (near matches) ------------------------------------------------------------------

def distinct_keys(questions: DataFrame) -> DataFrame:
    """One row per normalized key: its first question, number of questions, and its
    only source where it has just one."""
    return questions.groupBy("normalized_key").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"), F.min("source_file").alias("low_source"),
        F.max("source_file").alias("high_source"), F.first("role").alias("role"), F.first("question_type").alias("question_type"),
        F.first("comparison").alias("comparison"), F.first("contrasts").alias("contrasts"))


def text_units(keys: DataFrame) -> DataFrame:
    return keys.groupBy(block_of().alias("block"), F.col("comparison").alias("text")).agg(F.min("first_idx").alias("unit"))


def similar_keys(questions: DataFrame, threshold: float = V.MATCH_THRESHOLD) -> DataFrame:
    """Pairs of keys with cosine ≥ threshold, fitting length, no opposing words, and
    questions in different files; a is the key seen first. ``question_pairs`` is
    the number of question pairs from different files."""
    keys = cut_lineage(distinct_keys(questions))
    units = text_units(keys)
    placed = keys.withColumn("block", block_of()).join(shuffled(units.withColumnRenamed("text", "comparison")), ["block", "comparison"])
    alike = cut_lineage(similar_pairs(units, threshold))  # read for the pairs and for the files they share
    # equal comparison texts of different keys are the one pair of a unit with itself
    same = units.filter(F.char_length("text") >= 2).select(F.col("unit").alias("unit_a"), F.col("unit").alias("unit_b"), F.lit(1.0).alias("similarity"))
    side = lambda s: placed.select(F.col("unit").alias(f"unit_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (
        "normalized_key", "first_idx", "low_source", "high_source", "contrasts", "n")])
    pairs = alike.unionByName(same).join(shuffled(side("a")), "unit_a").join(shuffled(side("b")), "unit_b")
    pairs = pairs.filter((F.col("unit_a") != F.col("unit_b")) | (F.col("first_idx_a") < F.col("first_idx_b")))
    one_file = ((F.col("low_source_a") == F.col("high_source_a")) & (F.col("low_source_b") == F.col("high_source_b"))
                & (F.col("low_source_a") == F.col("low_source_b")))
    kept = pairs.filter(~one_file & ~text.contrasts_conflict(F.col("contrasts_a"), F.col("contrasts_b")))
    swap = F.col("first_idx_a") > F.col("first_idx_b")
    ordered = kept.select(
        *[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
          for c in ("normalized_key", "first_idx", "n") for x, y in (("a", "b"), ("b", "a"))], "similarity")
    return _cross_file_pairs(ordered, questions)


def _cross_file_pairs(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """n_a · n_b less the pairs inside one file, from counts per key and file."""
    per_file = questions.groupBy("normalized_key", "source_file").agg(F.count(F.lit(1)).alias("k"))
    side = lambda s: per_file.select(F.col("normalized_key").alias(f"normalized_key_{s}"), "source_file", F.col("k").alias(f"k_{s}"))
    keys = ["normalized_key_a", "normalized_key_b"]
    inside = pairs.select(*keys).join(shuffled(side("a")), "normalized_key_a").join(
        shuffled(side("b")), ["normalized_key_b", "source_file"]).groupBy(
        *keys).agg(F.sum(F.col("k_a") * F.col("k_b")).alias("inside"))
    return pairs.join(shuffled(inside), keys, "left").withColumn(
        "question_pairs", F.col("n_a") * F.col("n_b") - F.coalesce("inside", F.lit(0))).drop("inside", "n_a", "n_b")


# --- classes and candidate pairs -----------------------------------------------------------------------

def question_classes(questions: DataFrame) -> DataFrame:
    """Questions equal in key, ordered components and blanks: one row each."""
    sign, size = F.coalesce("signature", F.lit("")), F.coalesce("signature_size", F.lit(0))
    return questions.groupBy("normalized_key", sign.alias("signature"), size.alias("signature_size"), "blanks").agg(
        F.min("idx").alias("class_idx"), F.min_by("source_file", "idx").alias("first_source"), F.count(F.lit(1)).alias("n"),
        F.first("question_type").alias("question_type"))


def class_pairs(key_pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Key pairs spread over the classes of both keys."""
    side = lambda s: classes.select(*[F.col(c).alias(f"{c}_{s}") for c in (
        "normalized_key", "signature", "signature_size", "blanks", "class_idx", "first_source", "question_type")])
    return key_pairs.select("normalized_key_a", "normalized_key_b", "similarity").join(shuffled(side("a")), "normalized_key_a").join(
        shuffled(side("b")), "normalized_key_b").drop("question_type_b").withColumnRenamed("question_type_a", "question_type")


def auto_edges(pairs: DataFrame) -> DataFrame:
    """Class pairs that merge without review: equal non-empty components, for blanks
    an equal number of them. Ordered by the first question pair they stand for."""
    fill = F.col("question_type") == V.FILL_TYPE
    same = (F.col("signature_a") == F.col("signature_b")) & (F.col("signature_size_a") > 0)
    reason = F.when(fill, "auto_fill_text_similar_same_blank_count").otherwise("auto_question_similar_options_identical")
    ok = F.when(fill, F.col("blanks_a") == F.col("blanks_b")).otherwise(same)
    swap = F.col("class_idx_a") > F.col("class_idx_b")
    side = lambda c, x, y: F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    return pairs.filter(ok).select(
        side("normalized_key", "a", "b").alias("a"), side("normalized_key", "b", "a").alias("b"),
        graph.at(F.least("class_idx_a", "class_idx_b"), F.greatest("class_idx_a", "class_idx_b")).alias("at"),
        "similarity", reason.alias("reason"))


def start_groups(questions: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(node = key, group, root): the exact groups, joined as reviewers said."""
    exact = questions.groupBy(F.col("normalized_key").alias("node")).agg(F.min("idx").alias("first"))
    if merged is None:
        return exact.select("node", F.col("first").alias("group"), F.col("first").alias("root"))
    joined = merged.select("node", F.col("group").alias("_g"), F.col("root").alias("_r"))
    return exact.join(shuffled(joined), "node", "left").select(
        "node", F.coalesce("_g", "first").alias("group"), F.coalesce("_r", "first").alias("root"))


def group_sources(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    held = questions.select(F.col("normalized_key").alias("node"), F.col("source_file").alias("source")).distinct()
    return held.join(shuffled(nodes.select("node", "group")), "node").select("group", "source").distinct()


def regroup(nodes: DataFrame, merge: graph.Merge) -> DataFrame:
    """Groups of all nodes after a merge; untouched members of a touched group move
    with it."""
    moved = merge.groups.select("node", F.col("group").alias("_to"), F.col("root").alias("_root"))
    targets = nodes.join(shuffled(moved), "node").groupBy("group").agg(F.min("_to").alias("_to"), F.min("_root").alias("_root"))
    return nodes.join(shuffled(targets), "group", "left").select(
        "node", F.coalesce("_to", "group").alias("group"), F.coalesce("_root", "root").alias("root"))


def merge_similar(questions: DataFrame, key_pairs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, graph.Merge, DataFrame]:
    """Auto merges in reading order. Returns all groups, the merge and its edges."""
    edges = cut_lineage(auto_edges(class_pairs(key_pairs, question_classes(questions))))
    merge = graph.merge_in_order(edges.select("a", "b", "at"), nodes, group_sources(questions, nodes), one_side_single=True)
    return regroup(nodes, merge), merge, edges


def review_candidates(questions: DataFrame, labelled: DataFrame, key_pairs: DataFrame, nodes: DataFrame,
                      merge: graph.Merge) -> DataFrame:
    """Class pairs for a reviewer: similar texts whose options differ slightly (or,
    for blanks, whose counts are at most one apart), looked at while one of both
    groups was still in a single file; merged pairs are left out."""
    classes = question_classes(questions)
    pairs = class_pairs(key_pairs, classes)
    fill = F.col("question_type") == V.FILL_TYPE
    close = (F.col("blanks_a") > 0) & (F.col("blanks_b") > 0) & (F.abs(F.col("blanks_a") - F.col("blanks_b")) <= 1)
    # identical components cannot be in a reviewable relation
    offered = cut_lineage(pairs.filter(F.when(fill, close).otherwise(F.col("signature_a") != F.col("signature_b"))).select(
        "*", F.col("class_idx_a").alias("idx_a"), F.col("class_idx_b").alias("idx_b")))
    keys = ["idx_a", "idx_b"]
    deltas = Q.multiset_deltas(offered.select(*keys), Q.label_counts(labelled))
    signs = classes.select(F.col("class_idx").alias("idx"), "signature")
    related = Q.option_relations(offered.drop("signature_a", "signature_b"), deltas, signs)
    slight = F.col("option_relation").isin("same_items_order_diff", "add_or_missing_1_2", "changed_1_2")
    first = _first_cross_pair(related.filter(fill | slight), questions)
    marks = start_marks(questions, nodes, merge)
    for side in "ab":
        first = first.join(shuffled(marks.select(F.col("node").alias(f"normalized_key_{side}"), F.col("joined_at").alias(f"joined_{side}"))),
                           f"normalized_key_{side}", "left")
    single = lambda s: F.col(f"joined_{s}").isNull() | (F.col(f"joined_{s}") >= F.col("at"))
    done = merge.accepted.select("at")
    reason = F.when(fill, F.lit("manual_fill_text_similar_blank_count_close")).otherwise(
        F.concat(F.lit("manual_question_similar_options_"), "option_relation"))
    return first.filter(single("a") | single("b")).join(shuffled(done), "at", "left_anti").select(
        F.col("at.i").alias("idx_a"), F.col("at.j").alias("idx_b"), F.round("similarity", 4).alias("similarity"),
        reason.alias("reason"), "option_relation", "question_type")


def start_marks(questions: DataFrame, nodes: DataFrame, merge: graph.Merge) -> DataFrame:
    """(node, joined_at): when each key's group first held two sources."""
    start = graph.at(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))
    sizes = group_sources(questions, nodes).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    touched = merge.groups.select("node", "joined_at").withColumn("_t", F.lit(True))
    groups = nodes.join(shuffled(sizes), "group").join(shuffled(touched), "node", "left")
    by_group = groups.filter("_t").groupBy("group").agg(F.min("joined_at").alias("_first"))
    return groups.join(shuffled(by_group), "group", "left").select(
        "node", F.coalesce("joined_at", "_first", F.when(F.col("n") > 1, start)).alias("joined_at"))


def _first_cross_pair(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``at``, the first question pair (i, j) of two classes that lies in
    different files. Only the first question of a class, and its first question in
    another file than that one, can take part."""
    classes = question_classes(questions).select("normalized_key", "signature", "blanks", "class_idx", "first_source")
    sign = F.coalesce("signature", F.lit(""))
    inside = questions.select("normalized_key", sign.alias("signature"), "blanks", "idx", "source_file")
    other = inside.join(shuffled(classes), ["normalized_key", "signature", "blanks"]).filter("source_file <> first_source").groupBy("class_idx").agg(
        F.min("idx").alias("other_idx"))
    joined = pairs
    for side in "ab":
        joined = joined.join(shuffled(other.select(F.col("class_idx").alias(f"class_idx_{side}"), F.col("other_idx").alias(f"other_{side}"))),
                             f"class_idx_{side}", "left")
    a, b = F.col("class_idx_a"), F.col("class_idx_b")
    pair = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), graph.at(F.least(x, y), F.greatest(x, y)))
    first = F.when(F.col("first_source_a") != F.col("first_source_b"), pair(a, b)).otherwise(
        F.least(pair(F.col("other_a"), b), pair(a, F.col("other_b"))))
    return joined.withColumn("at", first).filter("at IS NOT NULL")


def identical_option_groups(questions: DataFrame) -> DataFrame:
    """Questions of one role and type with equal non-empty options but different
    keys, from several files: the input of the meaning test. One row per class, not
    per pair, since a common option list (yes, no) may be in a third of all forms."""
    kept = questions.filter("signature_size > 0")
    groups = kept.groupBy("role", "question_type", "signature").agg(
        F.count_distinct("normalized_key").alias("keys"), F.count_distinct("source_file").alias("files")).filter("keys > 1 AND files > 1")
    classes = kept.groupBy("role", "question_type", "signature", "normalized_key").agg(
        F.min("idx").alias("class_idx"), F.count(F.lit(1)).alias("n"))
    return classes.join(shuffled(groups), ["role", "question_type", "signature"])


def meaning_test(pairs: DataFrame, vectors: DataFrame, verdicts: DataFrame, threshold: float = V.VECTOR_THRESHOLD) -> DataFrame:
    """Review decision of given pairs (a, b) with identical options: a verdict rules;
    else the dot product of the unit vectors; a pair without either is kept for
    review. ``vectors`` has (id, vector), one per distinct text."""
    joined = pairs.join(verdicts, ["a", "b"], "left")
    for side in "ab":
        joined = joined.join(vectors.select(F.col("id").alias(side), F.col("vector").alias(f"vector_{side}")), side, "left")
    dot = F.aggregate(F.zip_with("vector_a", "vector_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.when(F.col("should_merge").isNull() & F.col("vector_a").isNotNull() & F.col("vector_b").isNotNull(), dot)
    provider = F.when(F.col("should_merge").isNotNull(), "llm").when(cosine.isNotNull(), "embedding").otherwise("none")
    scored = joined.withColumn("cosine", cosine).withColumn("semantic_provider", provider)
    return scored.select(
        "a", "b", "semantic_provider", F.round("cosine", 4).alias("semantic_similarity"),
        F.when(F.col("semantic_provider") == "llm", F.col("should_merge")).when(
            F.col("semantic_provider") == "embedding", F.col("cosine") >= threshold).otherwise(True).alias("should_review"),
        F.when(F.col("semantic_provider") == "llm", "manual_identical_options_llm").when(
            F.col("semantic_provider") == "embedding", f"manual_identical_options_embedding_ge_{threshold:.2f}").otherwise(
            "manual_identical_options_no_semantic_model").alias("reason"))


# --- reviewers ---------------------------------------------------------------------------------------------

def reviewer_label(merge_id: Column, decision: Column, note: Column, has_merge_id: bool) -> Column:
    """Label of a reviewer row, NULL for none: digits name a merge, ``no`` and blank
    none; without a merge_id column also ``归一N`` inside the notes."""
    clean = lambda c: text.compact_text(c)
    digits = "^[0-9０-９]+$"
    numbered = lambda c: F.when(clean(c).rlike(digits), F.concat(F.lit("人工归一"), clean(c)))
    if has_merge_id:
        return numbered(merge_id)
    noted = lambda c: F.when(
        F.coalesce(c, F.lit("")).rlike(V.MERGE_NOTE_PATTERN), F.concat(F.lit("归一"), F.regexp_extract(c, V.MERGE_NOTE_PATTERN, 1)))
    return F.coalesce(numbered(decision), numbered(note), noted(decision), noted(note))


def reviewer_edges(rows: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewer rows (row_no, label, question_keys: array of (source_file, q_no))
    resolved to questions. Returns (edges, status rows). In a row of several keys
    the first found question is paired with each of the others."""
    keys = rows.filter("label IS NOT NULL").select("row_no", "label", F.posexplode("question_keys").alias("place", "key")).select(
        "row_no", "label", "place", "key.source_file", "key.q_no")
    known = questions.groupBy("source_file", "q_no").agg(F.max("idx").alias("idx"))
    found = keys.join(shuffled(known), ["source_file", "q_no"], "left")
    heads = found.filter("idx IS NOT NULL").groupBy("row_no").agg(
        F.min_by("idx", "place").alias("head"), F.min("place").alias("head_place"), F.count(F.lit(1)).alias("found"))
    status = found.groupBy("row_no", "label").agg(F.count("idx").alias("found")).withColumn(
        "status", F.when(F.col("found") >= 2, "ready").otherwise("question_not_found"))
    edges = found.filter("idx IS NOT NULL").join(shuffled(heads), "row_no").filter("place > head_place AND found >= 2").select(
        "row_no", "label", "place", F.col("head").alias("idx_a"), F.col("idx").alias("idx_b"))
    return edges, status


def applied_labels(edges: DataFrame) -> DataFrame:
    """Label per edge: one with several unconnected parts gets a running suffix, in
    order of their first row."""
    tagged = edges.withColumn("a", F.struct("label", F.col("idx_a").alias("idx"))).withColumn("b", F.struct("label", F.col("idx_b").alias("idx")))
    components = graph.connected_components(tagged.select("a", "b"))
    placed = tagged.join(shuffled(components.withColumnRenamed("node", "a")), "a")
    firsts = placed.groupBy("label", "component").agg(F.min(F.struct("row_no", "place")).alias("first"))
    numbered = number_globally(firsts, [F.col("label"), F.col("first")], "_n")
    spans = numbered.groupBy("label").agg(F.min("_n").alias("_low"), F.count(F.lit(1)).alias("parts"))
    named = numbered.join(spans, "label").withColumn("applied_label", F.when(F.col("parts") == 1, F.col("label")).otherwise(
        F.concat("label", F.lit("-"), (F.col("_n") - F.col("_low") + 1).cast("string"))))
    return placed.join(named.select("label", "component", "applied_label"), ["label", "component"]).select(
        "row_no", "label", "place", "idx_a", "idx_b", "applied_label")


def merge_reviewed(questions: DataFrame, labelled_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewer edges in order of label, part and row; an edge that would bring two
    questions of one file together is skipped. Returns groups and the audit rows."""
    label_first = labelled_edges.groupBy("label").agg(F.min(F.struct("row_no", "place")).alias("label_first"))
    part_first = labelled_edges.groupBy("applied_label").agg(F.min(F.struct("row_no", "place")).alias("part_first"))
    ordered = labelled_edges.join(label_first, "label").join(part_first, "applied_label")
    numbered = cut_lineage(number_globally(ordered, [F.col(c) for c in ("label_first", "part_first", "row_no", "place")], "i"))
    keyed = questions.select("idx", "normalized_key")
    edges = numbered
    for side in "ab":
        edges = edges.join(shuffled(keyed.select(F.col("idx").alias(f"idx_{side}"), F.col("normalized_key").alias(side))), f"idx_{side}")
    edges = edges.withColumn("at", graph.at(F.col("i"), F.lit(0).cast("bigint")))
    nodes = start_groups(questions)
    merge = graph.merge_in_order(edges.select("a", "b", "at"), nodes, group_sources(questions, nodes), one_side_single=False)
    done = merge.accepted.select("at", F.lit("applied").alias("status"))
    audit = edges.join(shuffled(done), "at", "left").select(
        "applied_label", "row_no", "idx_a", "idx_b",
        F.coalesce("status", F.lit("skipped_same_source_or_already_merged")).alias("status"))
    return regroup(nodes, merge), audit


# --- groups against groups ---------------------------------------------------------------------------------

REP_COLUMNS = ["role", "question_type", "question_text", "normalized_text", "comparison", "topic", "contrasts", "time_contrasts",
               "signature", "signature_size", "blanks"]


def faces(questions: DataFrame) -> DataFrame:
    """Distinct appearances a question can represent its group with."""
    filled = questions.withColumns({"signature": F.coalesce("signature", F.lit("")), "signature_size": F.coalesce("signature_size", F.lit(0))})
    return filled.groupBy("role", "question_type", "question_text", "signature", "blanks").agg(
        F.min("idx").alias("face"), *[F.first(c).alias(c) for c in REP_COLUMNS if c not in (
            "role", "question_type", "question_text", "signature", "blanks")])


def _units(rows: DataFrame, block: Column, column: str) -> tuple[DataFrame, DataFrame]:
    """(units, rows with their unit): rows of one block and text share a unit."""
    blocked = rows.withColumn("block", block)
    units = blocked.groupBy("block", F.col(column).alias("text")).agg(F.min("face").alias("unit"))
    return units, blocked.select("face", "block", F.col(column).alias("text")).join(shuffled(units), ["block", "text"]).select("face", "unit")


def _spread(unit_pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Unit pairs, and each unit with itself, as face pairs (a < b)."""
    own = placed.select(F.col("unit").alias("unit_a"), F.col("unit").alias("unit_b")).distinct()
    both = unit_pairs.select("unit_a", "unit_b").unionByName(own)
    side = lambda s: placed.select(F.col("unit").alias(f"unit_{s}"), F.col("face").alias(s))
    spread = both.join(shuffled(side("a")), "unit_a").join(shuffled(side("b")), "unit_b").filter("a <> b")
    return spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def face_scores(pairs: DataFrame, all_faces: DataFrame) -> DataFrame:
    """Similarity, topic similarity and topic Jaccard of face pairs (a, b)."""
    side = lambda s: all_faces.select(F.col("face").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in (
        "comparison", "topic", "contrasts", "time_contrasts", "signature", "signature_size", "blanks", "question_type", "role")])
    both = pairs.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b")
    return both.withColumns({
        "similarity": text_cosine(F.col("comparison_a"), F.col("comparison_b")), "topic_similarity": text_cosine(F.col("topic_a"), F.col("topic_b")),
        "topic_jaccard": text.char_jaccard(F.col("topic_a"), F.col("topic_b"))}).drop("comparison_a", "comparison_b")


def mergeable_faces(all_faces: DataFrame) -> DataFrame:
    """Face pairs whose groups merge on sight: equal non-empty options (or blanks),
    no opposing words, and similar texts or identical topics."""
    fill = F.col("question_type") == V.FILL_TYPE
    able = all_faces.filter(fill | (F.col("signature_size") > 0))
    block = F.concat_ws("|", "role", "question_type", F.when(fill, F.col("blanks").cast("string")).otherwise(F.col("signature")))
    parts = []
    for column, threshold in (("comparison", V.GROUP_AUTO_SIMILARITY), ("topic", V.GROUP_AUTO_TOPIC_SIMILARITY)):
        units, placed = _units(able, block, column)
        parts.append(_spread(similar_pairs(units, threshold, ratio=None), placed))
    scored = face_scores(cut_lineage(parts[0].unionByName(parts[1]).distinct()), all_faces)
    close = (F.col("similarity") >= V.GROUP_AUTO_SIMILARITY) | (
        (F.col("topic_jaccard") >= V.GROUP_AUTO_TOPIC_JACCARD) & (F.col("topic_similarity") >= V.GROUP_AUTO_TOPIC_SIMILARITY))
    opposed = text.contrasts_conflict(F.col("contrasts_a"), F.col("contrasts_b")) | text.contrasts_conflict(
        F.col("time_contrasts_a"), F.col("time_contrasts_b"))
    reason = F.when(F.col("similarity") >= V.GROUP_AUTO_SIMILARITY, "auto_group_text_similar_components_identical").otherwise(
        "auto_group_topic_identical_components_identical")
    return scored.filter(close & ~opposed).select("a", "b", "similarity", "topic_similarity", "topic_jaccard", reason.alias("reason"))


def group_faces(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, root, face) of the representatives."""
    members = questions.join(shuffled(groups.select(F.col("node").alias("normalized_key"), "group", "root")), "normalized_key").withColumnRenamed("group", "group_id")
    reps = Q.representatives(members)
    roots = groups.groupBy(F.col("group").alias("group_id")).agg(F.min("root").alias("root"))
    sign = F.coalesce("signature", F.lit(""))
    looks = questions.select("idx", "role", "question_type", "question_text", sign.alias("signature"), "blanks")
    every = faces(questions).select("role", "question_type", "question_text", "signature", "blanks", "face")
    faced = looks.join(shuffled(every), ["role", "question_type", "question_text", "signature", "blanks"]).select(F.col("idx").alias("representative"), "face")
    return reps.join(shuffled(faced), "representative").join(shuffled(roots), "group_id").select(F.col("group_id").alias("group"), "root", "face")


#: Rows (texts, files, pairs) of a part of groups that one task merges by itself.
REPLAY_ROWS = 200_000
_REPLAY = "kind string, `group` bigint, root bigint, other bigint, similarity double, reason string"


def potential_pairs(able: DataFrame, of_face: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, similarity, reason, group_a, group_b): face pairs of two groups that share no
    file. Groups only grow, so two groups can merge at some time only if such a pair
    of theirs exists; a face belongs to one group."""
    side = lambda s: of_face.select(F.col("face").alias(s), F.col("group").alias(f"group_{s}"))
    faced = able.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").filter("group_a <> group_b")
    shared = (faced.select("group_a", "group_b").distinct().join(shuffled(held.withColumnRenamed("group", "group_a")), "group_a")
              .join(shuffled(held.withColumnRenamed("group", "group_b")), ["group_b", "source"], "left_semi").select("group_a", "group_b").distinct())
    return faced.join(shuffled(shared), ["group_a", "group_b"], "left_anti")


def merged_part(roots: dict, texts: dict, held: dict, able: dict) -> tuple[list, dict]:
    """Merges one part: always the pair of least roots (low, high) whose representatives can
    merge and which share no file. roots: group → root; texts: group → text → (n,
    length, q_no, idx, face); held: group → files; able: face → face → (similarity,
    reason). Returns the merges (root_a, root_b, similarity, reason) and group → group
    it is now in; ``roots`` keeps the groups that are left."""
    shown = lambda g: max(texts[g].values(), key=lambda t: (t[0], t[1], -t[2], -t[3]))[4]
    face = {g: shown(g) for g in roots}
    at = {f: g for g, f in face.items()}
    waiting, done, into = [], [], {g: g for g in roots}

    def offer(g):
        for f in able.get(face[g], ()):
            h = at.get(f)
            if h is not None:
                low, high = sorted((g, h), key=roots.__getitem__)
                heapq.heappush(waiting, (roots[low], roots[high], low, high, face[low], face[high]))
    for g in roots:
        offer(g)
    while waiting:
        root_a, root_b, low, high, fa, fb = heapq.heappop(waiting)
        if roots.get(low) != root_a or roots.get(high) != root_b or face[low] != fa or face[high] != fb or held[low] & held[high]:
            continue
        done.append((root_a, root_b, *able[fa][fb]))
        held[low] |= held.pop(high)
        for text, t in texts.pop(high).items():
            own = texts[low].get(text)
            texts[low][text] = t if own is None else (own[0] + t[0], own[1], *min(own[2:], t[2:]))
        into[high] = low
        del roots[high], at[fb], at[fa]
        face[low] = shown(low)
        at[face[low]] = low
        offer(low)
    for g in into:
        while into[g] != into[into[g]]:
            into[g] = into[into[g]]
    return done, into


def _merged_part(rows: pd.DataFrame) -> pd.DataFrame:
    of = {kind: part for kind, part in rows.groupby("kind")}
    roots = dict(zip(of["group"]["group"].astype(int).tolist(), of["group"]["root"].astype(int).tolist()))
    texts, held, able = {g: {} for g in roots}, {g: set() for g in roots}, {}
    for r in of["text"].itertuples():
        texts[int(r.group)][r.name] = (int(r.n), int(r.length), int(r.q_no), int(r.idx), int(r.a))
    for r in of["file"].itertuples():
        held[int(r.group)].add(r.name)
    for r in of["pair"].itertuples():
        able.setdefault(int(r.a), {})[int(r.b)] = able.setdefault(int(r.b), {})[int(r.a)] = (r.similarity, r.name)
    first = dict(roots)
    done, into = merged_part(roots, texts, held, able)
    out = [("merge", a, None, b, similarity, reason) for a, b, similarity, reason in done]
    out += [("move", g, roots[h], h, None, None) for g, h in into.items() if first[g] != roots[h] or g != h]
    return pd.DataFrame(out, columns=["kind", "group", "root", "other", "similarity", "reason"]).astype({"root": "Int64", "other": "Int64"})


def merge_groups(questions: DataFrame, groups: DataFrame, replay_rows: int = REPLAY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Repeatedly merge the first mergeable pair of groups, by their representatives,
    until none is left: (groups, merges). A null or empty table gives no merge.

    The pairs that can ever merge are known beforehand, since a representative is always
    one of the questions. By them the groups fall into parts that never meet. A part
    of at most ``replay_rows`` rows is merged to its end by one task, in one round
    for all such parts however long their chains are. Only a larger part goes on by
    its first pair; each such round its pairs are taken anew, less those whose groups
    share a file by now, so it falls apart until its parts fit a task."""
    shown = cut_lineage(faces(questions))
    able = cut_lineage(mergeable_faces(shown))
    sign = F.coalesce("signature", F.lit(""))
    looks = ["role", "question_type", "question_text", "signature", "blanks"]
    every = shown.select(*looks, "face")
    usable = able.select(F.explode(F.array("a", "b")).alias("face")).distinct()
    faced = questions.select("normalized_key", "role", "question_type", "question_text", sign.alias("signature"), "blanks", "q_no", "idx",
                             "source_file").join(shuffled(every), looks)
    keys = faced.join(shuffled(usable), "face", "left_semi").select(F.col("normalized_key").alias("node")).distinct()
    touched = groups.join(shuffled(keys), "node", "left_semi").select("group").distinct()
    small = cut_lineage(groups.join(shuffled(touched), "group", "left_semi"))  # only groups that hold such a question take part
    faced = cut_lineage(faced.join(shuffled(small.select(F.col("node").alias("normalized_key"))), "normalized_key", "left_semi"))
    merges, moves = [], []
    while True:
        placed = faced.join(shuffled(small.select(F.col("node").alias("normalized_key"), "group", "root")), "normalized_key")
        held = cut_lineage(placed.select("group", F.col("source_file").alias("source")).distinct())
        texts = cut_lineage(placed.groupBy("group", "question_text").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("q_no", "idx", "face")).alias("first")).select(
                "group", "question_text", "n", F.char_length("question_text").alias("length"), "first.*"))
        open_ = cut_lineage(potential_pairs(able, placed.select("face", "group").distinct(), held))
        if open_.limit(1).count() == 0:
            break
        parts = cut_lineage(graph.connected_components(open_.select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))).select(
            F.col("node").alias("group"), F.col("component").alias("part")))
        roots = small.groupBy("group").agg(F.min("root").alias("root"))
        none = lambda kind: F.lit(None).cast(kind)
        row = lambda kind, df, **c: df.join(shuffled(parts), "group").select(
            "part", F.lit(kind).alias("kind"), "group", *[c.get(k, none(t)).alias(k) for k, t in (
                ("root", "bigint"), ("name", "string"), ("n", "bigint"), ("length", "int"), ("q_no", "bigint"), ("idx", "bigint"),
                ("a", "bigint"), ("b", "bigint"), ("similarity", "double"))])
        rows = row("group", roots, root=F.col("root")).unionByName(
            row("text", texts, name=F.col("question_text"), n=F.col("n"), length=F.col("length"), q_no=F.col("q_no").cast("bigint"),
                idx=F.col("idx").cast("bigint"), a=F.col("face").cast("bigint"))).unionByName(
            row("file", held, name=F.col("source"))).unionByName(
            row("pair", open_.withColumnRenamed("group_a", "group"), name=F.col("reason"), a=F.col("a").cast("bigint"),
                b=F.col("b").cast("bigint"), similarity=F.col("similarity")))
        rows = cut_lineage(rows)
        fits = cut_lineage(rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).withColumn("fits", F.col("_n") <= replay_rows).drop("_n"))
        ended = cut_lineage(rows.join(shuffled(fits.filter("fits")), "part", "left_semi").groupBy("part").applyInPandas(_merged_part, _REPLAY))
        merges.append(ended.filter("kind = 'merge'").select(
            F.col("group").alias("root_a"), F.col("other").alias("root_b"), "similarity", "reason"))
        moves.append(small.join(shuffled(ended.filter("kind = 'move'").select("group", F.col("other").alias("_g"), F.col("root").alias("_r"))), "group").select(
            "node", "_g", "_r"))
        large = cut_lineage(parts.join(shuffled(fits.filter("NOT fits")), "part").select("group", "part"))
        if large.limit(1).count() == 0:
            break
        small, best = _first_merges(small.join(shuffled(large.select("group")), "group", "left_semi"), large, texts, roots, open_)
        merges.append(best.select("root_a", "root_b", "similarity", "reason"))
        moves.append(small.select("node", F.col("group").alias("_g"), F.col("root").alias("_r")))
        faced = cut_lineage(faced.join(shuffled(small.select(F.col("node").alias("normalized_key"))), "normalized_key", "left_semi"))
    if not merges:
        return groups, able.select(F.col("a").alias("root_a"), F.col("b").alias("root_b"), "similarity", "reason").limit(0)
    # a node's last move counts
    last = reduce(DataFrame.unionByName, [m.withColumn("_round", F.lit(k)) for k, m in enumerate(moves)]).groupBy("node").agg(
        F.max_by(F.struct("_g", "_r"), "_round").alias("_m"))
    final = groups.join(shuffled(last), "node", "left").select("node", F.coalesce("_m._g", "group").alias("group"), F.coalesce("_m._r", "root").alias("root"))
    return cut_lineage(final), reduce(DataFrame.unionByName, merges)


def _first_merges(small: DataFrame, parts: DataFrame, texts: DataFrame, roots: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first pair of every part, merged; parts without one come to rest."""
    rank = F.struct((-F.col("n")).alias("c"), (-F.col("length")).alias("l"), "q_no", "idx")
    reps = texts.groupBy("group").agg(F.min_by("face", rank).alias("face")).join(shuffled(roots), "group")
    side = lambda s: reps.select(F.col("group").alias(f"group_{s}"), F.col("face").alias(s), F.col("root").alias(f"root_{s}"))
    actual = open_.join(shuffled(side("a")), ["group_a", "a"]).join(shuffled(side("b")), ["group_b", "b"]).join(shuffled(parts.withColumnRenamed("group", "group_a")), "group_a")
    rising = F.col("root_a") < F.col("root_b")
    pick = lambda x, y, name: F.when(rising, F.col(x)).otherwise(F.col(y)).alias(name)
    low, high = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
    best = cut_lineage(actual.groupBy("part").agg(F.min_by(F.struct(
        pick("group_a", "group_b", "keep"), pick("group_b", "group_a", "drop"), low.alias("root_a"), high.alias("root_b"), "similarity", "reason"),
        F.struct(low, high)).alias("e")).select("part", "e.*"))
    moved = best.select(F.col("drop").alias("group"), F.col("keep").alias("_to"), F.col("root_a").alias("_root"))
    going = parts.join(shuffled(best.select("part")), "part", "left_semi").select("group")
    small = cut_lineage(small.join(shuffled(going), "group", "left_semi").join(shuffled(moved), "group", "left").select(
        "node", F.coalesce("_to", "group").alias("group"), F.coalesce("_root", "root").alias("root")))
    return small, best


def reviewable_group_pairs(questions: DataFrame, labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of final groups for a reviewer: disjoint files, no opposing words, near
    options (or blanks), and similar texts or topics. Pairs with equal options but
    unlike texts are left to ``identical_option_groups`` and the meaning test."""
    all_faces = cut_lineage(faces(questions))
    reps = cut_lineage(group_faces(questions, groups))
    shown = all_faces.join(shuffled(reps.select("face").distinct()), "face", "left_semi")
    fill = F.col("question_type") == V.FILL_TYPE
    counts = cut_lineage(Q.label_counts(Q.hashed_labels(labelled).join(shuffled(shown.select(F.col("face").alias("idx"))), "idx", "left_semi")))
    # A pair must have near options and alike texts, so texts are compared under a tag:
    # of the three rarest labels of either side one is shared, since two labels may
    # differ. Lists that share no label are near only where one is empty and the other has
    # two entries at most: those share one common tag, and so do blanks.
    base = shown.select(F.col("face").alias("idx"), block_of().alias("block"))
    posted = counts.join(shuffled(base), "idx")
    label = F.concat_ws("|", "component_type", "label_key")
    frequency = posted.groupBy("block", label.alias("tag")).agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("idx").orderBy("df", "tag"))
    rare = posted.withColumn("tag", label).join(shuffled(frequency), ["block", "tag"]).withColumn("_p", rank).filter("_p <= 3")
    bare = shown.filter(fill | (F.col("signature_size") <= 2)).select(
        F.col("face").alias("unit"), F.lit("").alias("tag"), (~fill & (F.col("signature_size") > 0)).alias("apart"))
    tags = cut_lineage(rare.select(F.col("idx").alias("unit"), "tag", F.lit(False).alias("apart")).unionByName(bare))
    units = lambda c: shown.select(F.col("face").alias("unit"), block_of().alias("block"), F.col(c).alias("text")).join(
        shuffled(tags), "unit").select("unit", F.concat_ws("|", "block", "tag").alias("block"), "text", "apart")
    by_gram = similar_pairs(units("comparison"), V.GROUP_REVIEW_SIMILARITY, ratio=None)
    by_char = similar_char_sets(units("topic"), V.GROUP_REVIEW_TOPIC_JACCARD)
    pairs = cut_lineage(by_gram.unionByName(by_char).select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b")).distinct())
    keys = ["idx_a", "idx_b"]
    named = pairs.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"))
    signs = all_faces.select(F.col("face").alias("idx"), "signature")
    related = Q.option_relations(named, Q.multiset_deltas(named, counts), signs).select(
        F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), "option_relation")
    near = F.col("option_relation").isin("identical", "same_items_order_diff", "add_or_missing_1_2", "changed_1_2")
    slim = related.join(shuffled(all_faces.select(F.col("face").alias("a"), "question_type", F.col("blanks").alias("ba"))), "a").join(
        shuffled(all_faces.select(F.col("face").alias("b"), F.col("blanks").alias("bb"))), "b").filter(
        F.when(fill, F.abs(F.col("ba") - F.col("bb")) <= 1).otherwise(near)).select("a", "b", "option_relation")
    # reps of different groups may look the same: their faces pair with themselves
    twin = reps.groupBy("face").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("face").alias("a"), F.col("face").alias("b"), F.lit("identical").alias("option_relation"))
    slim = cut_lineage(slim.unionByName(twin))
    scored = face_scores(slim, all_faces)
    alike = (F.col("similarity") >= V.GROUP_REVIEW_SIMILARITY) | (F.col("topic_jaccard") >= V.GROUP_REVIEW_TOPIC_JACCARD)
    kept = scored.filter(alike & ~text.contrasts_conflict(F.col("contrasts_a"), F.col("contrasts_b")))
    side = lambda s: reps.select(F.col("face").alias(s), F.col("group").alias(f"group_{s}"), F.col("root").alias(f"root_{s}"))
    faced = kept.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").filter(
        (F.col("group_a") != F.col("group_b")) & ((F.col("a") != F.col("b")) | (F.col("root_a") < F.col("root_b"))))
    held = cut_lineage(group_sources(questions, groups))
    shared = (faced.select("group_a", "group_b").join(shuffled(held.withColumnRenamed("group", "group_a")), "group_a")
              .join(shuffled(held.withColumnRenamed("group", "group_b")), ["group_b", "source"], "left_semi").select("group_a", "group_b").distinct())
    reason = F.when(F.col("question_type_a") == V.FILL_TYPE, F.lit("manual_group_fill_similar_blank_count_close")).otherwise(
        F.concat(F.lit("manual_group_question_similar_options_"), "option_relation"))
    return faced.join(shuffled(shared), ["group_a", "group_b"], "left_anti").select(
        F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b"), reason.alias("reason"),
        "option_relation", F.round("similarity", 4).alias("similarity"), F.round("topic_similarity", 4).alias("topic_similarity"),
        F.round("topic_jaccard", 4).alias("topic_jaccard"))


# --- review workbook ---------------------------------------------------------------------------------------------

def review_clusters(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """One summary row per connected cluster of review pairs (idx_a, idx_b,
    similarity, reason, option_relation)."""
    labels = graph.connected_components(pairs.select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b")))
    of_pair = pairs.join(labels.withColumnRenamed("node", "idx_a"), "idx_a")
    has = lambda c, w: F.max(F.col(c).contains(w))
    logic = [has(c, w).alias(f"_l{i}") for i, (c, w, _) in enumerate(V.REVIEW_LOGIC)]
    summary = of_pair.groupBy("component").agg(
        F.count(F.lit(1)).alias("pair_count"), F.max("similarity").alias("max_similarity"),
        F.array_join(F.array_sort(F.collect_set("reason")), " | ").alias("reason_summary"),
        F.array_join(F.array_sort(F.collect_set("option_relation")), " | ").alias("option_relation_summary"), *logic)
    seen = F.concat(F.coalesce("subject", F.lit("")), F.lit("#"), F.coalesce(F.col("q_no").cast("string"), F.lit("")), F.lit(": "),
                    F.coalesce("question_text", F.lit("")))
    members = labels.join(questions.select(F.col("idx").alias("node"), seen.alias("_seen"), "subject", "q_no"), "node")
    risky = [F.max(F.lit(False) | _any(words)).alias(f"_r{i}") for i, (words, _) in enumerate(V.RISK_FLAGS)]
    sizes = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("question_count"), F.min(F.struct("subject", "q_no")).alias("first"), *risky)
    words = lambda entries, prefix: F.concat_ws("；", *[
        F.when(F.col(f"{prefix}{i}"), F.lit(e[-1])) for i, e in enumerate(entries)])
    risk = words(V.RISK_FLAGS, "_r")
    return summary.join(sizes, "component").select(
        "component", "pair_count", "question_count", "max_similarity", "reason_summary", "option_relation_summary",
        words(V.REVIEW_LOGIC, "_l").alias("review_logic"), risk.alias("risk_flags"),
        F.when(risk != "", "人工判断后再归一").otherwise("确认是否归一").alias("suggested_action"),
        F.col("first.subject").alias("first_subject"), F.col("first.q_no").alias("first_q_no"))


def _any(words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.col("_seen").contains(word)
    return hit
