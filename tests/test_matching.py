"""Distributed question matching against sequential merging of its edges, and what must hold of any result."""

import random

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import graph, matching as M, questions as Q, similarity
from surveyloom.session import cut_lineage

OPENINGS = ["学校是否按照国家课程方案的要求安排课程并且落实日常管理制度以及质量监测与反馈改进机制的具体做法",
            "课堂上使用多媒体设备支持小组合作与探究活动的频率如何以及同伴互评在课后作业中的实际应用程度"]
OPTION_SETS = [["从不", "偶尔", "经常", "总是"], ["是", "否"], ["偶尔", "从不", "经常", "总是"], ["从不", "偶尔", "经常"],
               ["从不", "偶尔", "时常", "总是"], []]


def random_forms(seed, n=56, files=12):
    rng = random.Random(seed)
    questions, components = [], []
    for i in range(n):
        text = rng.choice(OPENINGS)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["的", "了", "学", "教", "？", ""]) + text[k + 1:]
        kind = rng.choice(["单选题", "单选题", "单选题", "填空题"])
        text = rng.choice(["语文", "数学", "", ""]) + text + rng.choice(["", "", "", "上学期", "下学期"])
        if kind == "填空题":
            text += "____" * 1 + rng.choice(["", " ___"])
        questions.append((i, f"f{rng.randrange(files)}", rng.choice(["教师", "教师", "学生"]), "历史", i + 1, kind, text))
        if kind != "填空题":
            for order, label in enumerate(rng.choice(OPTION_SETS[:3] + OPTION_SETS), 1):
                components.append((i, "option", label, order))
    return questions, components


def load(spark, seed):
    rows, parts = random_forms(seed)
    questions = spark.createDataFrame(rows, "idx bigint, source_file string, role string, subject string, q_no bigint, question_type string, question_text string")
    labelled = Q.with_labels(spark.createDataFrame(parts, "idx bigint, component_type string, component_label string, option_order bigint"))
    full = cut_lineage(Q.with_text_features(questions).join(Q.signatures(labelled), "idx", "left"))
    labels = {}
    for r in sorted(labelled.collect(), key=lambda r: (r.idx, r.option_order)):
        labels.setdefault(r.idx, []).append(r.label_key)
    plain = [dict(r.asDict(), labels=labels.get(r.idx, [])) for r in full.orderBy("idx").collect()]
    return full, cut_lineage(labelled), plain


def merged_in_order(nodes, edges, gate):
    """Sets of files per node, merged edge by edge while they share none (and, with the
    gate, while one of both holds a single file). edges: (order, a, b)."""
    group, files = {n: n for n in nodes}, {n: set(f) for n, f in nodes.items()}
    taken = []
    for order, a, b in sorted(edges):
        x, y = group[a], group[b]
        if x != y and not files[x] & files[y] and not (gate and min(len(files[x]), len(files[y])) > 1):
            group = {n: x if g == y else g for n, g in group.items()}
            files[x] |= files.pop(y)
            taken.append(order)
    return group, taken


def partition(pairs):
    parts = {}
    for node, group in pairs:
        parts.setdefault(group, set()).add(node)
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize("seed", [3, 11])
def test_whole_matching(spark, seed):
    questions, labelled, plain = load(spark, seed)
    of_key = {}
    for p in plain:
        of_key.setdefault(p["normalized_key"], set()).add(p["source_file"])
    similar = cut_lineage(M.similar_keys(questions, 0.88))
    nodes = cut_lineage(M.start_groups(questions))
    after, merge, edges = M.merge_similar(questions, cut_lineage(similar.filter("similarity >= 0.94")), nodes)
    listed = [((r["at"].i, r["at"].j), r.a, r.b) for r in edges.collect()]
    assert len({e[0] for e in listed}) == len(listed) > 0
    group, taken = merged_in_order(of_key, listed, gate=True)
    assert sorted(tuple(r["at"]) for r in merge.accepted.collect()) == taken
    grouped = [(r.node, r.group) for r in after.collect()]
    assert partition(grouped) == partition(group.items())

    index = {p["idx"]: p for p in plain}
    final, rows = M.merge_groups(questions, cut_lineage(after))
    coarse = partition((r.node, r.group) for r in final.collect())
    assert all(any(part <= whole for whole in coarse) for part in partition(grouped))
    assert all(sum(len(of_key[k]) for k in part) == len(set().union(*(of_key[k] for k in part))) for part in coarse)
    found = M.review_candidates(questions, labelled, similar, nodes, merge).collect()
    for r in found:
        a, b = index[r.idx_a], index[r.idx_b]
        assert r.idx_a < r.idx_b and a["role"] == b["role"] and a["question_type"] == b["question_type"]
    offered = M.reviewable_group_pairs(questions, labelled, cut_lineage(final)).collect()
    roots = {r.root for r in final.collect()}
    assert all(r.root_a in roots and r.root_b in roots and r.root_a != r.root_b for r in offered)
    assert taken and found and rows.count() and offered


def by_restarts(roots, texts, held, able):
    """Group merging as it is told: look at all groups by root, merge the first pair that
    may, begin again."""
    groups = {r: ([dict(texts[g])], set(held[g])) for g, r in roots.items()}
    done = []

    def face(r):
        total = {}
        for part in groups[r][0]:
            for text, (n, length, q, i, f) in part.items():
                old = total.get(text, (0, length, q, i, f))
                total[text] = (old[0] + n, length, *min(old[2:], (q, i, f)))
        return max(total.values(), key=lambda t: (t[0], t[1], -t[2], -t[3]))[4]
    while True:
        order = sorted(groups)
        shown = {r: face(r) for r in order}
        hit = next(((a, b) for k, a in enumerate(order) for b in order[k + 1:]
                    if not groups[a][1] & groups[b][1] and shown[b] in able.get(shown[a], ())), None)
        if hit is None:
            return done, {r: frozenset(f for part in parts for t in part.values() for f in t[4:]) for r, (parts, _) in groups.items()}
        a, b = hit
        done.append((a, b, *able[shown[a]][shown[b]]))
        parts, files = groups.pop(b)
        groups[a][0].extend(parts)
        groups[a][1].update(files)


def random_part(rng, n, files, chance):
    roots = {g: r for g, r in zip(range(100, 100 + n), rng.sample(range(10 * n), n))}
    texts = {g: {f"t{g}_{k}": (rng.randrange(1, 4), rng.randrange(5, 8), rng.randrange(50), 10 * g + k, 10 * g + k) for k in range(rng.randrange(1, 4))}
             for g in roots}
    held = {g: set(rng.sample(files, rng.randrange(1, 3))) for g in roots}
    every = [t[4] for g in texts for t in texts[g].values()]
    able = {}
    for x in every:
        for y in every:
            if x < y and x // 10 != y // 10 and rng.random() < chance:
                able.setdefault(x, {})[y] = able.setdefault(y, {})[x] = (round(rng.random(), 3), "r")
    return roots, texts, held, able


def test_merged_part_equals_restarts():
    import copy
    rng = random.Random(8)
    merged = 0
    for _ in range(150):
        part = random_part(rng, rng.randrange(2, 25), [f"s{k}" for k in range(rng.choice([4, 12, 40]))], rng.choice([0.05, 0.2, 0.6]))
        want, left = by_restarts(*copy.deepcopy(part))
        done, into = M.merged_part(*part)
        assert done == want and set(part[0].values()) == set(left)
        merged += len(done)
    assert merged > 300


def test_a_chain_of_a_thousand_groups_is_one_round(spark, monkeypatch):
    """Each group can merge with the next one only; all in one part, and the same when parts are too large for a task."""
    n, rounds = 1000, []
    chain = M.graph.connected_components
    monkeypatch.setattr(M.graph, "connected_components", lambda e: rounds.append(1) or chain(e))
    chars = [chr(0x4E00 + k) for k in range(3000)]
    texts = ["".join(chars[2 * i:2 * i + 60]) for i in range(n)]
    rows = [(i, f"f{i % 7}", "教师", "历史", i + 1, "填空题", t + "____") for i, t in enumerate(texts)]
    questions = cut_lineage(Q.with_text_features(spark.createDataFrame(
        rows, "idx bigint, source_file string, role string, subject string, q_no bigint, question_type string, question_text string"))
        .selectExpr("*", "cast(null AS string) AS signature", "cast(null AS bigint) AS signature_size"))
    groups = cut_lineage(M.start_groups(questions))
    final, merges = M.merge_groups(questions, groups)
    able = {}
    for r in M.mergeable_faces(M.faces(questions)).collect():
        able.setdefault(r.a, {})[r.b] = able.setdefault(r.b, {})[r.a] = (r.similarity, r.reason)
    assert len(rounds) == 1 and sum(map(len, able.values())) >= 2 * (n - 1)
    plain = ({i: i for i in range(n)}, {i: {r[6]: (1, len(r[6]), r[4], i, i)} for i, r in enumerate(rows)}, {i: {r[1]} for i, r in enumerate(rows)}, able)
    want, left = by_restarts(*plain)
    assert sorted(tuple(r) for r in merges.collect()) == sorted(want) and len(want) > 300
    assert partition((r.node, r.group) for r in final.collect()) == partition((r.node, r.root) for r in final.collect())
    assert {r.root for r in final.collect()} == set(left)


@pytest.mark.parametrize("seed", [3, 11])
def test_parts_too_large_for_a_task_merge_alike(spark, seed):
    questions, _, _ = load(spark, seed)
    groups = cut_lineage(M.start_groups(questions))
    final, merges = M.merge_groups(questions, groups)
    again, by_rounds = M.merge_groups(questions, groups, replay_rows=6)
    assert sorted(tuple(r) for r in merges.collect()) == sorted(tuple(r) for r in by_rounds.collect()) and merges.count() > 1
    assert {(r.node, r.root) for r in final.collect()} == {(r.node, r.root) for r in again.collect()}
    none, no_rows = M.merge_groups(questions.limit(0), groups.limit(0))
    assert none.count() == 0 and no_rows.count() == 0


def test_ties_of_option_order_do_not_depend_on_input(spark):
    parts = [(1, "option", label, 1) for label in "cab"] + [(1, "option", "d", 2), (2, "option", "d", 2)] + [(2, "option", x, 1) for x in "bca"]
    schema = "idx bigint, component_type string, component_label string, option_order bigint"
    seen = {r.signature for p in (parts, parts[::-1]) for r in Q.signatures(Q.with_labels(spark.createDataFrame(p, schema))).collect()}
    assert len(seen) == 1


def sequential(n, sources, edges, gate):
    root, held, mark, taken = list(range(n)), {i: {sources[i]} for i in range(n)}, {}, []
    for i, j in sorted(edges):
        a, b = root[i], root[j]
        if a == b or held[a] & held[b] or (gate and len(held[a]) > 1 and len(held[b]) > 1):
            continue
        for x in range(n):
            if root[x] in (a, b):
                mark.setdefault(x, (i, j))
                root[x] = a
        held[a] |= held[b]
        taken.append((i, j))
    return root, mark, taken


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_merge_in_order_equals_sequential_merge(spark, seed):
    rng = random.Random(seed)
    n, gate = rng.randint(12, 30), seed % 2 == 1
    sources = [rng.randrange(6) for _ in range(n)]
    hub = rng.randrange(n)
    edges = set()
    for _ in range(3 * n):
        a, b = (hub if rng.random() < 0.3 else rng.randrange(n)), rng.randrange(n)
        if sources[a] != sources[b]:
            edges.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(sorted(edges), "a bigint, b bigint").withColumn("at", graph.at(F.col("a"), F.col("b")))
    nodes = spark.createDataFrame([(i, i, i) for i in range(n)], "node bigint, `group` bigint, root bigint")
    held = spark.createDataFrame([(i, f"s{sources[i]}") for i in range(n)], "`group` bigint, source string")
    result = graph.merge_in_order(df, nodes, held, one_side_single=gate)
    root, mark, taken = sequential(n, sources, edges, gate)
    rows = result.groups.collect()
    assert {r.node: r.root for r in rows} == {x: root[x] for e in edges for x in e}
    assert {r.node: r.joined_at and tuple(r.joined_at) for r in rows} == {x: mark.get(x) for e in edges for x in e}
    assert sorted(tuple(r["at"]) for r in result.accepted.collect()) == sorted(taken)


def test_hub_of_single_file_partners_needs_one_round(spark):
    """A question that a third of all others resemble: arrivals are decided together."""
    n = 200
    df = spark.createDataFrame([(0, i) for i in range(1, n)], "a bigint, b bigint").withColumn("at", graph.at(F.col("a"), F.col("b")))
    nodes = spark.createDataFrame([(i, i, i) for i in range(n)], "node bigint, `group` bigint, root bigint")
    held = spark.createDataFrame([(i, f"s{i % 50}") for i in range(n)], "`group` bigint, source string")
    result = graph.merge_in_order(df, nodes, held, one_side_single=True)
    assert result.rounds == 1
    assert sorted(r["at"].j for r in result.accepted.collect()) == list(range(1, 50))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(0, x) for x in range(100, 160)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[x] == (0 if x <= 20 or x >= 100 else 21) for x in got)


def test_reviewer_merges_follow_row_order(spark):
    questions, _, plain = load(spark, 3)
    rng = random.Random(4)
    rows, parts = [], []
    for n in range(14):
        i, j = rng.sample(range(len(plain)), 2)
        rows.append((n, rng.choice(["人工归一1", "人工归一2"]), [(plain[i]["source_file"], plain[i]["q_no"]), (plain[j]["source_file"], plain[j]["q_no"])]))
    frame = spark.createDataFrame(rows, "row_no bigint, label string, question_keys array<struct<source_file: string, q_no: bigint>>")
    edges, status = M.reviewer_edges(frame, questions)
    assert status.filter("status = 'ready'").count() == 14
    labelled = cut_lineage(M.applied_labels(cut_lineage(edges)))
    groups, audit = M.merge_reviewed(questions, labelled)
    at = {(p["source_file"], p["q_no"]): i for i, p in enumerate(plain)}
    files = {}
    for p in plain:
        files.setdefault(p["normalized_key"], set()).add(p["source_file"])
    order = []
    for label in dict.fromkeys(r[1] for r in rows):
        mine = [(n, at[k[0]], at[k[1]]) for n, l, k in rows if l == label]
        part = {}
        for _, a, b in mine:
            x, y = part.setdefault(a, {a}), part.setdefault(b, {b})
            both = x | y
            for m in both:
                part[m] = both
        seen = []
        for _, a, _b in mine:
            if part[a] not in seen:
                seen.append(part[a])
        order += [e for s in seen for e in mine if e[1] in s]
    listed = [(k, plain[a]["normalized_key"], plain[b]["normalized_key"]) for k, (_, a, b) in enumerate(order)]
    group, taken = merged_in_order(files, listed, gate=False)
    expected = {n: "applied" if k in taken else "skipped_same_source_or_already_merged" for k, (n, _, _) in enumerate(order)}
    assert {r.row_no: r.status for r in audit.collect()} == expected
    moved = [(r.node, r.group) for r in groups.collect()]
    assert partition(moved) == partition((n, g) for n, g in group.items() if n in dict(moved))


def test_sides_that_grow_are_never_broadcast(spark, capsys):
    """Stored n-grams are coded far smaller than their rows: their files must not pass for
    a small join side that the driver builds as a whole."""
    texts = [(i, "教师|单选题", opening + "甲乙丙丁戊己庚辛"[i % 8]) for i, opening in enumerate(OPENINGS * 40)]
    units = spark.createDataFrame(texts, "unit bigint, block string, text string")
    grams = cut_lineage(similarity.gram_counts(units))
    pairs = cut_lineage(similarity.gram_candidates(units, similarity.gram_prefixes(grams, 0.9), 0.9, None))
    capsys.readouterr()
    similarity.gram_candidates(units, similarity.gram_prefixes(grams, 0.9), 0.9, None).explain()
    similarity.cosines(pairs, grams, similarity.norms_of(grams)).explain()
    counts = cut_lineage(units.select(F.col("unit").alias("idx"), F.lit("option").alias("component_type"), F.col("text").alias("label_key"),
                                      F.lit(1).cast("bigint").alias("n")))
    Q.multiset_deltas(pairs.select(F.col("unit_a").alias("idx_a"), F.col("unit_b").alias("idx_b")), counts).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_labels_are_ranked_in_one_pass_and_compared_by_digest(spark, capsys):
    rows = [(1, "option", "是", 1), (1, "option", "否", 2), (1, "option", "否", 3), (1, "option", "", 4),
            (2, "option", "否", 1), (2, "option", "是", 1), (2, "option", "也许", 2), (3, "option", "是", 1), (3, "option", "否", 2), (3, "option", "否", 3)]
    labelled = Q.with_labels(spark.createDataFrame(rows, "idx bigint, component_type string, component_label string, option_order bigint"))
    hashed = Q.hashed_labels(labelled)
    assert {len(r.label_key) for r in hashed.collect()} == {32}
    capsys.readouterr()
    Q.signatures(labelled).explain()
    assert "Join" not in capsys.readouterr().out
    for form in (labelled, hashed):
        signs = {r.idx: (r.signature, r.signature_size) for r in Q.signatures(form).collect()}
        assert signs[1] == signs[3] != signs[2] and signs[1][1] == 3
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "idx_a bigint, idx_b bigint")
    found = [Q.delta_texts(Q.multiset_deltas(pairs, Q.label_counts(form)), form).collect() for form in (labelled, hashed)]
    assert found[0] == found[1] and [tuple(r) for r in found[0]] == [(1, 2, "选项: 否", "选项: 也许")]


def test_merging_broadcasts_no_side_that_grows(spark, capsys, monkeypatch):
    """Every round of merging joins groups, files and edges with each other: a broadcast of each
    of them, in each round, is a table built whole in the driver."""
    questions, _, _ = load(spark, 3)
    plans = []

    def kept(df):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return cut_lineage(df)
    for module in (graph, M):
        monkeypatch.setattr(module, "cut_lineage", kept)
    nodes = M.start_groups(questions)
    near = kept(M.similar_keys(questions, 0.88))
    groups, merge, _ = M.merge_similar(questions, near, nodes)
    M.merge_groups(questions, kept(groups))
    kept(M.start_marks(questions, nodes, merge))
    assert merge.rounds > 0 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]
