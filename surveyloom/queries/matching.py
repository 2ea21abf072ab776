"""Question matching queries over documents as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import text
from surveyloom.operators import matching as M
from surveyloom.operators import questions as Q
from surveyloom.operators.similarity import similar_pairs
from surveyloom.queries import query
from surveyloom.queries import bindings as B
from surveyloom.queries.question_forms import (
    LABELS_SQL, QUESTIONS_SQL, compact_sql, document_components, document_questions, drop_sql, full_questions, key_sql, pairs_sql, text_pairs,
)
from surveyloom.session import cut_lineage, shuffled
from surveyloom import fixed_values as V

COMPARISON_SQL = drop_sql("regexp_replace(normalized_text, '第\\d+题', '第N题', 'g')", V.SUBJECT_TERMS)
def brute_sql(questions):
    """All pairs of keys of one block, compared gram by gram."""
    return f"""{questions}, ks AS (
  SELECT normalized_key, min(idx) AS first_idx, count(*) AS n, min(source_file) AS lo, max(source_file) AS hi, any_value(role || '|' || question_type) AS block,
    any_value({COMPARISON_SQL}) AS t FROM keyed GROUP BY normalized_key),
p AS (SELECT first_idx, block, t, unnest([2, 3, 4]) AS gn FROM ks),
gr AS (SELECT first_idx, block, gram, length(any_value(t)) AS len, count(*) AS tf FROM (SELECT first_idx, block, t, substr(t, i, gn) AS gram FROM (SELECT *, unnest(range(1, length(t) - gn + 2)) AS i FROM p)) GROUP BY first_idx, block, gram),
nm AS (SELECT first_idx, sqrt(sum(tf * tf)) AS norm FROM gr GROUP BY first_idx),
dots AS (SELECT x.first_idx AS ia, y.first_idx AS ib, sum(x.tf * y.tf) AS dot FROM gr x JOIN gr y ON x.block = y.block AND x.gram = y.gram AND x.first_idx < y.first_idx
  WHERE least(x.len, y.len) / greatest(x.len, y.len) >= 0.82 GROUP BY ALL),
sims AS (SELECT ia, ib, dot / (nx.norm * ny.norm) AS similarity FROM dots JOIN nm nx ON nx.first_idx = ia JOIN nm ny ON ny.first_idx = ib)"""


BRUTE_SQL = brute_sql(QUESTIONS_SQL)


@query("char_ngram_cosine", f"""WITH {BRUTE_SQL} SELECT ia AS unit_a, ib AS unit_b, round(similarity, 6) AS similarity FROM sims WHERE similarity >= 0.88""")
def char_ngram_cosine(spark, sf):
    """Pairs of distinct question texts of one role and type with cosine ≥ 0.88."""
    units = M.text_units(M.distinct_keys(Q.with_text_features(document_questions(spark, sf))))
    return similar_pairs(units, V.REVIEW_FLOOR).select("unit_a", "unit_b", F.round("similarity", 6).alias("similarity"))


@query("near_matches", f"""WITH {BRUTE_SQL}, near AS (
  SELECT x.normalized_key AS ka, y.normalized_key AS kb, ia, ib, similarity FROM sims JOIN ks x ON x.first_idx = ia JOIN ks y ON y.first_idx = ib
  WHERE similarity >= 0.94 AND NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo))
SELECT ia AS first_idx_a, ib AS first_idx_b, round(similarity, 4) AS similarity, count(*) AS question_pairs
FROM near JOIN keyed u ON u.normalized_key = ka JOIN keyed v ON v.normalized_key = kb WHERE u.source_file <> v.source_file GROUP BY ALL""")
def near_matches(spark, sf):
    """Keys of about equal text, with the number of question pairs in different files."""
    pairs = M.similar_keys(cut_lineage(Q.with_text_features(document_questions(spark, sf))))
    return pairs.select("first_idx_a", "first_idx_b", F.round("similarity", 4).alias("similarity"), "question_pairs")


# --- parts as questions ---------------------------------------------------------------------------------

def part_questions(spark, sf):
    """Every part asked about in the form of its first supplier's nation: name, brand and
    size make the wording, small parts leave blanks to fill."""
    first = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    nations = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    files = first.join(B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(nations, "s_nationkey")
    blanks = F.when(F.col("p_size") <= 7, " ____ ___").when(F.col("p_size") <= 15, " ____").otherwise("")
    return B.table(spark, sf, "part").join(shuffled(files), "p_partkey").select(
        F.col("p_partkey").alias("idx"), F.col("n_name").alias("source_file"), F.col("p_type").alias("role"), F.col("p_brand").alias("subject"),
        F.col("p_partkey").alias("q_no"), F.when(F.col("p_size") <= 15, "填空题").otherwise("单选题").alias("question_type"),
        F.concat("p_name", F.lit(" used in school "), "p_brand", F.lit(" "), F.col("p_size").cast("string"), blanks).alias("question_text"))


def part_components(spark, sf):
    """The line numbers a part was ordered under are its options."""
    lines = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("idx"), "l_linenumber").distinct()
    return Q.with_labels(lines.select(
        "idx", F.lit("option").alias("component_type"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("component_label"),
        F.col("l_linenumber").cast("bigint").alias("option_order")))


PART_QUESTIONS_SQL = f"""form AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey),
asked AS (SELECT p_partkey AS idx, n_name AS source_file, p_type AS role, p_brand AS subject, p_partkey AS q_no,
  CASE WHEN p_size <= 15 THEN '填空题' ELSE '单选题' END AS question_type, CASE WHEN p_size <= 7 THEN 2 WHEN p_size <= 15 THEN 1 ELSE 0 END AS blanks,
  p_name || ' used in school ' || p_brand || ' ' || p_size || CASE WHEN p_size <= 7 THEN ' ____ ___' WHEN p_size <= 15 THEN ' ____' ELSE '' END AS question_text
  FROM part JOIN form ON l_partkey = p_partkey JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey),
q AS (SELECT *, {key_sql(compact_sql("question_text"))} AS normalized_text FROM asked),
keyed AS (SELECT *, role || '|' || question_type || '|' || normalized_text AS normalized_key FROM q),
counts AS (SELECT DISTINCT l_partkey AS idx, 'line' || l_linenumber AS label_key, 1 AS n FROM lineitem),
signs AS (SELECT idx, string_agg(label_key, ',' ORDER BY label_key) AS signature, count(*) AS size FROM counts GROUP BY idx)"""


def replay_sql(fits):
    """Merging in order, one step an edge (k, na, nb): g, s and m list every node's group, its
    files, and the edge at which it first held two of them."""
    return f"""replay(k, g, s, m, ok) AS (
  SELECT 0::BIGINT, list(root ORDER BY n), list(srcs ORDER BY n), list(CASE WHEN len(srcs) > 1 THEN 0::BIGINT END ORDER BY n), false FROM nodes
  UNION ALL SELECT k, CASE WHEN fit THEN list_transform(g, lambda x: CASE WHEN x = hb THEN ha ELSE x END) ELSE g END,
    CASE WHEN fit THEN list_transform(s, lambda x, p: CASE WHEN g[p] IN (ha, hb) THEN list_concat(sa, sb) ELSE x END) ELSE s END,
    CASE WHEN fit THEN list_transform(m, lambda x, p: CASE WHEN g[p] IN (ha, hb) THEN coalesce(x, k) ELSE x END) ELSE m END, fit
  FROM (SELECT *, {fits} AS fit
    FROM (SELECT e.k, g, s, m, g[na] AS ha, g[nb] AS hb, s[na] AS sa, s[nb] AS sb FROM replay r JOIN e ON e.k = r.k + 1)))"""


AUTO_SQL = f"""{brute_sql(PART_QUESTIONS_SQL)},
near AS (SELECT x.normalized_key AS ka, y.normalized_key AS kb, similarity FROM sims JOIN ks x ON x.first_idx = ia JOIN ks y ON y.first_idx = ib
  WHERE similarity >= 0.88 AND NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)),
cl AS (SELECT normalized_key AS k, coalesce(signature, '') AS sig, coalesce(size, 0) AS size, blanks, min(idx) AS c, any_value(question_type) AS question_type
  FROM keyed LEFT JOIN signs USING (idx) GROUP BY ALL),
cp AS (SELECT similarity, x.question_type, x.k AS ka, y.k AS kb, x.c AS ca, y.c AS cb, x.sig AS ga, y.sig AS gb, x.size AS size, x.blanks AS ba, y.blanks AS bb
  FROM near JOIN cl x ON x.k = ka JOIN cl y ON y.k = kb),
ea AS (SELECT *, least(ca, cb) AS i, greatest(ca, cb) AS j, CASE WHEN ca < cb THEN ka ELSE kb END AS a, CASE WHEN ca < cb THEN kb ELSE ka END AS b
  FROM cp WHERE similarity >= 0.94 AND CASE WHEN question_type = '填空题' THEN ba = bb ELSE ga = gb AND size > 0 END),
nodes AS (SELECT normalized_key AS k, min(idx) AS root, list(DISTINCT source_file) AS srcs, row_number() OVER (ORDER BY min(idx)) AS n
  FROM keyed WHERE normalized_key IN (SELECT a FROM ea UNION ALL SELECT b FROM ea) GROUP BY normalized_key),
e AS (SELECT ea.*, x.n AS na, y.n AS nb, row_number() OVER (ORDER BY i, j) AS k FROM ea JOIN nodes x ON x.k = a JOIN nodes y ON y.k = b),
{replay_sql("ha <> hb AND NOT list_has_any(sa, sb) AND least(len(sa), len(sb)) = 1")},
ended AS (SELECT g, s, m FROM replay ORDER BY k DESC LIMIT 1),
after AS (SELECT normalized_key, coalesce(any_value(g[n]), min(idx)) AS root, coalesce(any_value(s[n]), list(DISTINCT source_file)) AS srcs, any_value(m[n]) AS mark,
  count(DISTINCT source_file) AS files, min(idx) AS first_idx FROM keyed LEFT JOIN nodes ON nodes.k = normalized_key LEFT JOIN ended ON true GROUP BY normalized_key)"""


def _prepared(spark, sf):
    questions = cut_lineage(Q.with_text_features(part_questions(spark, sf)).join(shuffled(Q.signatures(part_components(spark, sf))), "idx", "left"))
    return questions, cut_lineage(M.similar_keys(questions, max(V.REVIEW_FLOOR, V.MATCH_THRESHOLD - V.REVIEW_MARGIN)))


def _merged(spark, sf):
    questions, near = _prepared(spark, sf)
    nodes = cut_lineage(M.start_groups(questions))
    groups, merge, edges = M.merge_similar(questions, near.filter(F.col("similarity") >= V.MATCH_THRESHOLD), nodes)
    return questions, near, nodes, cut_lineage(groups), merge, edges


@query("auto_merge_groups", f"""WITH RECURSIVE {AUTO_SQL} SELECT normalized_key, root FROM after""")
def auto_merge_groups(spark, sf):
    """Groups after exact and automatic merges: every key with the root of its group."""
    _, _, _, groups, _, _ = _merged(spark, sf)
    return groups.select(F.col("node").alias("normalized_key"), "root")


@query("auto_merge_pairs", f"""WITH RECURSIVE {AUTO_SQL} SELECT i AS idx_a, j AS idx_b, round(similarity, 6) AS similarity,
  CASE WHEN question_type = '填空题' THEN 'auto_fill_text_similar_same_blank_count' ELSE 'auto_question_similar_options_identical' END AS reason
FROM e JOIN replay r USING (k) WHERE ok""")
def auto_merge_pairs(spark, sf):
    """Question pairs that merged, with the reason."""
    _, _, _, _, merge, edges = _merged(spark, sf)
    return edges.join(shuffled(merge.accepted.select("at")), "at").select(
        F.col("at.i").alias("idx_a"), F.col("at.j").alias("idx_b"), F.round("similarity", 6).alias("similarity"), "reason")


REVIEW_SQL = f"""cs AS (SELECT idx, normalized_key AS k, coalesce(signature, '') AS sig, blanks, source_file FROM keyed LEFT JOIN signs USING (idx)),
fc AS (SELECT any_value(cp) AS c, min((least(x.idx, y.idx), greatest(x.idx, y.idx))) AS pr FROM cp JOIN cs x ON x.k = ka AND x.sig = ga AND x.blanks = ba
  JOIN cs y ON y.k = kb AND y.sig = gb AND y.blanks = bb WHERE x.source_file <> y.source_file GROUP BY ca, cb),
side AS (SELECT c.ca, c.cb, label_key, n AS na, 0 AS nb FROM fc JOIN counts ON idx = c.ca UNION ALL SELECT c.ca, c.cb, label_key, 0, n FROM fc JOIN counts ON idx = c.cb),
d AS (SELECT ca, cb, label_key, sum(na) AS na, sum(nb) AS nb FROM side GROUP BY ALL),
dd AS (SELECT ca, cb, sum(greatest(na - nb, 0)) AS missing, sum(greatest(nb - na, 0)) AS extra, sum(least(na, nb)) AS common FROM d GROUP BY ALL),
rel AS (SELECT fc.*, CASE WHEN c.ga = c.gb THEN 'identical' WHEN missing + extra = 0 THEN 'same_items_order_diff'
  WHEN common > 0 AND missing + extra <= 2 THEN CASE WHEN missing > 0 AND extra > 0 THEN 'changed_1_2' ELSE 'add_or_missing_1_2' END
  WHEN common > 0 THEN 'partial_overlap' ELSE 'completely_different' END AS option_relation
  FROM fc LEFT JOIN dd ON dd.ca = c.ca AND dd.cb = c.cb),
marks AS (SELECT normalized_key, mark, files, coalesce(i, -1) AS mi, coalesce(j, -1) AS mj FROM after LEFT JOIN e ON e.k = mark),
offered AS (SELECT pr[1] AS idx_a, pr[2] AS idx_b, round(c.similarity, 4) AS similarity, CASE WHEN c.question_type = '填空题' THEN 'manual_fill_text_similar_blank_count_close'
    ELSE 'manual_question_similar_options_' || option_relation END AS reason, option_relation, c.question_type AS question_type
FROM rel JOIN marks x ON x.normalized_key = c.ka JOIN marks y ON y.normalized_key = c.kb
WHERE CASE WHEN c.question_type = '填空题' THEN c.ba > 0 AND c.bb > 0 AND abs(c.ba - c.bb) <= 1
    ELSE option_relation IN ('same_items_order_diff', 'add_or_missing_1_2', 'changed_1_2') END
  AND ((x.mark IS NULL AND x.files = 1) OR (x.mark IS NOT NULL AND (x.mi, x.mj) >= pr) OR (y.mark IS NULL AND y.files = 1) OR (y.mark IS NOT NULL AND (y.mi, y.mj) >= pr))
  AND pr NOT IN (SELECT (i, j) FROM e JOIN replay r USING (k) WHERE ok))"""


@query("review_candidates", f"WITH RECURSIVE {AUTO_SQL}, {REVIEW_SQL} SELECT * FROM offered")
def review_candidates(spark, sf):
    """Similar questions with slightly different options, for a reviewer."""
    questions, near, nodes, _, merge, _ = _merged(spark, sf)
    found = M.review_candidates(questions, part_components(spark, sf), near, nodes, merge)
    return found.orderBy(F.desc("similarity"), "idx_a", "idx_b")


@query("identical_option_groups", f"""WITH {QUESTIONS_SQL}, {LABELS_SQL}, s AS (SELECT keyed.*, signature FROM keyed JOIN signs USING (idx)),
g AS (SELECT role, question_type, signature, count(DISTINCT normalized_key) AS keys, count(DISTINCT source_file) AS files FROM s GROUP BY ALL HAVING count(DISTINCT normalized_key) > 1 AND count(DISTINCT source_file) > 1)
SELECT role, question_type, normalized_key, min(idx) AS class_idx, count(*) AS n, keys, files FROM s JOIN g USING (role, question_type, signature) GROUP BY role, question_type, signature, normalized_key, keys, files""")
def identical_option_groups(spark, sf):
    return M.identical_option_groups(full_questions(spark, sf)).drop("signature")


@query("embedding_review", """WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
v AS (SELECT a, b, flag, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM p LEFT JOIN embeddings x ON x.vec_id = a LEFT JOIN embeddings y ON y.vec_id = b)
SELECT a, b, CASE WHEN flag <> 'N' THEN 'llm' WHEN c IS NOT NULL THEN 'embedding' ELSE 'none' END AS semantic_provider,
  CASE WHEN flag = 'N' THEN round(c, 4) END AS semantic_similarity, CASE WHEN flag = 'A' THEN true WHEN flag = 'R' THEN false WHEN c IS NOT NULL THEN c >= 0.7 ELSE true END AS should_review,
  CASE WHEN flag <> 'N' THEN 'manual_identical_options_llm' WHEN c IS NOT NULL THEN 'manual_identical_options_embedding_ge_0.70' ELSE 'manual_identical_options_no_semantic_model' END AS reason FROM v""")
def embedding_review(spark, sf):
    """Candidate pairs (part, supplier) of the order lines; the return flag stands in
    for the verdict table, N meaning none."""
    li = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.min("l_returnflag").alias("flag"))
    verdicts = li.filter("flag <> 'N'").select("a", "b", (F.col("flag") == "A").alias("should_merge"))
    vectors = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.meaning_test(li.select("a", "b"), vectors, verdicts)


# --- reviewers -----------------------------------------------------------------------------------------

def reviewer_rows(spark, sf):
    """Every labelled document is a reviewer row naming itself and the next document of
    its language; quality and toxic stand in for the reviewer's entries."""
    l, d = B.table(spark, sf, "labels"), B.table(spark, sf, "documents").select("doc_id", "source")
    partner = text_pairs(spark, sf, ("lang",)).select(F.col("a").alias("doc_id"), F.col("b").alias("p_id"), F.col("source_b").alias("p_source"))
    rows = l.join(d, "doc_id").join(partner, "doc_id", "left")
    entry = F.when(F.col("quality") == 0, F.lit(" No ")).when(F.col("toxic") == 0, F.lit("２")).otherwise(F.lit(""))
    note = F.when(F.col("toxic") == 1, F.concat(F.lit("请归一 "), F.col("quality").cast("string"), F.lit("，谢谢"))).otherwise("")
    keys = F.array(F.struct(F.col("source").alias("source_file"), F.col("doc_id").alias("q_no")),
                   F.struct(F.coalesce("p_source", F.lit("missing")).alias("source_file"), F.coalesce("p_id", F.lit(-1)).alias("q_no")))
    label = M.reviewer_label(F.lit(None).cast("string"), entry, note, has_merge_id=False)
    return rows.select(F.col("doc_id").alias("row_no"), label.alias("label"), keys.alias("question_keys"))


@query("reviewer_labels", """WITH n AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS p_id FROM documents),
r AS (SELECT l.doc_id AS row_no, CASE WHEN quality = 1 AND toxic = 0 THEN '人工归一2' WHEN toxic = 1 THEN '归一' || quality END AS label,
  CASE WHEN p_id IS NULL THEN 1 ELSE 2 END AS found FROM labels l JOIN n USING (doc_id))
SELECT row_no, label, found::BIGINT AS found, CASE WHEN found = 2 THEN 'ready' ELSE 'question_not_found' END AS status FROM r WHERE label IS NOT NULL""")
def reviewer_labels(spark, sf):
    return M.reviewer_edges(reviewer_rows(spark, sf), document_questions(spark, sf))[1]


REVIEWED_SQL = f"""{QUESTIONS_SQL},
nx AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM documents),
ed AS (SELECT l.doc_id AS row_no, CASE WHEN quality = 1 AND toxic = 0 THEN '人工归一2' WHEN toxic = 1 THEN '归一' || quality END AS label, l.doc_id AS a, b
  FROM labels l JOIN nx USING (doc_id) WHERE b IS NOT NULL AND (toxic = 1 OR quality = 1)),
lk AS (SELECT label, a, b FROM ed UNION SELECT label, b, a FROM ed),
reach(label, n, m) AS (SELECT label, a, a FROM lk UNION SELECT r.label, n, lk.b FROM reach r JOIN lk ON lk.label = r.label AND lk.a = m),
part AS (SELECT label, n, min(m) AS comp FROM reach GROUP BY ALL),
pe AS (SELECT ed.*, min(row_no) OVER (PARTITION BY ed.label) AS lf, min(row_no) OVER (PARTITION BY ed.label, comp) AS pf FROM ed JOIN part ON part.label = ed.label AND n = a),
pn AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY pf) AS place FROM pe),
nodes AS (SELECT normalized_key AS k, min(idx) AS root, list(DISTINCT source_file) AS srcs, row_number() OVER (ORDER BY min(idx)) AS n
  FROM keyed WHERE normalized_key IN (SELECT normalized_key FROM keyed WHERE idx IN (SELECT a FROM ed UNION ALL SELECT b FROM ed)) GROUP BY normalized_key),
e AS (SELECT pn.*, CASE WHEN max(place) OVER (PARTITION BY label) = 1 THEN label ELSE label || '-' || place END AS applied_label, x.n AS na, y.n AS nb,
  row_number() OVER (ORDER BY lf, pf, row_no) AS k
  FROM pn JOIN keyed ka ON ka.idx = a JOIN keyed kb ON kb.idx = pn.b JOIN nodes x ON x.k = ka.normalized_key JOIN nodes y ON y.k = kb.normalized_key),
{replay_sql("ha <> hb AND NOT list_has_any(sa, sb)")}"""


@query("reviewer_merges", f"""WITH RECURSIVE {REVIEWED_SQL} SELECT applied_label, row_no, a AS idx_a, b AS idx_b,
  CASE WHEN ok THEN 'applied' ELSE 'skipped_same_source_or_already_merged' END AS status FROM e JOIN replay r USING (k)""")
def reviewer_merges(spark, sf):
    """Audit of every reviewer edge: applied, or skipped for a shared file."""
    questions = cut_lineage(full_questions(spark, sf))
    edges, _ = M.reviewer_edges(reviewer_rows(spark, sf), questions)
    _, audit = M.merge_reviewed(questions, cut_lineage(M.applied_labels(cut_lineage(edges))))
    return audit


#: Forms of these sources are read as forms of the school itself; their risk shows in every cluster they are in.
SCHOOL_SOURCES = ["src3", "src11"]
RISK_SQL = "concat_ws('；', " + ", ".join("CASE WHEN bool_or({}) THEN '{}' END".format(
    " OR ".join(f"contains(seen, '{w}')" for w in words), flag) for words, flag in V.RISK_FLAGS) + ")"


@query("review_clusters", f"""WITH RECURSIVE {pairs_sql("lang")}, near AS (SELECT *, length(text_a) <= length(text_b) AS rising,
  round(least(length(text_a), length(text_b)) / greatest(length(text_a), length(text_b)), 4) AS similarity FROM pairs),
pr0 AS (SELECT * FROM near WHERE similarity >= 0.5),
e AS (SELECT a, b FROM pr0 UNION SELECT b, a FROM pr0),
reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m),
comp AS (SELECT n, min(m) AS component FROM reach GROUP BY n),
pr AS (SELECT component, similarity, CASE WHEN rising THEN 'manual_group_x' ELSE 'manual_fill_x' END AS reason,
  CASE WHEN source_a < source_b THEN 'identical' ELSE 'changed_1_2' END AS rel FROM pr0 JOIN comp ON n = a),
ps AS (SELECT component, count(*) AS pair_count, max(similarity) AS max_similarity, string_agg(DISTINCT reason, ' | ' ORDER BY reason) AS reason_summary, string_agg(DISTINCT rel, ' | ' ORDER BY rel) AS option_relation_summary FROM pr GROUP BY component),
forms AS (SELECT doc_id, CASE WHEN source IN ({", ".join(f"'{s}'" for s in SCHOOL_SOURCES)}) THEN '学校' ELSE source END AS subject, replace(replace(text, '. De', '. 截至'), '. Der', '. 各年级') AS t FROM documents),
ms AS (SELECT component, count(*) AS question_count, min((subject, n)) AS f, {RISK_SQL} AS risk_flags
  FROM (SELECT component, n, subject, subject || '#' || n || ': ' || t AS seen FROM comp JOIN forms ON doc_id = n) GROUP BY component)
SELECT ps.component, pair_count, question_count, max_similarity, reason_summary, option_relation_summary,
  concat_ws('；', CASE WHEN contains(option_relation_summary, 'identical') THEN '选项/组件完全一致' END, CASE WHEN contains(option_relation_summary, 'changed_1_2') THEN '选项有1-2处文字差异' END,
    CASE WHEN contains(reason_summary, 'fill') THEN '填空题题干相似且空数接近' END, CASE WHEN contains(reason_summary, 'group') THEN '已归一题组之间仍相似' END) AS review_logic,
  risk_flags, CASE WHEN risk_flags <> '' THEN '人工判断后再归一' ELSE '确认是否归一' END AS suggested_action, f[1] AS first_subject, f[2] AS first_q_no
FROM ps JOIN ms USING (component)""")
def review_clusters(spark, sf):
    """Neighbours of a language whose whole texts are of like length, as review pairs."""
    ratio = F.least(F.char_length("text_a"), F.char_length("text_b")) / F.greatest(F.char_length("text_a"), F.char_length("text_b"))
    pairs = text_pairs(spark, sf, ("lang",)).select(
        F.col("a").alias("idx_a"), F.col("b").alias("idx_b"), F.round(ratio, 4).alias("similarity"),
        F.when(F.char_length("text_a") <= F.char_length("text_b"), "manual_group_x").otherwise("manual_fill_x").alias("reason"),
        F.when(F.col("source_a") < F.col("source_b"), "identical").otherwise("changed_1_2").alias("option_relation"))
    subject = F.when(F.col("source").isin(SCHOOL_SOURCES), "学校").otherwise(F.col("source"))
    marked = text.replace_all(F.col("text"), [(". De", ". 截至"), (". Der", ". 各年级")])
    questions = B.table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), subject.alias("subject"), F.col("doc_id").alias("q_no"), marked.alias("question_text"))
    return M.review_clusters(cut_lineage(pairs.filter("similarity >= 0.5")), questions)


#: Group merging as told: each step the first pair whose representatives may merge.
MERGING_SQL = f"""full_dots AS (SELECT x.first_idx AS ia, y.first_idx AS ib, sum(x.tf * y.tf) AS dot FROM gr x JOIN gr y ON x.block = y.block AND x.gram = y.gram AND x.first_idx < y.first_idx GROUP BY ALL),
fs AS (SELECT ia, ib, dot / (nx.norm * ny.norm) AS similarity FROM full_dots JOIN nm nx ON nx.first_idx = ia JOIN nm ny ON ny.first_idx = ib),
able AS (SELECT ia, ib, similarity FROM fs JOIN keyed a ON a.idx = ia JOIN keyed b ON b.idx = ib LEFT JOIN signs x ON x.idx = ia LEFT JOIN signs y ON y.idx = ib
  WHERE similarity >= 0.9 AND CASE WHEN a.question_type = '填空题' THEN a.blanks = b.blanks ELSE x.signature = y.signature END),
roots AS (SELECT DISTINCT root FROM after WHERE first_idx IN (SELECT ia FROM able UNION ALL SELECT ib FROM able)),
tn AS (SELECT after.*, ks.n AS copies, length(question_text) AS len, row_number() OVER (ORDER BY after.first_idx) AS n FROM after SEMI JOIN roots USING (root)
  JOIN ks ON ks.first_idx = after.first_idx JOIN keyed ON idx = after.first_idx),
ranked AS (SELECT *, row_number() OVER (ORDER BY copies DESC, len DESC, first_idx) AS rk FROM tn),
held AS (SELECT root, list_distinct(flatten(list(srcs))) AS s, min(rk) AS best FROM ranked GROUP BY root),
able_n AS (SELECT list({{'a': x.n, 'b': y.n, 's': similarity}}) AS es FROM able JOIN tn x ON x.first_idx = ia JOIN tn y ON y.first_idx = ib),
merging(step, g, r, s, lo, hi, sim) AS (
  SELECT 0, list(root ORDER BY n), list(best = rk ORDER BY n), list(h.s ORDER BY n), NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM ranked JOIN held h USING (root)
  UNION ALL SELECT step + 1, list_transform(g, lambda x: CASE WHEN x = pick.hi THEN pick.lo ELSE x END),
    list_transform(r, lambda x, p: x AND (p NOT IN (pick.a, pick.b) OR p = CASE WHEN rks[pick.a] < rks[pick.b] THEN pick.a ELSE pick.b END)),
    list_transform(s, lambda x, p: CASE WHEN g[p] IN (pick.lo, pick.hi) THEN list_concat(s[pick.a], s[pick.b]) ELSE x END), pick.lo, pick.hi, pick.s
  FROM (SELECT step, g, r, s, rks, list_min(list_transform(list_filter(es, lambda x: r[x.a] AND r[x.b] AND g[x.a] <> g[x.b] AND NOT list_has_any(s[x.a], s[x.b])),
      lambda x: {{'lo': least(g[x.a], g[x.b]), 'hi': greatest(g[x.a], g[x.b]), 'a': x.a, 'b': x.b, 's': x.s}})) AS pick
    FROM merging, able_n, (SELECT list(rk ORDER BY n) AS rks FROM ranked)) WHERE pick IS NOT NULL)"""


@query("group_level_merges", f"""WITH RECURSIVE {AUTO_SQL}, {MERGING_SQL}
SELECT lo AS root_a, hi AS root_b, round(sim, 6) AS similarity, 'auto_group_text_similar_components_identical' AS reason FROM merging WHERE step > 0""")
def group_level_merges(spark, sf):
    """Group pairs merged by their representatives, after all question merges."""
    questions, _, _, groups, _, _ = _merged(spark, sf)
    return M.merge_groups(questions, groups)[1].select("root_a", "root_b", F.round("similarity", 6).alias("similarity"), "reason")


@query("group_level_review")
def group_level_review(spark, sf):
    """Pairs of final groups left to a reviewer, over documents as questions."""
    # the keys of labels are made once; no text of a label is read here
    labelled = cut_lineage(Q.hashed_labels(document_components(spark, sf)).select(
        "idx", "component_type", "option_order", "label_key", F.col("label_key").alias("display")))
    questions = cut_lineage(full_questions(spark, sf, labelled))
    near = M.similar_keys(questions, V.MATCH_THRESHOLD)
    groups, _, _ = M.merge_similar(questions, cut_lineage(near), cut_lineage(M.start_groups(questions)))
    final, _ = M.merge_groups(questions, cut_lineage(groups))
    return M.reviewable_group_pairs(questions, labelled, cut_lineage(final))
