"""Chart, text, report and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom import fixed_values as V
from surveyloom.operators import answers as A
from surveyloom.operators import charts as C
from surveyloom.operators import indicators, rules as rule_ops
from surveyloom.queries import query
from surveyloom.queries import answer_ingest, bindings as B
from surveyloom.session import cut_lineage
from surveyloom.queries.metrics import METRICS_SQL, METRICS_SELECT_SQL, full_metrics, report_rules


def typed_rules(spark):
    return rule_ops.parse_report_rules(report_rules(spark))[0]


def rows_of(spark, sf):
    return C.chart_rows(full_metrics(spark, sf), typed_rules(spark))


RULES_SQL = """rules AS (SELECT * FROM (VALUES
  ('rr_001', 1, 'c1', '基础', '优先级', 'distribution_bar', ['QG_PRIORITY', 'IND_PRIORITY'], 2, 'topn'),
  ('rr_002', 2, 'c1', '基础', '数量', 'table', ['QG_QTY'], 1, 'item_mean_extremes'),
  ('rr_003', 3, 'c2', '行为', '事件', 'heatmap', ['QG_EVENT', 'QG_GRID'], 3, 'sample_size'),
  ('rr_004', 4, 'c2', '行为', '全部', '', ['*'], 1, 'topn'),
  ('rr_006', 6, 'c3', '上传', '个人', 'scatter_or_stat', ['IND_PRIORITY_USER'], 1, 'topn'))
  v(rule_id, ord, chapter_id, chapter_title, title, chart_type, ids, top_n, template))"""
ROWS_SQL = METRICS_SQL + f""", m AS ({METRICS_SELECT_SQL.replace("FROM parts", ", school FROM parts")}), {RULES_SQL},
rows_ AS (
  SELECT rule_id, chart_type, title, template, top_n, category, series, stack,
    list_position(['response_count', 'option_summary', 'numeric_summary', 'upload_summary', 'matrix_summary', 'indicator_value'], metric_type)::INTEGER AS branch,
    role, subject, norm_id, indicator_id, school, coalesce(percent, mean, count) AS value, count, denominator, percent, mean, sd, n
  FROM m JOIN rules ON list_contains(ids, '*') OR (norm_id <> '' AND list_contains(ids, norm_id)) OR (indicator_id <> '' AND list_contains(ids, indicator_id))
  WHERE metric_type <> 'response_count')"""
ORDER_SQL = "category, series, stack, branch, role, subject, norm_id, indicator_id, school"


@query("chart_rows", ROWS_SQL + f"""
SELECT rule_id, chart_type, title, top_n, {ORDER_SQL}, value, count, denominator, percent, mean, sd, n FROM rows_""")
def chart_rows(spark, sf):
    return rows_of(spark, sf).drop("text_template_id")


TOPN_SQL = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY region, rule_id ORDER BY coalesce(percent, value, 0) DESC, {ORDER_SQL}) AS rk FROM placed),
top_texts AS (SELECT region, rule_id, '在' || title || '方面，选择最多的' || count(*) || '项为：'
  || string_agg(category || '（' || printf('%.1f', coalesce(percent, value, 0) * 100) || '%）', '、' ORDER BY rk) || '。' AS text
  FROM ranked WHERE template = 'topn' AND rk <= top_n GROUP BY region, rule_id, title)"""
PLACED_SQL = ROWS_SQL + """, placed AS (SELECT rows_.*, r_name AS region FROM rows_ JOIN nation ON school = n_name JOIN region ON n_regionkey = r_regionkey)"""
NUMBER_TEXT_SQL = "regexp_replace(CAST(CAST({} AS DECIMAL(38, 6)) AS VARCHAR), '\\.?0+$', '')"
EXTREMES_SQL = f"""high AS (SELECT *, row_number() OVER (PARTITION BY region, rule_id ORDER BY coalesce(mean, value, 0) DESC, {ORDER_SQL}) AS rk,
    count(*) OVER (PARTITION BY region, rule_id) AS total FROM placed WHERE template = 'item_mean_extremes'),
mean_texts AS (SELECT h.region, h.rule_id, h.title || '均值最高的题项为' || h.category || '（' || {NUMBER_TEXT_SQL.format('coalesce(h.mean, h.value)')}
  || '），最低的题项为' || l.category || '（' || {NUMBER_TEXT_SQL.format('coalesce(l.mean, l.value)')} || '）。' AS text
  FROM high h JOIN high l USING (region, rule_id) WHERE h.rk = 1 AND l.rk = l.total)"""
SIZE_SQL = f"""firsts AS (SELECT *, row_number() OVER (PARTITION BY region, rule_id ORDER BY {ORDER_SQL}) AS rk FROM placed WHERE template = 'sample_size'),
size_texts AS (SELECT region, rule_id, '共回收有效问卷' || coalesce(n, count, denominator) || '份。' AS text FROM firsts WHERE rk = 1)"""
TEXTS_SQL = f"""{TOPN_SQL}, {EXTREMES_SQL}, {SIZE_SQL}, texts AS (
  SELECT * FROM top_texts UNION ALL SELECT * FROM mean_texts UNION ALL SELECT * FROM size_texts)"""
GROUP = ["region", "rule_id"]


def placed_rows(spark, sf):
    """Chart rows with the region of their school: the report's target."""
    places = B.table(spark, sf, "nation").join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("school"), F.col("r_name").alias("region"))
    return rows_of(spark, sf).join(places, "school")


@query("topn_text", PLACED_SQL + f", {TOPN_SQL} SELECT region, rule_id, text FROM top_texts")
def topn_text(spark, sf):
    return C.topn_texts(placed_rows(spark, sf).filter("text_template_id = 'topn'"), GROUP, C.largest_top_n(typed_rules(spark)))


@query("mean_extremes_text", PLACED_SQL + f", {EXTREMES_SQL} SELECT region, rule_id, text FROM mean_texts")
def mean_extremes_text(spark, sf):
    return C.mean_extreme_texts(placed_rows(spark, sf).filter("text_template_id = 'item_mean_extremes'"), GROUP)


@query("sample_size_text", PLACED_SQL + f", {SIZE_SQL} SELECT region, rule_id, text FROM size_texts")
def sample_size_text(spark, sf):
    return C.sample_size_texts(placed_rows(spark, sf).filter("text_template_id = 'sample_size'"), GROUP)


@query("report_artifact", PLACED_SQL + f""", {TEXTS_SQL},
results AS (SELECT region, rule_id, min(title) AS title, '备注：样本量 N=' || coalesce(max(n), 0) || '。' AS note FROM placed GROUP BY region, rule_id),
plan AS (SELECT region, rules.*, false AS loose FROM (SELECT DISTINCT region FROM results) t CROSS JOIN rules WHERE rule_id <> 'rr_004'
  UNION ALL SELECT region, 'rr_404', 7, '', '', '缺失', '', ['x'], 1, 'topn', false FROM (SELECT DISTINCT region FROM results) t
  UNION ALL SELECT region, rule_id, 2147483647, 'unassigned', '未分配图表', title, '', ['x'], 1, 'topn', true FROM results WHERE rule_id = 'rr_004'),
ch AS (SELECT chapter, row_number() OVER (ORDER BY o) AS chapter_no FROM (VALUES ('c1', 1), ('c2', 3), ('c3', 6), ('chapter', 7), ('unassigned', 9)) v(chapter, o))
SELECT '课程实施监测报告' AS title, p.region, chapter_no::INTEGER AS chapter_no, coalesce(nullif(p.chapter_id, ''), 'chapter') AS chapter_id,
  coalesce(nullif(p.chapter_title, ''), 'chapter') AS chapter_title,
  row_number() OVER (PARTITION BY p.region, p.chapter_id ORDER BY p.ord)::INTEGER AS section_no, p.rule_id, p.title AS section_title,
  r.rule_id IS NOT NULL AS has_chart, x.text, r.note,
  CASE WHEN r.rule_id IS NULL THEN 'Missing chart result for rule ' || p.rule_id || '.' END AS issue
FROM plan p JOIN ch ON chapter = coalesce(nullif(p.chapter_id, ''), 'chapter') LEFT JOIN results r USING (region, rule_id) LEFT JOIN texts x USING (region, rule_id)""")
def report_artifact(spark, sf):
    """One nested report per region, shown section by section. Rule rr_004 is not
    in the report's rule list, so its charts land in the unassigned chapter."""
    from surveyloom.sources.local import small_table
    rows = cut_lineage(placed_rows(spark, sf))
    results = cut_lineage(C.chart_results(rows, GROUP, C.largest_top_n(typed_rules(spark))))
    ordered = [(i + 1, *r[:4]) for i, r in enumerate(_listed_rules())]
    rules = small_table(spark, ordered, "ord int, report_rule_id string, chapter_id string, chapter_title string, section_title string")
    nested = C.report_artifacts(C.report_sections(results, rules, "region"), "region")
    chapters = nested.select("title", "region", F.posexplode("chapters").alias("chapter_no", "c"))
    sections = chapters.select(
        "title", "region", (F.col("chapter_no") + 1).alias("chapter_no"), F.col("c.chapter_id").alias("chapter_id"),
        F.col("c.chapter_title").alias("chapter_title"), F.posexplode("c.sections").alias("section_no", "s"))
    return sections.select(
        "title", "region", "chapter_no", "chapter_id", "chapter_title", (F.col("section_no") + 1).alias("section_no"),
        *[F.col(f"s.{c}").alias(c) for c in ("rule_id", "section_title", "has_chart", "text", "note", "issue")])


def _listed_rules():
    from surveyloom.queries.metrics import REPORT_RULES
    return [r for r in REPORT_RULES if r[0] not in ("rr_004", "rr_005")] + [("rr_404", "", "", "缺失")]


QUALITY_SQL = answer_ingest.ROWS_SQL + f""", q AS (
  SELECT 'normalize' AS stage, 'warning' AS severity, 'unmatched_question' AS check_type, CAST(source_row_index AS VARCHAR) AS key FROM answer_rows WHERE question_no = '5'
  UNION ALL SELECT 'titles', 'error', 'title_parts', unnest(['parts_wide.xlsx', 'notes.xlsx']) FROM (SELECT count(*) FROM part)
  UNION ALL SELECT 'titles', 'warning', 'title_metadata_conflict', source_file FROM files WHERE r_regionkey >= 2
  UNION ALL SELECT 'rules', 'error', 'malformed_rule_json', 'broken' FROM (SELECT unnest([1, 2]))
  UNION ALL SELECT 'rules', 'error', 'malformed_rule_json', 'rr_005'
  UNION ALL SELECT 'charts', 'error', 'unknown_chart_type', 'rr_004'
  UNION ALL SELECT 'charts', 'warning', 'table_preview_fallback', unnest(['rr_004', 'rr_006'])
  UNION ALL SELECT 'questions', 'warning', 'no_answer_components', CAST(doc_id AS VARCHAR) FROM documents
    WHERE (NOT contains(text, chr(10)) AND length(text) >= 200) OR (contains(text, chr(10)) AND trim(replace(substr(text, strpos(text, chr(10))), chr(10), ' ')) = ''))"""


@query("quality_rollup", f"""WITH {QUALITY_SQL}
SELECT stage, check_type, CASE WHEN max(severity = 'error') THEN 'error' ELSE 'warning' END AS severity,
  count(CASE WHEN severity = 'error' THEN 1 END) AS blocking, count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings
FROM q GROUP BY stage, check_type""")
def quality_rollup(spark, sf):
    from surveyloom.operators.questions import missing_components
    from surveyloom.queries.question_forms import document_questions
    raw = answer_ingest.stored(spark, sf)
    facts = answer_ingest.facts(spark, sf, raw)
    _, title_checks = A.parse_titles(raw.select("source_file").distinct())
    _, indicator_issues = indicators.parse_rules(B.rules(spark))
    _, report_issues = rule_ops.parse_report_rules(report_rules(spark))
    charts = C.chart_checks(C.resolve_chart_types(typed_rules(spark)))
    shape = lambda df, stage, check, key: df.select(
        F.lit(stage).alias("stage"), "severity", F.col(check).alias("check_type"), F.col(key).cast("string").alias("key"))
    parts = [
        shape(A.unmatched_checks(facts), "normalize", "check_type", "source_row_index"),
        shape(title_checks, "titles", "check_type", "key"),
        shape(answer_ingest.conflicts_of(raw), "titles", "issue", "source_file"),
        shape(indicator_issues, "rules", "check_type", "key"), shape(report_issues, "rules", "check_type", "key"),
        shape(charts, "charts", "check_type", "rule_id"),
        shape(missing_components(document_questions(spark, sf)), "questions", "issue", "q_no"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return C.max_severity(union, ["stage", "check_type"])


@query("chart_severity", f"""SELECT * FROM (VALUES ('rr_004', 'error', 1::BIGINT, 1::BIGINT), ('rr_006', 'warning', 0, 1)) v(rule_id, severity, blocking, warnings)
  WHERE (SELECT count(*) FROM orders) > 0""")
def chart_severity(spark, sf):
    """Worst check per chart, for the charts that have rows."""
    checks = C.chart_checks(C.resolve_chart_types(typed_rules(spark)))
    drawn = rows_of(spark, sf).select("rule_id").distinct()
    return C.max_severity(checks.join(drawn, "rule_id", "left_semi"), ["rule_id"])
