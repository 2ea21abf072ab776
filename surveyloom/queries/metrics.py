"""Metric, indicator and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import indicators, metrics, rules as rule_ops
from surveyloom.queries import query
from surveyloom.queries import bindings as B
from surveyloom.sources.local import small_table

NUMBER_SQL = ("CASE WHEN regexp_matches(trim(value), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
              " THEN TRY_CAST(trim(value) AS DOUBLE) END")
UNSELECTED_SQL = "trim(coalesce(value, '')) IN ('', '0', '否', '未选', 'false', 'False')"
GROUP_SQL = "role, subject, norm_id, school"


@query("response_count", f"""WITH {B.ALL_SQL}
SELECT {GROUP_SQL}, 'respondents' AS category, count(DISTINCT user_id) AS count, count(DISTINCT user_id) AS n
FROM facts GROUP BY ALL""")
def response_count(spark, sf):
    return metrics.response_count(B.all_facts(spark, sf))


OPTION_SQL = """
SELECT a.role, a.subject, a.norm_id, a.school, a.category, a.cnt AS count, d.denominator,
       round(a.cnt / d.denominator, 6) AS percent, d.denominator AS n
FROM (SELECT role, subject, norm_id, school, coalesce(label, nullif(value, '')) AS category,
             count(DISTINCT user_id) AS cnt
      FROM {src} WHERE coalesce(label, nullif(value, '')) IS NOT NULL {extra} GROUP BY ALL) a
JOIN (SELECT role, subject, norm_id, school, count(DISTINCT user_id) AS denominator FROM {src} GROUP BY ALL) d
USING (role, subject, norm_id, school)"""


@query("option_summary", f"WITH {B.ALL_SQL}" + OPTION_SQL.format(src="facts", extra=""))
def option_summary(spark, sf):
    return metrics.option_summary(B.all_facts(spark, sf))


@query("option_summary_selected", f"WITH {B.RESPONDENTS_SQL}, {B.MULTI_SQL}"
       + OPTION_SQL.format(src="multi", extra=f"AND NOT ({UNSELECTED_SQL})"))
def option_summary_selected(spark, sf):
    return metrics.option_summary(B.multi_facts(spark, sf), selected_only=True)


@query("numeric_summary", f"""WITH {B.ALL_SQL}
SELECT {GROUP_SQL}, 'numeric' AS category, round(avg({NUMBER_SQL}), 6) AS mean,
       round(stddev_pop({NUMBER_SQL}), 6) AS sd, count({NUMBER_SQL}) AS n
FROM facts WHERE norm_id = 'QG_QTY' GROUP BY {GROUP_SQL} HAVING count({NUMBER_SQL}) > 0""")
def numeric_summary(spark, sf):
    return metrics.numeric_summary(B.all_facts(spark, sf))


@query("upload_summary", f"""WITH {B.ALL_SQL}
SELECT {GROUP_SQL}, 'uploaded' AS category, count(DISTINCT CASE WHEN value <> '' THEN user_id END) AS count,
       count(DISTINCT user_id) AS denominator,
       round(count(DISTINCT CASE WHEN value <> '' THEN user_id END) / count(DISTINCT user_id), 6) AS percent,
       count(DISTINCT user_id) AS n
FROM facts WHERE norm_id = 'QG_UPLOAD' GROUP BY {GROUP_SQL}""")
def upload_summary(spark, sf):
    return metrics.upload_summary(B.all_facts(spark, sf))


@query("matrix_summary", f"""WITH {B.RESPONDENTS_SQL}, {B.GRID_SQL}
SELECT {GROUP_SQL}, dimension AS category, label AS series, count(*) AS count, count(DISTINCT user_id) AS n
FROM grid GROUP BY {GROUP_SQL}, dimension, label""")
def matrix_summary(spark, sf):
    return metrics.matrix_summary(B.grid_facts(spark, sf))


def _score(value: str) -> str:
    return (f"CASE {value} WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 4.0 WHEN '3-MEDIUM' THEN 3.0"
            " WHEN '4-NOT SPECIFIED' THEN 2.0 END")


SCALE_PARTS_SQL = f"""
scored AS (SELECT *, {_score('value')} AS score FROM choice),
scale AS (
  SELECT 'scale_school' AS source_rule_id, 'IND_PRIORITY' AS indicator_id, '优先级得分' AS indicator_name,
         school || chr(1) || role AS group_key, CAST(NULL AS VARCHAR) AS user_id,
         arg_min(school, ord) AS school, arg_min(role, ord) AS role, arg_min(subject, ord) AS subject,
         arg_min(grade, ord) AS grade, round(avg(score), 6) AS indicator_value, count(*) AS source_rows
  FROM scored GROUP BY school, role HAVING count(score) > 0
  UNION ALL
  SELECT 'scale_user', 'IND_PRIORITY_USER', '个人优先级得分', user_id, arg_min(user_id, ord),
         arg_min(school, ord), arg_min(role, ord), arg_min(subject, ord), arg_min(grade, ord),
         round(avg(score), 6), count(*)
  FROM scored GROUP BY user_id HAVING count(score) > 0)"""


@query("indicator_scale_score", f"WITH {B.CHOICE_SQL}, {SCALE_PARTS_SQL} SELECT * FROM scale")
def indicator_scale_score(spark, sf):
    typed, _ = indicators.parse_rules(B.rules(spark))
    built = indicators.rebuild_indicators(
        B.choice_facts(spark, sf), typed.filter("transform_type = 'scale_score'"))
    return built.select(
        "source_rule_id", "indicator_id", "indicator_name", F.array_join("group_key", "\x01").alias("group_key"),
        "user_id", "school", "role", "subject", "grade", "indicator_value", "source_rows")


IDS_SQL = """
facts_of AS (SELECT 'scale_school' AS rule, 'IND_PRIORITY' AS indicator, 'school' AS grain, school || chr(31) || role AS k, fact_id FROM scored
  UNION ALL SELECT 'scale_user', 'IND_PRIORITY_USER', 'user', user_id, fact_id FROM scored),
digests AS (SELECT rule, indicator, grain, k, count(*) || ':' || sum(CAST('0x' || substr(md5(fact_id), 1, 15) AS BIGINT)) AS source_digest
  FROM facts_of GROUP BY ALL)"""


@query("indicator_ids", f"""WITH {B.CHOICE_SQL}, {SCALE_PARTS_SQL}, {IDS_SQL}
SELECT rule AS source_rule_id, d.k AS group_key, source_digest,
  'r_' || substr(sha1(concat_ws('|', rule, indicator, grain, d.k, source_digest)), 1, 16) AS recon_id
FROM digests d JOIN scale s ON s.source_rule_id = rule AND s.group_key = replace(d.k, chr(31), chr(1))""")
def indicator_ids(spark, sf):
    """One id formula for groups of every size."""
    typed, _ = indicators.parse_rules(B.rules(spark))
    built = indicators.rebuild_indicators(
        B.choice_facts(spark, sf), typed.filter("transform_type = 'scale_score'"), source_ids=True)
    return built.select("source_rule_id", F.array_join("group_key", "\x1f").alias("group_key"), "source_digest", "recon_id")


@query("indicator_sources", f"""WITH {B.CHOICE_SQL}, {SCALE_PARTS_SQL}, {IDS_SQL}
SELECT rule AS source_rule_id, k AS group_key, f.fact_id, ord AS place FROM facts_of f JOIN scored USING (fact_id)""")
def indicator_sources(spark, sf):
    typed, _ = indicators.parse_rules(B.rules(spark))
    rows = indicators.rule_rows(B.choice_facts(spark, sf), typed.filter("transform_type = 'scale_score'"))
    return indicators.indicator_sources(rows).select(
        F.col("rule_id").alias("source_rule_id"), F.array_join("group_key", "\x1f").alias("group_key"), "fact_id", "place")


COVER_SQL = f"""
SELECT 'cover_school' AS source_rule_id, school AS group_key, count(DISTINCT CASE WHEN NOT ({UNSELECTED_SQL}) THEN component END) AS num,
       count(DISTINCT component) AS den FROM multi GROUP BY school
UNION ALL
SELECT 'cover_click', region || chr(1) || role, count(DISTINCT CASE WHEN NOT ({UNSELECTED_SQL}) THEN component END),
       count(DISTINCT component) FROM multi WHERE component = 'click' GROUP BY region, role
UNION ALL
SELECT 'cover_upload', school, count(DISTINCT CASE WHEN NOT ({UNSELECTED_SQL}) THEN user_id END),
       count(DISTINCT user_id) FROM upload GROUP BY school"""


@query("indicator_coverage", f"""WITH {B.RESPONDENTS_SQL}, {B.MULTI_SQL}, {B.UPLOAD_SQL}, cover AS ({COVER_SQL})
SELECT source_rule_id, group_key, round(CASE WHEN den = 0 THEN 0 ELSE num / den END, 6) AS indicator_value,
       num || '/' || den AS indicator_value_label FROM cover""")
def indicator_coverage(spark, sf):
    typed, _ = indicators.parse_rules(B.rules(spark))
    facts = B.multi_facts(spark, sf).unionByName(B.upload_facts(spark, sf))
    built = indicators.rebuild_indicators(facts, typed.filter("transform_type = 'multi_select_coverage'"))
    return built.select("source_rule_id", F.array_join("group_key", "\x01").alias("group_key"),
                        "indicator_value", "indicator_value_label")


SCOPE_SQL = "'{\"school\": \"' || school || '\"}'"
METRICS_SQL = f"""WITH {B.ALL_SQL}, {SCALE_PARTS_SQL},
opt AS ({OPTION_SQL.format(src="facts", extra="")}),
parts AS (
  SELECT 'response_count' AS metric_type, {GROUP_SQL}, '' AS indicator_id, 'respondents' AS category, '' AS series,
         count(DISTINCT user_id) AS count, CAST(NULL AS BIGINT) AS denominator, CAST(NULL AS DOUBLE) AS percent,
         CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd, count(DISTINCT user_id) AS n
  FROM facts GROUP BY {GROUP_SQL}
  UNION ALL
  SELECT 'option_summary', {GROUP_SQL}, '', category, '', count, denominator, percent, NULL, NULL, n FROM opt
  UNION ALL
  SELECT 'numeric_summary', {GROUP_SQL}, '', 'numeric', '', NULL, NULL, NULL, round(avg({NUMBER_SQL}), 6),
         round(stddev_pop({NUMBER_SQL}), 6), count({NUMBER_SQL})
  FROM facts WHERE norm_id = 'QG_QTY' GROUP BY {GROUP_SQL} HAVING count({NUMBER_SQL}) > 0
  UNION ALL
  SELECT 'upload_summary', {GROUP_SQL}, '', 'uploaded', '', count(DISTINCT CASE WHEN value <> '' THEN user_id END),
         count(DISTINCT user_id),
         round(count(DISTINCT CASE WHEN value <> '' THEN user_id END) / count(DISTINCT user_id), 6), NULL, NULL,
         count(DISTINCT user_id)
  FROM facts WHERE norm_id = 'QG_UPLOAD' GROUP BY {GROUP_SQL}
  UNION ALL
  SELECT 'matrix_summary', {GROUP_SQL}, '', dimension, label, count(*), NULL, NULL, NULL, NULL,
         count(DISTINCT user_id)
  FROM grid GROUP BY {GROUP_SQL}, dimension, label
  UNION ALL
  SELECT 'indicator_value', role, subject, '', school, indicator_id, indicator_name, '', NULL, NULL, NULL,
         indicator_value, NULL, 1 FROM scale)"""
METRICS_SELECT_SQL = f"""
SELECT 'm_' || substr(sha1(concat_ws('|', metric_type, {SCOPE_SQL}, norm_id, indicator_id, category, series, '')), 1, 16)
         AS metric_id,
       metric_type, {SCOPE_SQL} AS scope_key_json, role, subject, norm_id, indicator_id, category, series, '' AS stack,
       count, denominator, percent, mean, sd, n
FROM parts"""


def full_metrics(spark, sf):
    typed, _ = indicators.parse_rules(B.rules(spark))
    built = indicators.rebuild_indicators(
        B.choice_facts(spark, sf), typed.filter("transform_type = 'scale_score'"))
    return metrics.metrics_summary(B.all_facts(spark, sf), built)


@query("metrics_summary", METRICS_SQL + METRICS_SELECT_SQL)
def metrics_summary(spark, sf):
    return full_metrics(spark, sf).select(*metrics.METRIC_COLUMNS)


@query("provenance_lists", f"""WITH {B.ALL_SQL}
SELECT {GROUP_SQL}, coalesce(label, nullif(value, '')) AS category, fact_id, min(ord) AS first_seen
FROM facts WHERE coalesce(label, nullif(value, '')) IS NOT NULL GROUP BY ALL""")
def provenance_lists(spark, sf):
    return metrics.fact_sources(B.all_facts(spark, sf))


# --- rules -------------------------------------------------------------------------

REPORT_RULES = [
    # rule, chapter, chapter title, section title, ids, chart type, filter scope, writing metrics, text template
    ("rr_001", "c1", "基础", "优先级", "QG_PRIORITY, IND_PRIORITY", "distribution_bar",
     '{"region": ["ASIA", "EUROPE"], "role": "BUILDING"}', '{"top_n": 2}', "topn"),
    ("rr_002", "c1", "基础", "数量", "QG_QTY", "table_items", '{"role": ["MACHINERY", "AUTOMOBILE"], "colour": "red"}',
     "", "item_mean_extremes"),
    ("rr_003", "c2", "行为", "事件", "QG_EVENT,,QG_GRID ", "plot_simple_heatmap", '{"school": [], "region": "AFRICA"}',
     '{"top_n": 3}', "sample_size"),
    ("rr_004", "c2", "行为", "全部", "", "sunburst", "", "", "topn"),
    ("rr_005", "c3", "上传", "上传率", "QG_UPLOAD", "mpl_pie", '{not json}', "", "topn"),
    ("rr_006", "c3", "上传", "个人", "IND_PRIORITY_USER", "correlation_point", '{"subject": "F"}', '{"top_n": "x"}', "topn"),
]
REPORT_RULE_SCHEMA = (
    "report_rule_id string, chapter_id string, chapter_title string, section_title string,"
    " norm_ids_or_indicator_ids string, chart_type string, filter_scope_json string,"
    " writing_metrics_json string, text_template_id string"
)


def report_rules(spark):
    return small_table(spark, REPORT_RULES, REPORT_RULE_SCHEMA)


@query("scope_filter", f"""WITH {B.CHOICE_SQL}
SELECT 'rr_001' AS report_rule_id, fact_id, school, region, role FROM choice
 WHERE region IN ('ASIA', 'EUROPE') AND role = 'BUILDING'
UNION ALL SELECT 'rr_002', fact_id, school, region, role FROM choice WHERE role IN ('MACHINERY', 'AUTOMOBILE')
UNION ALL SELECT 'rr_003', fact_id, school, region, role FROM choice WHERE region = 'AFRICA'
UNION ALL SELECT 'rr_004', fact_id, school, region, role FROM choice
UNION ALL SELECT 'rr_006', fact_id, school, region, role FROM choice WHERE subject = 'F'""")
def scope_filter(spark, sf):
    typed, _ = rule_ops.parse_report_rules(report_rules(spark))
    return rule_ops.apply_scopes(B.choice_facts(spark, sf), typed).select(
        "report_rule_id", "fact_id", "school", "region", "role")


@query("rule_fact_filter", f"""WITH {B.CHOICE_SQL}, {B.MULTI_SQL}
SELECT 'scale_school' AS rule_id, norm_id, fact_id FROM choice
UNION ALL SELECT 'scale_user', norm_id, fact_id FROM choice
UNION ALL SELECT 'other_transform', norm_id, fact_id FROM choice
UNION ALL SELECT 'cover_school', norm_id, fact_id FROM multi
UNION ALL SELECT 'cover_click', norm_id, fact_id FROM multi WHERE component = 'click'""")
def rule_fact_filter(spark, sf):
    typed, _ = indicators.parse_rules(B.rules(spark))
    facts = B.choice_facts(spark, sf).unionByName(B.multi_facts(spark, sf))
    return indicators.matched_facts(facts, typed).select("rule_id", "norm_id", "fact_id")
