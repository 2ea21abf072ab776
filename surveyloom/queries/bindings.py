"""The given tables read as survey data: who answered what, and which forms.

customer ⋈ nation ⋈ region are the respondents (school = nation, region), orders
a single choice, lineitem a numeric blank and a grid, events a multiple choice
and an upload, documents the questions of many questionnaires.
The ``*_SQL`` texts say the same for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.session import looked_up
from surveyloom.sources.local import small_table

FACT_COLUMNS = [
    "fact_id", "ord", "role", "subject", "school", "region", "grade", "semester", "user_id", "norm_id",
    "question_type", "answer_component_id", "answer_component_label", "field_value", "raw_value",
    "field_id", "dimension_id", "dimension_name", "dimension_title",
]


TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The schema is given, so no job reads file footers to guess it."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def respondents(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("c_custkey"), F.col("c_custkey").cast("string").alias("user_id"),
        F.col("n_name").alias("school"), F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("role"), F.col("c_acctbal"),
    )


RESPONDENTS_SQL = """respondents AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS user_id, n_name AS school, r_name AS region,
         c_mktsegment AS role, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _facts(df: DataFrame, **given) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (given[c] if c in given else F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
        for c in FACT_COLUMNS
    ])


def choice_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Single choice: the priority of an order."""
    o = table(spark, sf, "orders").join(looked_up(respondents(spark, sf)), F.col("o_custkey") == F.col("c_custkey"))
    return _facts(
        o, fact_id=F.concat(F.lit("o"), "o_orderkey"), ord=F.col("o_orderkey"), subject=F.col("o_orderstatus"),
        grade=F.year("o_orderdate").cast("string"), norm_id=F.lit("QG_PRIORITY"),
        question_type=F.lit("单选题"), field_value=F.col("o_orderpriority"), raw_value=F.col("o_orderpriority"),
    )


CHOICE_SQL = RESPONDENTS_SQL + """, choice AS (
  SELECT 'o' || o_orderkey AS fact_id, o_orderkey AS ord, role, o_orderstatus AS subject, school, region,
         CAST(year(o_orderdate) AS VARCHAR) AS grade, user_id, 'QG_PRIORITY' AS norm_id,
         '单选题' AS question_type, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS label,
         o_orderpriority AS value, CAST(NULL AS VARCHAR) AS dimension
  FROM orders JOIN respondents ON o_custkey = c_custkey)"""


def answered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their respondent. The last join deals the rows by respondent, so a task that
    counts them holds its own respondents and not all there are, as it would beside a broadcast."""
    return table(spark, sf, "lineitem").join(
        looked_up(table(spark, sf, "orders").select("o_orderkey", "o_custkey")), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(looked_up(respondents(spark, sf)), F.col("o_custkey") == F.col("c_custkey"))


def quantity_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric blank: the quantity of an order line. Lines of status ``F`` are
    blank and every ``R`` line holds a word, so parsing has something to refuse."""
    li = answered_lines(spark, sf)
    value = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), F.lit("")).when(
        F.col("l_returnflag") == "R", F.concat(F.lit("about "), F.col("l_quantity").cast("int"))
    ).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return _facts(
        li, fact_id=F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber"), ord=F.col("l_orderkey") * 16 + F.col("l_linenumber"),
        subject=F.lit("all"), norm_id=F.lit("QG_QTY"), question_type=F.lit("填空题"),
        field_value=value, raw_value=value,
    )


QUANTITY_SQL = """quantity AS (
  SELECT 'l-' || l_orderkey || '-' || l_linenumber AS fact_id, l_orderkey * 16 + l_linenumber AS ord, role,
         'all' AS subject, school, region, CAST(NULL AS VARCHAR) AS grade, user_id, 'QG_QTY' AS norm_id,
         '填空题' AS question_type, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS label,
         CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN ''
              WHEN l_returnflag = 'R' THEN 'about ' || CAST(l_quantity AS INTEGER)
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS value,
         CAST(NULL AS VARCHAR) AS dimension
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN respondents ON o_custkey = c_custkey)"""


def grid_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Grid question: return flag (row) by line status (column)."""
    li = answered_lines(spark, sf)
    return _facts(
        li, fact_id=F.concat_ws("-", F.lit("g"), "l_orderkey", "l_linenumber"), ord=F.col("l_orderkey") * 16 + F.col("l_linenumber"),
        subject=F.lit("all"), norm_id=F.lit("QG_GRID"), question_type=F.lit("矩阵题"),
        answer_component_id=F.col("l_linestatus"), answer_component_label=F.col("l_linestatus"),
        field_value=F.lit("1"), raw_value=F.lit("1"), dimension_name=F.col("l_returnflag"),
    )


GRID_SQL = """grid AS (
  SELECT 'g-' || l_orderkey || '-' || l_linenumber AS fact_id, l_orderkey * 16 + l_linenumber AS ord, role,
         'all' AS subject, school, region, CAST(NULL AS VARCHAR) AS grade, user_id, 'QG_GRID' AS norm_id,
         '矩阵题' AS question_type, l_linestatus AS component, l_linestatus AS label, '1' AS value,
         l_returnflag AS dimension
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN respondents ON o_custkey = c_custkey)"""


def multi_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Multiple choice: one 0/1 answer per event type, 1 when the value exceeds 10."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "e_user").join(
        looked_up(respondents(spark, sf)), F.col("e_user") == F.col("c_custkey"))
    value = F.when(F.col("value") > 10, F.lit("1")).otherwise(F.lit("0"))
    return _facts(
        e, fact_id=F.concat(F.lit("e"), "event_id"), ord=F.col("event_id"), subject=F.lit("all"),
        norm_id=F.lit("QG_EVENT"), question_type=F.lit("多选题"), answer_component_id=F.col("event_type"),
        answer_component_label=F.col("event_type"), field_value=value, raw_value=value,
    )


MULTI_SQL = """multi AS (
  SELECT 'e' || event_id AS fact_id, event_id AS ord, role, 'all' AS subject, school, region,
         CAST(NULL AS VARCHAR) AS grade, r.user_id, 'QG_EVENT' AS norm_id, '多选题' AS question_type,
         event_type AS component, event_type AS label, CASE WHEN value > 10 THEN '1' ELSE '0' END AS value,
         CAST(NULL AS VARCHAR) AS dimension
  FROM events e JOIN respondents r ON e.user_id = r.c_custkey)"""


def upload_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Upload: the event payload, blank when its number is below 20."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "e_user").join(
        looked_up(respondents(spark, sf)), F.col("e_user") == F.col("c_custkey"))
    k = F.get_json_object("props", "$.k").cast("int")
    value = F.when(k < 20, F.lit("")).otherwise(F.col("props"))
    return _facts(
        e, fact_id=F.concat(F.lit("u"), "event_id"), ord=F.col("event_id"), subject=F.lit("all"),
        norm_id=F.lit("QG_UPLOAD"), question_type=F.lit("上传题"), field_value=value, raw_value=value,
    )


UPLOAD_SQL = """upload AS (
  SELECT 'u' || event_id AS fact_id, event_id AS ord, role, 'all' AS subject, school, region,
         CAST(NULL AS VARCHAR) AS grade, r.user_id, 'QG_UPLOAD' AS norm_id, '上传题' AS question_type,
         CAST(NULL AS VARCHAR) AS component, CAST(NULL AS VARCHAR) AS label,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 20 THEN '' ELSE props END AS value,
         CAST(NULL AS VARCHAR) AS dimension
  FROM events e JOIN respondents r ON e.user_id = r.c_custkey)"""


def all_facts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [f(spark, sf) for f in (choice_facts, quantity_facts, grid_facts, multi_facts, upload_facts)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


ALL_SQL = ", ".join([CHOICE_SQL, QUANTITY_SQL, GRID_SQL, MULTI_SQL, UPLOAD_SQL]) + """, facts AS (
  SELECT * FROM choice UNION ALL SELECT * FROM quantity UNION ALL SELECT * FROM grid
  UNION ALL SELECT * FROM multi UNION ALL SELECT * FROM upload)"""

# Rule table used by the indicator and metric queries.
RULE_SCHEMA = (
    "rule_id string, source_norm_ids_json string, target_indicator_id string, target_indicator_name string,"
    " transform_type string, group_by_json string, value_mapping_json string, output_grain string,"
    " output_value_type string, answer_component_id string, field_id string, dimension_id string"
)
PRIORITY_SCORES = (
    '{"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2}'
)
RULES = [
    ("scale_school", '["QG_PRIORITY"]', "IND_PRIORITY", "优先级得分", "scale_score", '["school", "role"]',
     PRIORITY_SCORES, "school", "score", "", "", ""),
    ("scale_user", '["QG_PRIORITY"]', "IND_PRIORITY_USER", "个人优先级得分", "scale_score", "[]",
     PRIORITY_SCORES, "user", "score", "", "", ""),
    ("cover_school", '["QG_EVENT"]', "IND_EVENT", "事件覆盖率", "multi_select_coverage", '["school"]',
     "{}", "school", "ratio", "", "", ""),
    ("cover_click", '["QG_EVENT", "QG_NONE"]', "IND_CLICK", "点击覆盖率", "multi_select_coverage",
     '["region", "role"]', "", "region", "ratio", "click", "", ""),
    ("cover_upload", '["QG_UPLOAD"]', "IND_UPLOAD", "上传覆盖率", "multi_select_coverage", '["school"]',
     "", "school", "ratio", "", "", ""),
    ("select_none", "[]", "IND_NONE", "空", "scale_score", '["school"]', PRIORITY_SCORES, "school", "score",
     "", "", ""),
    ("broken", '["QG_PRIORITY"', "IND_BROKEN", "坏规则", "scale_score", '["school"]', "not json", "school",
     "score", "", "", ""),
    ("other_transform", '["QG_PRIORITY"]', "IND_OTHER", "其他", "weighted", '["school"]', "{}", "school",
     "score", "", "", ""),
]


def rules(spark: SparkSession) -> DataFrame:
    return small_table(spark, RULES, RULE_SCHEMA)
