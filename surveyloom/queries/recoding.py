"""Recoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import values as V
from surveyloom.operators import recoding as R
from surveyloom.queries import query
from surveyloom.queries import bindings as B
from surveyloom.sources.local import small_table

SIZE_BANDS = [(None, 9, "9及以下"), (10, 19, "10-19"), (20, 34, "20-34"), (35, None, "35以上")]
TYPE_MERGE = [("ECONOMY", "普通"), ("STANDARD", "普通"), ("PROMO", "促销")]


@query("recode_bands", """SELECT p_partkey, p_size, CASE WHEN p_size <= 9 THEN '9及以下' WHEN p_size BETWEEN 10 AND 19 THEN '10-19'
  WHEN p_size BETWEEN 20 AND 34 THEN '20-34' WHEN p_size >= 35 THEN '35以上' END AS size_band,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN '普通' WHEN p_type = 'PROMO' THEN '促销' ELSE p_type END AS type_group,
  CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 END AS brand_code,
  CASE WHEN p_size >= 3 THEN 1 ELSE 0 END AS flag FROM part""")
def recode_bands(spark, sf):
    from surveyloom.operators.scoring import threshold_flag
    part = B.table(spark, sf, "part")
    merged = R.merge_options(part, "p_type", small_table(spark, TYPE_MERGE, "option string, merged string"), "type_group")
    return merged.select(
        "p_partkey", "p_size", V.band(F.col("p_size"), SIZE_BANDS).alias("size_band"), "type_group",
        V.recode(F.col("p_brand"), {"Brand#1": 1, "Brand#2": 2}).alias("brand_code"),
        threshold_flag(F.col("p_size")).alias("flag"))


@query("shift_choice", """SELECT l_orderkey, l_linenumber, l_linenumber AS before, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS shifted,
  l_quantity AS quantity_raw, l_quantity - 1 AS quantity FROM lineitem""")
def shift_choice(spark, sf):
    rows = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"))
    shifted = rows.withColumns({"before": F.col("l_linenumber"), "shifted": V.drop_first_choice(F.col("l_linenumber"))})
    return R.minus_one(shifted, ["quantity"])


@query("reverse_score", """SELECT p_partkey, p_size AS p_size_before, (SELECT max(p_size) FROM part) + 1.0::DOUBLE - p_size AS p_size,
  p_retailprice AS p_retailprice_before, round((SELECT max(p_retailprice) FROM part) + 1 - p_retailprice, 6) AS p_retailprice FROM part""")
def reverse_score(spark, sf):
    part = B.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    reversed_ = R.reverse_items(part, ["p_size", "p_retailprice", "not_there"])
    return reversed_.withColumn("p_retailprice", F.round("p_retailprice", 6))


ITEM_INDEX = [
    ("o_orderpriority", "1-URGENT//C//2-HIGH//C//3-MEDIUM_______//C// 4-NOT SPECIFIED//C//5-LOW", "R"),
    ("o_orderstatus", "F//C//O//C//P_______", None),
    ("o_clerk", "", None),
]


def _choices(spark, sf):
    orders = B.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "P", F.concat(F.col("o_orderstatus"), F.lit("_______ part"))).otherwise(F.col("o_orderstatus"))
    return orders.select("o_orderkey", "o_orderpriority", status.alias("o_orderstatus")).unpivot(
        ["o_orderkey"], ["o_orderpriority", "o_orderstatus"], "item", "answer")


@query("choice_codes", """SELECT o_orderkey, 'o_orderpriority' AS item, o_orderpriority AS answer,
  6 - CAST(o_orderpriority[1] AS INTEGER) AS code FROM orders
UNION ALL SELECT o_orderkey, 'o_orderstatus', CASE WHEN o_orderstatus = 'P' THEN 'P_______ part' ELSE o_orderstatus END,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END FROM orders""")
def choice_codes(spark, sf):
    labels = R.value_labels(small_table(spark, ITEM_INDEX, "item string, options string, reverse string"))
    return R.encode_choices(_choices(spark, sf), labels)


def multi_answers(spark, sf):
    """Documents as multiple choice answers: their lines are the chosen entries."""
    return B.table(spark, sf, "documents").select("doc_id", "lang", F.replace("text", F.lit("\n"), F.lit("|\r\n")).alias("answer"))


@query("multi_select_onehot", """WITH c AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS chosen FROM orders GROUP BY o_custkey)
SELECT c_custkey, """ + ", ".join(
    f"CASE WHEN chosen IS NOT NULL THEN CAST(list_contains(chosen, '{p}') AS INTEGER) END AS \"chosen_{p}\""
    for p in ("1-URGENT", "3-MEDIUM", "5-LOW")) + """ FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def multi_select_onehot(spark, sf):
    picked = B.table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("_"))
    # a respondent has at most one entry per option, so the joined text is short
    texts = picked.groupBy("o_custkey").agg(F.concat_ws("|\r\n", F.array_sort(F.collect_list("o_orderpriority"))).alias("chosen"))
    people = B.table(spark, sf, "customer").join(texts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "chosen")
    return R.one_hot(people, "chosen", ["1-URGENT", "3-MEDIUM", "5-LOW"]).drop("chosen")


@query("chosen_count", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
k AS (SELECT doc_id, CAST(count(CASE WHEN x <> '' AND NOT contains(x, 'the') THEN 1 END)
        + max(CASE WHEN contains(x, 'the') THEN 1 ELSE 0 END) AS INTEGER) AS n FROM l GROUP BY doc_id)
SELECT doc_id, n, CASE WHEN n <= 2 THEN '0-2类' WHEN n <= 4 THEN '3-4类' ELSE '5类及以上' END AS band FROM k""")
def chosen_count(spark, sf):
    n = V.chosen_count(F.col("answer"), "", "the")
    counted = multi_answers(spark, sf).select("doc_id", n.alias("n"))
    return counted.withColumn("band", V.band(F.col("n"), [(0, 2, "0-2类"), (3, 4, "3-4类"), (5, None, "5类及以上")]))


def line_answers(spark, sf):
    """Lines of an order as a multi-blank answer ``12|\\n7|\\nx|\\n``."""
    li = B.table(spark, sf, "lineitem")
    blank = F.when(F.col("l_returnflag") == "R", F.lit("x")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    sep = F.when(F.col("l_linestatus") == "F", F.lit("|\r\n")).otherwise(F.lit("|"))
    return li.select("l_orderkey", "l_linenumber", F.concat(blank, sep, F.lit(" "), F.col("l_tax").cast("string"), F.lit("|\n"),
                     F.col("l_shipdate").cast("date").cast("string")).alias("answer"))


@query("blank_split", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS b1,
  l_tax AS b2, CAST(NULL AS DOUBLE) AS b3, CAST(NULL AS DOUBLE) AS b4 FROM lineitem""")
def blank_split(spark, sf):
    rows = line_answers(spark, sf)
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(f"b{i + 1}") for i, c in enumerate(V.split_blanks(F.col("answer"), 4))])


@query("scale_cell", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderpriority[1] AS DOUBLE) END AS score FROM orders""")
def scale_cell(spark, sf):
    cell = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).when(
        F.col("o_orderstatus") == "F", F.left("o_orderpriority", F.lit(1))).otherwise(
        F.concat(F.left("o_orderpriority", F.lit(1)), F.lit("("), F.col("o_orderpriority"), F.lit(")")))
    return B.table(spark, sf, "orders").select("o_orderkey", V.leading_score(cell).alias("score"))


@query("sleep_duration", """WITH h AS (SELECT l_orderkey, l_linenumber, l_linenumber + 3 AS wh, CAST(l_quantity AS INTEGER) AS wm,
    l_suppkey % 24 AS b, l_partkey % 60 AS bm FROM lineitem),
a AS (SELECT *, CASE WHEN b BETWEEN 8 AND 11 THEN b + 12 WHEN b = 12 THEN 0 ELSE b END AS bh FROM h),
m AS (SELECT *, CASE WHEN bh > 17 THEN wh * 60 + wm + (24 - bh) * 60 - bm WHEN bh < 8 THEN wh * 60 + wm - (bh * 60 + bm) END AS minutes FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN round(minutes / 60.0, 2) > 2 AND round(minutes / 60.0, 2) < 15 THEN CAST(round(minutes / 60.0, 2) AS DOUBLE) END AS hours FROM m""")
def sleep_duration(spark, sf):
    li = B.table(spark, sf, "lineitem")
    text = F.concat_ws("|", (F.col("l_linenumber") + 3).cast("string"), F.col("l_quantity").cast("int").cast("string"),
                       (F.col("l_suppkey") % 24).cast("string"), (F.col("l_partkey") % 60).cast("string"))
    return R.sleep_durations(li, text, "hours").select("l_orderkey", "l_linenumber", "hours")


@query("bounded_numeric", """SELECT event_id, CASE WHEN value <= 24 THEN value END AS hours FROM events""")
def bounded_numeric(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", V.bounded_hours(F.concat(F.col("value").cast("string"), F.lit("|"))).alias("hours"))


@query("skip_logic", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '本学期没有参加' WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS clerk FROM orders""")
def skip_logic(spark, sf):
    orders = B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("clerk"))
    return R.skip_logic(orders, [
        ("o_orderstatus", ["F"], "o_orderpriority", None), ("o_orderstatus", ["P"], "clerk", None),
        ("o_orderpriority", ["1-URGENT", "2-HIGH"], "clerk", "本学期没有参加")])


@query("head_sample", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 50")
def head_sample(spark, sf):
    """The first 50 rows by key: the limit is the report's own sample sheet."""
    return B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").limit(50)
