"""Scale-score queries: order lines are respondents, their measures the items."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import scoring as S
from surveyloom.queries import query
from surveyloom.queries import bindings as B
from surveyloom.sources.local import small_table

KEYS = ["l_orderkey", "l_linenumber"]
INDEX = [
    ("discount", "price", "given", "MEAN;ClassThreshold(3.5)"), ("tax", "price", "taken", "MEAN"),
    ("quantity", "amount", None, "SUM;ClassThreshold(25)"), ("returned", "state", None, "FigureRate"),
    ("open", "state", None, "FigureRate"),
]


def index(spark):
    return small_table(spark, INDEX, "item string, dimension string, sub_dimension string, algorithm string")


def items(spark, sf):
    wide = B.table(spark, sf, "lineitem").select(
        *KEYS, F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100)).alias("discount"),
        F.round(F.col("l_tax") * 100).alias("tax"), F.col("l_quantity").alias("quantity"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_linestatus") == "O").cast("int").alias("open"))
    return S.unpivot_items(wide, KEYS, ["discount", "tax", "quantity", "returned", "open"])


ITEMS_SQL = """i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_discount * 100) END AS d, round(l_tax * 100) AS t,
  l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS r, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS o FROM lineitem),
dims AS (
  SELECT l_orderkey, l_linenumber, 'price' AS dimension, 'given' AS sub, d AS x FROM i UNION ALL
  SELECT l_orderkey, l_linenumber, 'price', 'taken', t FROM i UNION ALL
  SELECT l_orderkey, l_linenumber, 'amount', NULL, q FROM i UNION ALL
  SELECT l_orderkey, l_linenumber, 'state', NULL, r FROM i UNION ALL SELECT l_orderkey, l_linenumber, 'state', NULL, o FROM i),
scores AS (SELECT l_orderkey, l_linenumber, dimension, round(avg(x), 6) AS mean_score, round(sum(x), 6) AS sum_score,
  count(x) AS answered FROM dims GROUP BY ALL)"""


@query("dimension_scores", f"WITH {ITEMS_SQL} SELECT * FROM scores")
def dimension_scores(spark, sf):
    return S.dimension_scores(items(spark, sf), index(spark), KEYS)


@query("sub_dimension_scores", f"""WITH {ITEMS_SQL}
SELECT l_orderkey, l_linenumber, sub AS dimension, round(avg(x), 6) AS mean_score, round(sum(x), 6) AS sum_score, count(x) AS answered
FROM dims WHERE sub IS NOT NULL GROUP BY ALL""")
def sub_dimension_scores(spark, sf):
    return S.dimension_scores(items(spark, sf), index(spark), KEYS, level="sub_dimension")


@query("dimension_classes", f"""WITH {ITEMS_SQL}
SELECT l_orderkey, l_linenumber, 'threshold' AS kind, dimension, CASE WHEN mean_score >= CASE dimension WHEN 'price' THEN 3.5 ELSE 25 END THEN '达标' ELSE '未达标' END AS class,
  CASE WHEN mean_score >= CASE dimension WHEN 'price' THEN 3.5 ELSE 25 END THEN 1.0 ELSE 0.0 END::DOUBLE AS figure
FROM scores WHERE dimension IN ('price', 'amount')
UNION ALL SELECT l_orderkey, l_linenumber, 'choice', 'tax', CASE WHEN t <= 2 THEN '低' ELSE '高' END, CASE WHEN t <= 2 THEN 0.0 ELSE 1.0 END FROM i WHERE t IN (0, 1, 2, 7, 8)
UNION ALL SELECT l_orderkey, l_linenumber, 'rate', 'state', CAST(NULL AS VARCHAR), mean_score FROM scores WHERE dimension = 'state'""")
def dimension_classes(spark, sf):
    long, idx = items(spark, sf), index(spark)
    by_threshold = S.classes_by_threshold(S.dimension_scores(long, idx, KEYS), idx)
    choice = small_table(spark, [("tax", v, "tax", c) for v, c in ((0.0, "低"), (1.0, "低"), (2.0, "低"), (7.0, "高"), (8.0, "高"))],
                         "item string, value double, dimension string, class string")
    by_choice = S.classes_by_choice(long, choice)
    shape = lambda df, kind: S.figure_of_class(df, ["达标", "高"]).select(
        *KEYS, F.lit(kind).alias("kind"), "dimension", "class", F.col("figure").cast("double").alias("figure"))
    rates = S.figure_rates(long, idx, KEYS).select(
        *KEYS, F.lit("rate").alias("kind"), "dimension", F.lit(None).cast("string").alias("class"), F.col("rate").alias("figure"))
    return shape(by_threshold, "threshold").unionByName(shape(by_choice, "choice")).unionByName(rates)


@query("label_dictionary", """WITH b AS (SELECT DISTINCT p_brand FROM part), t AS (SELECT DISTINCT p_type FROM part)
SELECT 'p_brand' AS item, p_brand AS label, CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS code FROM b
UNION ALL SELECT 'p_type_反向后', p_type, CAST(row_number() OVER (ORDER BY p_type DESC) AS INTEGER) FROM t""")
def label_dictionary(spark, sf):
    """Value labels of items whose option lists are read from the data; a reversed
    item is renamed and labelled from n down to 1."""
    from surveyloom.operators.recoding import value_labels
    part = B.table(spark, sf, "part")
    lists = [part.select(F.lit(item).alias("item"), F.col(item).alias("o"), F.lit(rev).alias("reverse")).distinct()
             for item, rev in (("p_brand", None), ("p_type", "R"))]
    options = lists[0].unionByName(lists[1]).groupBy("item", "reverse").agg(
        F.array_join(F.array_sort(F.collect_list("o")), "//C//").alias("options"))
    named = options.withColumn("item", F.when(F.col("reverse") == "R", F.concat("item", F.lit("_反向后"))).otherwise(F.col("item")))
    return value_labels(named)
