"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import statistics as S
from surveyloom.queries import query
from surveyloom.queries import bindings as B
from surveyloom.queries.crosstabs import ANSWERS_SQL, PRIORITIES, REGIONS, answers

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("box_summary", """WITH q AS (
  SELECT l_returnflag AS unit, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
         quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY ALL)
SELECT unit, n, min(CASE WHEN l_extendedprice >= q1 - 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
       round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       max(CASE WHEN l_extendedprice <= q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high
FROM lineitem JOIN q ON l_returnflag = unit GROUP BY unit, n, q1, median, q3""")
def box_summary(spark, sf):
    return S.box_summary(B.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("zscore_outliers", """SELECT event_id, value, CASE WHEN abs((value - (SELECT avg(value) FROM events))
  / (SELECT stddev_pop(value) FROM events)) > 2 THEN '异常值' END AS outlier FROM events""")
def zscore_outliers(spark, sf):
    return S.mark_outliers(B.table(spark, sf, "events").select("event_id", "value"), "value")


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for i, a in enumerate(MEASURES) for b in MEASURES[i:]))
def corr_matrix(spark, sf):
    return S.correlations(B.table(spark, sf, "lineitem"), MEASURES)


@query("linear_fit", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag""")
def linear_fit(spark, sf):
    return S.linear_fit(B.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")


@query("anova_f", """WITH g AS (SELECT p_brand, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
t AS (SELECT count(*) AS groups, sum(n) AS n, sum(n * m) / sum(n) AS grand FROM g),
s AS (SELECT groups, t.n, sum(g.n * (m - grand) ** 2) AS b, sum(g.n * v) AS w FROM g, t GROUP BY ALL)
SELECT groups, CAST(n AS BIGINT) AS n, groups - 1 AS df_between, CAST(n - groups AS BIGINT) AS df_within,
  round((b / (groups - 1)) / (w / (n - groups)), 6) AS f_value, round(b / (b + w), 8) AS eta_squared FROM s""")
def anova_f(spark, sf):
    parts = B.table(spark, sf, "part").select("p_partkey", "p_brand")
    return S.anova(B.table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand", "l_quantity")


@query("cronbach_alpha", """WITH i AS (SELECT l_returnflag AS scale, l_discount * 100 AS a, l_tax * 100 AS b, l_quantity AS c FROM lineitem)
SELECT scale, count(*) AS n, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha
FROM i GROUP BY scale""")
def cronbach_alpha(spark, sf):
    items = B.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("scale"), (F.col("l_discount") * 100).alias("a"),
        (F.col("l_tax") * 100).alias("b"), F.col("l_quantity").alias("c"))
    return S.cronbach_alpha(items, "scale", ["a", "b", "c"])


@query("school_cv", f"""WITH {ANSWERS_SQL}
SELECT school, count(field_value) AS n, round(avg(field_value / 1000), 4) AS mean, round(var_samp(field_value / 1000), 2) AS variance,
  round(stddev_samp(field_value / 1000), 4) AS sd, round(stddev_samp(field_value / 1000) / avg(field_value / 1000), 6) AS cv
FROM answers GROUP BY school""")
def school_cv(spark, sf):
    return S.dispersion(answers(spark, sf).withColumn("v", F.col("field_value") / 1000), "school", "v")


@query("subdim_means", """SELECT l_returnflag, round(avg((l_discount + l_tax) / 2), 6) AS price,
  round(avg((l_quantity + l_linenumber) / 2), 6) AS amount FROM lineitem GROUP BY l_returnflag""")
def subdim_means(spark, sf):
    return S.dimension_means(B.table(spark, sf, "lineitem"), ["l_returnflag"],
                             {"price": ["l_discount", "l_tax"], "amount": ["l_quantity", "l_linenumber"]})


@query("year_counts", """WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category, count(*) AS count FROM orders GROUP BY ALL)
SELECT year, category, count, round(count / sum(count) OVER (PARTITION BY year), 6) AS percent FROM c""")
def year_counts(spark, sf):
    return S.yearly_counts(B.table(spark, sf, "orders"), "o_orderdate", "o_orderpriority")


@query("demographic_table", f"""WITH {B.RESPONDENTS_SQL}, l AS (
  SELECT 'school' AS variable, school AS value FROM respondents UNION ALL SELECT 'region', region FROM respondents
  UNION ALL SELECT 'role', role FROM respondents)
SELECT variable, value, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY variable), 6) AS percent
FROM l GROUP BY variable, value""")
def demographic_table(spark, sf):
    return S.demographic_table(B.respondents(spark, sf), ["school", "region", "role"])


WHOLE_DATA = ["compare"]


@query("peer_anonymized", f"""WITH {ANSWERS_SQL},
m AS (SELECT city, alternative, count(*) AS n FROM answers GROUP BY ALL),
lv AS (SELECT unnest({REGIONS!r}) AS city, unnest([1, 2, 3, 4, 5]) AS o),
lab AS (SELECT t.city AS target, u.city, CASE WHEN t.city = u.city THEN u.city
          ELSE chr(65 + CAST(CASE WHEN u.o < t.o THEN u.o ELSE u.o - 1 END AS INTEGER)) END AS label FROM lv t, lv u)
SELECT target, label, 'compare' AS chart_type, alternative, n AS count FROM m JOIN lab USING (city)
UNION ALL SELECT target, label, 'own', alternative, n FROM m JOIN lab USING (city) WHERE city = target""")
def peer_anonymized(spark, sf):
    counts = answers(spark, sf).groupBy("city", "alternative").agg(F.count(F.lit(1)).alias("count"))
    measures = counts.withColumn("chart_type", F.explode(F.array(F.lit("compare"), F.lit("own"))))
    labels = S.anonymized_peers(B.table(spark, sf, "region").select(F.col("r_name").alias("city")), "city", REGIONS)
    return S.peer_report(measures, labels, "city", WHOLE_DATA)
