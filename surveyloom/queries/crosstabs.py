"""Cross-tab queries over the pandas-style long answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import crosstab as X
from surveyloom.queries import query
from surveyloom.queries import bindings as B

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GRADES = ["F", "O", "P"]


def answers(spark, sf):
    """Long answers: city = region, school = nation, subject = segment."""
    o = B.table(spark, sf, "orders").join(B.respondents(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("region").alias("city"), "school", F.col("role").alias("subject"), F.col("o_orderstatus").alias("grade"),
        "user_id", F.lit("1").alias("item_no"), F.col("o_orderpriority").alias("alternative"),
        F.col("o_orderpriority").alias("field_name"), F.col("o_totalprice").alias("field_value"),
        F.col("o_orderkey"), F.col("o_orderdate"))


ANSWERS_SQL = B.RESPONDENTS_SQL + """, answers AS (
  SELECT region AS city, school, role AS subject, o_orderstatus AS grade, user_id, '1' AS item_no,
         o_orderpriority AS alternative, o_orderpriority AS field_name, o_totalprice AS field_value, o_orderkey, o_orderdate
  FROM orders JOIN respondents ON o_custkey = c_custkey)"""


def twice_rounded_sql(mean, digits):
    """A mean rounded to six decimals and then to fewer, as the query does."""
    return f"CAST(round(CAST({mean} AS DECIMAL(28, 6)), {digits}) AS DOUBLE)"


def values_sql(items, name):
    return f"(SELECT unnest([{', '.join(repr(i) for i in items)}]) AS {name})"


@query("level_scope", f"""WITH {ANSWERS_SQL}
SELECT 'province' AS level, city AS unit, count(*) AS rows FROM answers GROUP BY ALL
UNION ALL SELECT 'city', school, count(*) FROM answers WHERE city = 'ASIA' GROUP BY ALL""")
def level_scope(spark, sf):
    parts = []
    for level, name in (("province", None), ("city", "ASIA")):
        rows, unit = X.level_rows(answers(spark, sf), level, name)
        counted = rows.groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(X.lower_units(answers(spark, sf), level, name).join(counted, "unit").select(
            F.lit(level).alias("level"), "unit", "rows"))
    return parts[0].unionByName(parts[1])


ORDER_SHOWN = ["5-LOW", "1-URGENT", "9-MISSING", "3-MEDIUM"]


@query("value_share_total", f"""WITH {ANSWERS_SQL}, c AS (
  SELECT alternative, count(*) AS n FROM answers WHERE alternative IN ('5-LOW', '1-URGENT', '3-MEDIUM') GROUP BY ALL)
SELECT l.ordinal::INTEGER AS ordinal, l.alternative AS category, coalesce(n, 0) AS count,
       round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS percent
FROM (SELECT unnest([1, 2, 3, 4]) AS ordinal, unnest(['5-LOW', '1-URGENT', '9-MISSING', '3-MEDIUM']) AS alternative) l
LEFT JOIN c USING (alternative)
UNION ALL SELECT 5, '总计', (SELECT CAST(sum(n) AS BIGINT) FROM c), 1.0""")
def value_share_total(spark, sf):
    return X.value_shares(answers(spark, sf), "alternative", ORDER_SHOWN)


@query("share_of_schools", f"""WITH {ANSWERS_SQL}
SELECT alternative AS category, count(*) AS count, (SELECT count(DISTINCT school) FROM answers WHERE alternative <> '5-LOW') AS schools,
  round(count(*) / (SELECT count(DISTINCT school) FROM answers WHERE alternative <> '5-LOW'), 6) AS percent
FROM answers WHERE alternative <> '5-LOW' GROUP BY alternative""")
def share_of_schools(spark, sf):
    return X.share_of_schools(answers(spark, sf).withColumn(
        "alternative", F.nullif(F.col("alternative"), F.lit("5-LOW"))))


@query("crosstab_column_pct", f"""WITH {ANSWERS_SQL}, placed AS (
  SELECT alternative, '自治区' AS unit FROM answers UNION ALL SELECT alternative, city FROM answers WHERE city = 'ASIA'
  UNION ALL SELECT alternative, subject FROM answers),
c AS (SELECT unit, alternative, count(*) AS n FROM placed GROUP BY ALL),
t AS (SELECT unit, sum(n) AS t FROM c GROUP BY ALL)
SELECT unit, alternative, n AS count, round(n / t, 6) AS percent FROM c JOIN t USING (unit)""")
def crosstab_column_pct(spark, sf):
    return X.column_shares(answers(spark, sf), "subject", SEGMENTS, PRIORITIES, city="ASIA")


@query("option_rate_dedup", f"""WITH {ANSWERS_SQL},
b AS (SELECT city AS unit, count(DISTINCT (school, city, subject, grade, user_id)) AS denominator, count(*) AS rows FROM answers GROUP BY city
      UNION ALL SELECT '自治区', count(DISTINCT (school, city, subject, grade, user_id)), count(*) FROM answers),
c AS (SELECT city AS unit, alternative, count(*) AS n FROM answers GROUP BY ALL
      UNION ALL SELECT '自治区', alternative, count(*) FROM answers GROUP BY ALL)
SELECT unit, alternative, coalesce(n, 0) AS count, denominator, rows, round(coalesce(n, 0) / denominator, 6) AS rate
FROM b CROSS JOIN {values_sql(PRIORITIES, 'alternative')} LEFT JOIN c USING (unit, alternative)""")
def option_rate_dedup(spark, sf):
    rates = X.unit_rates(answers(spark, sf), "学生", "city", REGIONS, PRIORITIES)
    return rates.withColumn("rows", F.col("rows").cast("bigint"))


@query("option_rate_schools", f"""WITH {ANSWERS_SQL},
b AS (SELECT subject AS unit, count(DISTINCT school) AS denominator FROM answers GROUP BY subject),
c AS (SELECT subject AS unit, alternative, count(*) AS n FROM answers GROUP BY ALL)
SELECT unit, alternative, n AS count, denominator, round(n / denominator, 6) AS rate FROM b JOIN c USING (unit)
UNION ALL
SELECT '自治区', alternative, count(*), (SELECT count(DISTINCT school) FROM answers),
       round(count(*) / (SELECT count(DISTINCT school) FROM answers), 6) FROM answers GROUP BY alternative""")
def option_rate_schools(spark, sf):
    return X.unit_rates(answers(spark, sf), "学校", "subject", SEGMENTS, PRIORITIES).drop("rows")


def _pivot_sql(expr):
    return ", ".join(f'round({expr.format(v=v)}, 6) AS "{v}"' for v in PRIORITIES)


@query("unit_option_heatmap", f"""WITH {ANSWERS_SQL}
SELECT subject AS unit, list_position({SEGMENTS!r}, subject)::INTEGER AS ordinal,
  {_pivot_sql("nullif(count(CASE WHEN alternative = '{v}' THEN 1 END), 0) / count(DISTINCT (school, subject, user_id))")}
FROM answers GROUP BY subject""")
def unit_option_heatmap(spark, sf):
    return X.unit_option_matrix(answers(spark, sf), "教师", "subject", SEGMENTS, PRIORITIES)


@query("target_ratio_matrix", f"""WITH {ANSWERS_SQL}
SELECT subject, nullif(round(avg(CASE WHEN alternative = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6), 0) AS "自治区",
  {", ".join(f'''nullif(round(avg(CASE WHEN city = '{c}' THEN CASE WHEN alternative = '1-URGENT' THEN 1.0 ELSE 0.0 END END), 6), 0) AS "{c}"''' for c in REGIONS)}
FROM answers GROUP BY subject""")
def target_ratio_matrix(spark, sf):
    return X.target_ratios(answers(spark, sf), "1-URGENT", "city", REGIONS)


@query("mean_vs_overall", f"""WITH {ANSWERS_SQL}
SELECT subject AS unit, list_position({SEGMENTS!r}, subject)::INTEGER AS ordinal, {twice_rounded_sql('avg(field_value / 1000)', 4)} AS mean,
  (SELECT {twice_rounded_sql('avg(field_value / 1000)', 4)} FROM answers) AS overall_mean,
  (SELECT {twice_rounded_sql('avg(field_value / 1000)', 4)} FROM answers WHERE city = 'ASIA') AS city_mean
FROM answers GROUP BY subject""")
def mean_vs_overall(spark, sf):
    df = answers(spark, sf).withColumn("thousands", F.col("field_value") / 1000)
    means = X.unit_means(df, "thousands", "subject", SEGMENTS, city="ASIA")
    return means.withColumns({c: F.round(c, 4) for c in ("mean", "overall_mean", "city_mean")})


@query("field_unit_mean", f"""WITH {ANSWERS_SQL}
SELECT field_name, {twice_rounded_sql('avg(field_value)', 2)} AS "自治区",
  {", ".join(twice_rounded_sql(f"avg(CASE WHEN city = '{c}' THEN field_value END)", 2) + f' AS "{c}"' for c in REGIONS)}
FROM answers GROUP BY field_name""")
def field_unit_mean(spark, sf):
    wide = X.field_unit_means(answers(spark, sf), PRIORITIES, "city", REGIONS)
    return wide.withColumns({c: F.round(F.col(f"`{c}`"), 2) for c in (X.ALL, *REGIONS)})


@query("grade_mean_matrix", f"""WITH {ANSWERS_SQL},
s AS (SELECT school, grade, subject, sum(field_value) AS part FROM answers WHERE contains(field_name, 'O') GROUP BY ALL),
r AS (SELECT *, part / sum(part) OVER (PARTITION BY school, grade) AS ratio FROM s)
SELECT subject AS unit, {", ".join(f'''round(avg(CASE WHEN grade = '{g}' THEN ratio END), 6) AS "{g}"''' for g in GRADES)}
FROM r GROUP BY subject""")
def grade_mean_matrix(spark, sf):
    return X.grade_means(answers(spark, sf), "O", "subject", GRADES)


@query("grade_value_mean", f"""WITH {ANSWERS_SQL}
SELECT city AS unit, {", ".join(twice_rounded_sql(f"avg(CASE WHEN grade = '{g}' THEN field_value END)", 2) + f' AS "{g}"' for g in GRADES)}
FROM answers GROUP BY city""")
def grade_value_mean(spark, sf):
    wide = X.grade_value_means(answers(spark, sf), "city", GRADES)
    return wide.withColumns({g: F.round(g, 2) for g in GRADES})


@query("sample_size_notes", f"""WITH {ANSWERS_SQL}, c AS (
  SELECT subject, count(DISTINCT school) AS n FROM answers GROUP BY subject)
SELECT string_agg(subject || '学校' || n || '所', '，' ORDER BY subject) || '。' AS note, max(n) AS max_schools FROM c""")
def sample_size_notes(spark, sf):
    return X.sample_notes(answers(spark, sf), "subject", SEGMENTS)


@query("category_share", f"""WITH {ANSWERS_SQL}
SELECT alternative AS category, count(*) AS count, round(count(*) / (SELECT count(*) FROM answers), 6) AS percent
FROM answers GROUP BY alternative""")
def category_share(spark, sf):
    return X.category_shares(answers(spark, sf), "alternative")


@query("enrich_row_pct", """WITH j AS (
  SELECT p_brand, p_type, l_returnflag AS alternative FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
c AS (SELECT p_brand, p_type, count(CASE WHEN alternative = 'A' THEN 1 END) AS a, count(CASE WHEN alternative = 'N' THEN 1 END) AS n,
        count(CASE WHEN alternative = 'R' THEN 1 END) AS r FROM j GROUP BY ALL)
SELECT p_brand AS subject, p_type AS textbook, round(a / (a + n + r), 6) AS "A", round(n / (a + n + r), 6) AS "N",
       round(r / (a + n + r), 6) AS "R" FROM c""")
def enrich_row_pct(spark, sf):
    lines = B.table(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("alternative"))
    base = B.table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("subject"), F.col("p_type").alias("textbook"))
    return X.row_shares(lines.join(base, "l_partkey", "left"), ["subject", "textbook"], ["A", "N", "R"])


@query("user_cross_tab", f"""WITH r AS (SELECT DISTINCT o_custkey AS u, o_orderpriority AS a FROM orders),
c AS (SELECT DISTINCT user_id AS u, event_type AS e FROM events)
SELECT a AS row_answer, {", ".join(f"count(CASE WHEN e = '{t}' THEN 1 END) AS {t}" for t in ('click', 'error', 'purchase', 'signup', 'view'))}
FROM r JOIN c USING (u) GROUP BY a""")
def user_cross_tab(spark, sf):
    o = B.table(spark, sf, "orders").select(
        F.lit("Q1").alias("norm_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("answer"))
    e = B.table(spark, sf, "events").select(F.lit("Q2").alias("norm_id"), "user_id", F.col("event_type").alias("answer"))
    return X.user_cross_tab(o.unionByName(e), "Q1", "Q2", ["click", "error", "purchase", "signup", "view"])
