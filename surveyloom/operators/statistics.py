"""Textbook statistics behind the report's chart names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from surveyloom.operators.crosstab import share


QUANTILE_SLICES = 100


def exact_quantiles(folded: DataFrame, group: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of (group, value, n) rows, n the frequency, as
    ``group, n_values, q ARRAY``. A group is cut into slices at approximate
    quantiles; slice totals tell which slices hold the wanted ranks, and only the
    values of those few are put in order."""
    points = F.array(*[F.lit((i + 1) / QUANTILE_SLICES) for i in range(QUANTILE_SLICES - 1)])
    cuts = folded.groupBy(group).agg(F.percentile_approx("value", points, F.lit(QUANTILE_SLICES * 20)).alias("cuts"))
    sliced = folded.join(cuts, group).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    before = W.partitionBy(group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    totals = sliced.groupBy(group, "slice").agg(F.sum("n").alias("size"))
    starts = totals.withColumns({
        "start": F.coalesce(F.sum("size").over(before), F.lit(0)), "n_values": F.sum("size").over(W.partitionBy(group))})
    place = [(F.col("n_values") - 1) * F.lit(p) for p in probabilities]
    ranks = F.array(*[f(x).cast("bigint") for x in place for f in (F.floor, F.ceil)])
    wanted = starts.withColumn("ranks", F.array_distinct(F.filter(
        ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("size"))))).filter(F.size("ranks") > 0)
    inside = W.partitionBy(group, "slice").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    ordered = sliced.join(wanted, [group, "slice"]).withColumn(
        "first_rank", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    hits = ordered.withColumn("rank", F.explode("ranks")).filter(
        (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    # at most two ranks per probability and group
    values = hits.groupBy(group).agg(
        F.max("n_values").alias("n_values"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    def quantile(x):
        low, high = F.element_at("at", F.floor(x).cast("bigint")), F.element_at("at", F.ceil(x).cast("bigint"))
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)
    return values.select(group, "n_values", F.array(*[quantile(x) for x in place]).alias("q"))


def box_summary(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers per group. Equal values are folded into
    (value, frequency) rows first."""
    folded = df.filter(F.col(column).isNotNull()).groupBy(group, F.col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    quartiles = exact_quantiles(folded, group, (0.25, 0.5, 0.75))
    spread = 1.5 * (F.col("q")[2] - F.col("q")[0])
    low, high = F.col("q")[0] - spread, F.col("q")[2] + spread
    inside = F.col("value").between(low, high)
    return folded.join(quartiles, group).groupBy(group, "q", "n_values").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
    ).select(
        F.col(group).alias("unit"), F.col("n_values").alias("n"), "whisker_low",
        *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("q1", "median", "q3"))], "whisker_high")


def mark_outliers(df: DataFrame, column: str, limit: float = 2.0) -> DataFrame:
    """Flags |z| > limit with the population deviation; the two moments are
    scalar subqueries, merged by Spark into one aggregate."""
    mean, sd = df.agg(F.avg(column)).scalar(), df.agg(F.stddev_pop(column)).scalar()
    z = F.abs(F.try_divide(F.col(column) - mean, sd))
    return df.withColumn("outlier", F.when(z > limit, F.lit("异常值")))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations from one aggregate, as (a, b, corr) rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"c{i}"), 6).alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return cells.select(F.inline(rows))


def linear_fit(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"),
        F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"))


def anova(df: DataFrame, group: str, column: str) -> DataFrame:
    """One-way analysis of variance: F and η² from per-group moments."""
    groups = df.filter(F.col(column).isNotNull()).groupBy(group).agg(
        F.count(column).alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v"))
    grand = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    sums = groups.withColumn("grand", grand).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"))
    df_between, df_within = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide("between", df_between), F.try_divide("within", df_within))
    return sums.select(
        "groups", "n", df_between.alias("df_between"), df_within.alias("df_within"),
        F.round(f, 6).alias("f_value"),
        F.round(F.try_divide(F.col("between"), F.col("between") + F.col("within")), 8).alias("eta_squared"))


def cronbach_alpha(df: DataFrame, scale: str, items: Sequence[str]) -> DataFrame:
    """Per scale k/(k-1)·(1 − Σ item variances / variance of the sum), over rows
    with all items present."""
    k = len(items)
    total = F.col(items[0])
    for item in items[1:]:
        total = total + F.col(item)
    complete = df.dropna(subset=list(items)).withColumn("_total", total)
    moments = complete.groupBy(scale).agg(
        *[F.var_samp(i).alias(f"_v{n}") for n, i in enumerate(items)], F.var_samp("_total").alias("_vt"),
        F.count(F.lit(1)).alias("n"))
    parts = F.col("_v0")
    for n in range(1, k):
        parts = parts + F.col(f"_v{n}")
    return moments.select(scale, "n", F.round((k / (k - 1)) * (1 - F.try_divide(parts, F.col("_vt"))), 6).alias("alpha"))


def dispersion(df: DataFrame, group: str, column: str) -> DataFrame:
    """Variance, deviation and coefficient of variation per group."""
    return df.groupBy(group).agg(
        F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"),
        F.round(F.var_samp(column), 2).alias("variance"), F.round(F.stddev_samp(column), 4).alias("sd"),
        F.round(F.try_divide(F.stddev_samp(column), F.avg(column)), 6).alias("cv"))


def dimension_means(df: DataFrame, keys: Sequence[str], dimensions: dict[str, Sequence[str]]) -> DataFrame:
    """Per group the mean of every dimension, a dimension being the mean of its
    filled items in a row."""
    def row_mean(items):
        filled = F.array_compact(F.array(*[F.col(i).cast("double") for i in items]))
        return F.try_divide(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x), F.size(filled))
    return df.groupBy(*keys).agg(*[F.round(F.avg(row_mean(items)), 6).alias(d) for d, items in dimensions.items()])


def yearly_counts(df: DataFrame, date: str, category: str) -> DataFrame:
    by_year = df.groupBy(F.year(date).alias("year"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    totals = by_year.groupBy("year").agg(F.sum("count").alias("total"))
    return by_year.join(totals, "year").select("year", "category", "count", share(F.col("count"), F.col("total")).alias("percent"))


def demographic_table(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Counts and shares of every value of every demographic variable."""
    long = df.select(*[F.col(v).cast("string").alias(v) for v in variables]).unpivot([], list(variables), "variable", "value")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("variable").agg(F.sum("count").alias("total"))
    return counts.join(totals, "variable").select(
        "variable", "value", "count", share(F.col("count"), F.col("total")).alias("percent"))


def anonymized_peers(units: DataFrame, unit: str, names: Sequence[str]) -> DataFrame:
    """For every target unit the label of each unit: the target keeps its name, the
    others become B, C, D… in the order of ``names``, the level list."""
    order = F.array(*[F.lit(n) for n in names])
    listed = units.filter(F.col(unit).isin(*names)).withColumn("_place", F.array_position(order, F.col(unit)))
    offered = listed.select(unit, "_place", F.posexplode(order).alias("_target_place", "target"))
    code = F.when(F.col("_place") < F.col("_target_place") + 1, F.col("_place")).otherwise(F.col("_place") - 1)
    letters = F.when(code <= 25, F.chr(65 + code)).otherwise(F.concat(F.lit("B"), code.cast("string")))
    return offered.select(
        "target", unit, F.when(F.col(unit) == F.col("target"), F.col(unit)).otherwise(letters).alias("label"))


def peer_report(measures: DataFrame, labels: DataFrame, unit: str, whole_data_charts: Sequence[str]) -> DataFrame:
    """Every target's own copy of a unit table under anonymous labels. Charts that
    compare units get all units, the others the target's rows alone."""
    joined = measures.join(labels, unit)
    keep = F.col("chart_type").isin(*whole_data_charts) | (F.col(unit) == F.col("target"))
    return joined.filter(keep).drop(unit)
