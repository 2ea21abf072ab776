"""Cross-tabs, shares and means by unit.

Input rows: city, school, subject, grade, user_id, item_no, alternative,
field_name, field_value. Units and options come as explicit ordered lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.sources.local import small_table

ALL = "自治区"
OTHER_PATTERN = r"其他，.*|其它，.*"


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part, whole), digits)


def levels(df: DataFrame, values: Sequence[str], column: str) -> DataFrame:
    """Ordered level table (column, ordinal)."""
    return small_table(df.sparkSession, [(v, i + 1) for i, v in enumerate(values)], f"{column} string, ordinal int")


def level_grid(df: DataFrame, units: Sequence[str], options: Sequence[str]) -> DataFrame:
    """Every (unit, alternative) cell of two explicit lists."""
    cells = [(u, o) for u in units for o in options]
    return small_table(df.sparkSession, cells, "unit string, alternative string")


def level_rows(df: DataFrame, level: str, name: str | None = None) -> tuple[DataFrame, str]:
    """Rows and grouping column of an administrative level: the whole province by
    city, or one city by school."""
    return (df, "city") if level == "province" else (df.filter(F.col("city") == name), "school")


def lower_units(df: DataFrame, level: str, name: str | None = None) -> DataFrame:
    rows, unit = level_rows(df, level, name)
    return rows.select(F.col(unit).alias("unit")).distinct().orderBy(F.desc("unit"))


def value_shares(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts and shares in the given order, absent values as 0, and a total row."""
    counts = df.filter(F.col(column).isin(*order)).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    zero = F.lit(0).cast("bigint")
    total = F.coalesce(counts.agg(F.sum("count")).scalar(), zero)
    rows = levels(df, order, column).join(counts, column, "left").withColumn("count", F.coalesce("count", zero))
    listed = rows.select(
        "ordinal", F.col(column).alias("category"), "count",
        F.coalesce(share(F.col("count"), total), F.lit(0.0)).alias("percent"))
    sums = small_table(df.sparkSession, [(len(order) + 1, "总计")], "ordinal int, category string").select(
        "ordinal", "category", total.alias("count"), F.when(total > 0, 1.0).otherwise(0.0).alias("percent"))
    return listed.unionByName(sums)


def share_of_schools(df: DataFrame, column: str = "alternative", order: Sequence[str] = ()) -> DataFrame:
    """Rows per option divided by the number of distinct schools that answered."""
    answered = df.filter(F.col(column).isNotNull())
    counts = answered.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    if order:
        counts = levels(df, order, "category").join(counts, "category", "left").select(
            "category", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
    schools = answered.agg(F.count_distinct("school")).scalar()
    return counts.select("category", "count", schools.alias("schools"), share(F.col("count"), schools).alias("percent"))


def merged_alternative(c: Column) -> Column:
    return F.regexp_replace(c, OTHER_PATTERN, "其他")


def column_shares(df: DataFrame, unit: str, units: Sequence[str], options: Sequence[str],
                  city: str | None = None) -> DataFrame:
    """Share of every option within all rows, within one city if named and within
    every unit. One pass: each row counts for the reference columns it belongs to."""
    places = [F.lit(ALL), F.when(F.col(unit).isin(*units), F.col(unit))]
    if city is not None:
        places.insert(1, F.when(F.col("city") == city, F.lit(city)))
    counted = df.withColumn("alternative", merged_alternative(F.col("alternative"))).select(
        "alternative", F.explode(F.array_compact(F.array_distinct(F.array(*places)))).alias("unit"))
    counts = counted.groupBy("unit", "alternative").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("unit").agg(F.sum("count").alias("total"))
    names = [ALL] + ([city] if city is not None else []) + [u for u in units if u != city]
    grid = level_grid(df, names, options)
    return grid.join(counts, ["unit", "alternative"], "left").join(totals, "unit", "left").select(
        "unit", "alternative", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        F.coalesce(share(F.col("count"), F.col("total")), F.lit(0.0)).alias("percent"))


RESPONDENT_KEYS = {
    "学校": lambda col: ["school"],
    "教研组": lambda col: ["school", col, "subject"],
    "教师": lambda col: ["school", col, "subject", "user_id"],
    "学生": lambda col: ["school", col, "subject", "grade", "user_id"],
}


def respondent_keys(kind: str, column: str) -> list[str]:
    """What makes one respondent of a kind, for tables by ``column``."""
    return list(dict.fromkeys(RESPONDENT_KEYS[kind](column)))


def unit_rates(df: DataFrame, kind: str, unit: str, units: Sequence[str], options: Sequence[str]) -> DataFrame:
    """Rows per (unit, option) over the distinct respondents of the unit, with the
    overall rate as unit ``ALL``; the grid is zero-filled. Units are counted once
    per respondent key, and the raw row count is kept beside the denominator."""
    keys = respondent_keys(kind, unit)
    people = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    owner = people if unit in keys else df.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("rows"))
    bases = owner.groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("denominator"), F.sum("rows").alias("rows"))
    base_all = people.agg(F.lit(ALL).alias("unit"), F.count(F.lit(1)).alias("denominator"), F.sum("rows").alias("rows"))
    counts = df.groupBy(F.col(unit).alias("unit"), "alternative").agg(F.count(F.lit(1)).alias("count"))
    count_all = counts.groupBy("alternative").agg(F.sum("count").alias("count")).withColumn("unit", F.lit(ALL))
    grid = level_grid(df, [ALL, *units], options)
    return (
        grid.join(bases.unionByName(base_all), "unit", "left")
        .join(counts.unionByName(count_all), ["unit", "alternative"], "left")
        .select("unit", "alternative", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "denominator", "rows",
                F.coalesce(share(F.col("count"), F.col("denominator")), F.lit(0.0)).alias("rate"))
    )


def unit_option_matrix(df: DataFrame, kind: str, unit: str, units: Sequence[str], options: Sequence[str]) -> DataFrame:
    """The rates of ``unit_rates`` as a matrix; cells nobody chose stay NULL."""
    keys = respondent_keys(kind, unit)
    bases = df.groupBy(*dict.fromkeys([*keys, unit])).agg(F.first("item_no").alias("_")).groupBy(unit).agg(
        F.count(F.lit(1)).alias("denominator"))
    cells = df.groupBy(unit).pivot("alternative", list(options)).agg(F.count(F.lit(1)))
    return (levels(df, units, unit).join(cells, unit, "left").join(bases, unit, "left").select(
        F.col(unit).alias("unit"), "ordinal", *[share(F.col(f"`{o}`"), F.col("denominator")).alias(o) for o in options]))


def target_ratios(df: DataFrame, target: str, unit: str, units: Sequence[str], overall: str = ALL) -> DataFrame:
    """Per subject the share of rows with the target option, overall and by unit."""
    hit = F.when(F.col("alternative") == target, 1.0).otherwise(0.0)
    cells = [F.round(F.avg(F.when(F.col(unit) == u, hit)), 6).alias(u) for u in units]
    none = lambda a: F.nullif(a, F.lit(0.0))  # noqa: E731 - a subject or unit nobody chose it in has no cell
    return df.groupBy("subject").agg(F.round(F.avg(hit), 6).alias(overall), *cells).select(
        "subject", *[none(F.col(f"`{c}`")).alias(c) for c in (overall, *units)])


def unit_means(df: DataFrame, column: str, unit: str, units: Sequence[str], city: str | None = None) -> DataFrame:
    """Mean per unit beside the mean of all rows and of one city."""
    overall = df.agg(F.round(F.avg(column), 6)).scalar()
    city_mean = df.agg(F.round(F.avg(F.when(F.col("city") == city, F.col(column))), 6)).scalar()
    means = df.groupBy(F.col(unit).alias("unit")).agg(F.round(F.avg(column), 6).alias("mean"))
    return levels(df, units, "unit").join(means, "unit", "left").select(
        "unit", "ordinal", "mean", overall.alias("overall_mean"), city_mean.alias("city_mean"))


def field_unit_means(df: DataFrame, fields: Sequence[str], unit: str, units: Sequence[str], city: str | None = None) -> DataFrame:
    """Per field the overall mean, the city mean and the mean of every unit."""
    mean = lambda when: F.round(F.avg(F.when(when, F.col("field_value"))), 6)
    aggs = [F.round(F.avg("field_value"), 6).alias(ALL)]
    if city is not None:
        aggs.append(mean(F.col("city") == city).alias(city))
    aggs += [mean(F.col(unit) == u).alias(u) for u in units if u != city]
    return df.filter(F.col("field_name").isin(*fields)).groupBy("field_name").agg(*aggs)


def row_shares(df: DataFrame, keys: Sequence[str], options: Sequence[str]) -> DataFrame:
    """Options as shares of the row sum, absent cells as 0."""
    cells = df.groupBy(*keys).pivot("alternative", list(options)).agg(F.count(F.lit(1)))
    filled = [F.coalesce(F.col(f"`{o}`"), F.lit(0).cast("bigint")) for o in options]
    total = filled[0]
    for c in filled[1:]:
        total = total + c
    return cells.select(*keys, *[share(c, total).alias(o) for c, o in zip(filled, options)])


def grade_means(df: DataFrame, word: str, unit: str, grades: Sequence[str]) -> DataFrame:
    """Mean per unit and grade of the fields whose name contains ``word``. The
    values become shares of their school's total per grade first, then the mean
    of these is taken."""
    rows = df.filter(F.col("field_name").contains(word))
    by = list(dict.fromkeys(["school", "grade", unit, "subject"]))
    school = rows.groupBy(*by).agg(F.sum("field_value").alias("part"))
    total = school.groupBy("school", "grade").agg(F.sum("part").alias("whole"))
    ratios = school.join(total, ["school", "grade"]).withColumn("ratio", F.try_divide("part", "whole"))
    return ratios.groupBy(F.col(unit).alias("unit")).agg(
        *[F.round(F.avg(F.when(F.col("grade") == g, F.col("ratio"))), 6).alias(g) for g in grades])


def grade_value_means(df: DataFrame, unit: str, grades: Sequence[str]) -> DataFrame:
    return df.groupBy(F.col(unit).alias("unit")).agg(
        *[F.round(F.avg(F.when(F.col("grade") == g, F.col("field_value"))), 6).alias(g) for g in grades])


def sample_notes(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Distinct schools per group, as rows and as one sentence in list order."""
    counts = df.filter(F.col(group).isin(*order)).groupBy(group).agg(F.count_distinct("school").alias("schools"))
    # at most one entry per listed group, so the sentence stays short
    listed = levels(df, order, group).join(counts, group)
    text = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", group, "schools"))),
                       lambda s: F.concat(s[group], F.lit("学校"), s["schools"].cast("string"), F.lit("所")))
    return listed.agg(F.concat(F.array_join(text, "，"), F.lit("。")).alias("note"),
                      F.max("schools").alias("max_schools"))


def category_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("category", "count", share(F.col("count"), total).alias("percent"))


def user_cross_tab(facts: DataFrame, row_norm: str, column_norm: str, columns: Sequence[str]) -> DataFrame:
    """Respondents by their answers to two questions. Each side is reduced to
    distinct (respondent, answer) pairs before the join on the respondent."""
    side = lambda norm, name: facts.filter(F.col("norm_id") == norm).groupBy(
        "user_id", F.col("answer").alias(name)).agg(F.count(F.lit(1)).alias(f"_{name}")).drop(f"_{name}")
    pairs = side(row_norm, "row_answer").join(side(column_norm, "column_answer"), "user_id")
    return pairs.groupBy("row_answer").agg(*[
        F.count_if(F.col("column_answer") == c).alias(c) for c in columns])
