"""Scale scores driven by an item index.

Long answers (user_id, item, value) are joined to the index (item, dimension,
sub_dimension, algorithm, …) and scored per respondent and dimension.
Algorithm tags: MEAN, SUM, ClassThreshold(t), FigureRate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions.values import parse_number


def unpivot_items(wide: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    typed = wide.select(*keys, *[F.col(i).cast("double").alias(i) for i in items])
    return typed.unpivot(list(keys), list(items), "item", "value")


def dimension_scores(long: DataFrame, index: DataFrame, keys: Sequence[str], level: str = "dimension") -> DataFrame:
    """Mean and sum of the answered items per respondent and dimension."""
    scored = long.join(index.filter(F.col(level).isNotNull()), "item")
    return scored.groupBy(*keys, F.col(level).alias("dimension")).agg(
        F.round(F.avg("value"), 6).alias("mean_score"), F.round(F.sum("value"), 6).alias("sum_score"),
        F.count("value").alias("answered"))


def threshold_of(algorithm):
    return parse_number(F.regexp_extract(algorithm, r"ClassThreshold\(([0-9.]+)\)", 1))


def classes_by_threshold(scores: DataFrame, index: DataFrame, high: str = "达标", low: str = "未达标",
                         level: str = "dimension") -> DataFrame:
    """Class of a mean score at the threshold named in the dimension's algorithm."""
    tagged = index.filter(F.col("algorithm").contains("ClassThreshold")).groupBy(F.col(level).alias("dimension")).agg(
        F.max(threshold_of(F.col("algorithm"))).alias("threshold"))
    return scores.join(tagged, "dimension").withColumn(
        "class", F.when(F.col("mean_score") >= F.col("threshold"), high).when(F.col("mean_score").isNotNull(), low))


def classes_by_choice(long: DataFrame, classes: DataFrame) -> DataFrame:
    """Class named by the chosen option: table (item, value, dimension, class)."""
    return long.join(classes, ["item", "value"])


def figure_of_class(df: DataFrame, attained: Sequence[str]) -> DataFrame:
    return df.withColumn("figure", F.when(F.col("class").isNotNull(), F.col("class").isin(*attained).cast("int")))


def figure_rates(long: DataFrame, index: DataFrame, keys: Sequence[str], level: str = "dimension") -> DataFrame:
    """Share of 1 among the 0/1 items of the dimensions tagged FigureRate."""
    tagged = index.filter(F.col("algorithm").contains("FigureRate"))
    return long.join(tagged, "item").groupBy(*keys, F.col(level).alias("dimension")).agg(
        F.round(F.avg("value"), 6).alias("rate"), F.count("value").alias("answered"))


def threshold_flag(c, limit: float = 3):
    return F.when(c >= limit, 1).when(c < limit, 0)
