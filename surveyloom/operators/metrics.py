"""Metric summary of the long answer-fact table.

Input columns: fact_id, role, subject, school, user_id, norm_id, question_type,
answer_component_label, field_value, raw_value, dimension_name, dimension_title.
An empty string and NULL are the same thing: absent.

Every respondent count is built in two steps, per (group, respondent) and then
per group, so the rows of a hot group are combined on many tasks first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom import fixed_values as V
from surveyloom.functions import ids
from surveyloom.functions.text import blank_to_null, first_filled
from surveyloom.functions.values import answer_value, is_selected, parse_number
from surveyloom.session import cut_lineage

GROUP = ["role", "subject", "norm_id", "school"]
FACT_COLUMNS = [*GROUP, "user_id", "question_type", "answer_component_label", "field_value", "raw_value", "dimension_name", "dimension_title"]
METRIC_COLUMNS = [
    "metric_id", "metric_type", "scope_key_json", "role", "subject", "norm_id", "indicator_id",
    "category", "series", "stack", "count", "denominator", "percent", "mean", "sd", "n",
]


def _prepared(facts: DataFrame) -> DataFrame:
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP]
    user = blank_to_null(F.col("user_id")).alias("user_id")
    others = [c for c in facts.columns if c not in (*GROUP, "user_id")]
    return facts.select(*keys, user, *others)


def _questions(facts: DataFrame) -> DataFrame:
    return _prepared(facts).filter(F.col("norm_id") != "")


def category() -> Column:
    return first_filled(F.col("answer_component_label"), F.col("field_value"), F.col("raw_value"))


def _value() -> Column:
    return answer_value(F.col("field_value"), F.col("raw_value"))


def _per_respondent(facts: DataFrame) -> DataFrame:
    """One row per (group, respondent); a NULL respondent is kept apart."""
    return _questions(facts).groupBy(*GROUP, "user_id").agg(
        F.max(_value() != "").alias("uploaded"),
        F.max(F.col("question_type") == V.UPLOAD_TYPE).alias("is_upload"),
    )


def response_count(facts: DataFrame) -> DataFrame:
    return _per_respondent(facts).groupBy(*GROUP).agg(F.count("user_id").alias("count")).select(
        *GROUP, F.lit("respondents").alias("category"), "count", F.col("count").alias("n")
    )


def option_summary(facts: DataFrame, selected_only: bool = False) -> DataFrame:
    """Respondents per option and their share of the respondents of the group."""
    # Both branches below read the same partial result in full, so Spark shuffles
    # the facts once and reuses that exchange; a filter on the category is kept
    # out of it on purpose.
    per_user = _questions(facts).groupBy(*GROUP, category().alias("category"), "user_id").agg(
        (F.count_if(is_selected(_value())) if selected_only else F.count(F.lit(1))).alias("rows"),
    )
    groups = per_user.groupBy(*GROUP).agg(
        F.count_distinct("user_id").alias("denominator"), F.sum("rows").alias("group_rows")
    )
    counted = F.col("category").isNotNull() & (F.col("rows") > 0)
    counts = per_user.groupBy(*GROUP, "category").agg(
        F.count(F.when(counted, F.col("user_id"))).alias("users"),
        F.sum(F.when(counted, F.col("rows"))).alias("rows"),
    ).filter(F.col("rows") > 0)
    count = F.when(F.col("users") > 0, F.col("users")).otherwise(F.col("rows"))
    return counts.join(groups.filter(F.col("group_rows") > 0), GROUP).select(
        *GROUP, "category", count.alias("count"), "denominator",
        F.round(F.try_divide(count, F.col("denominator")), 6).alias("percent"),
        F.col("denominator").alias("n"),
    )


def numeric_summary(facts: DataFrame) -> DataFrame:
    number = parse_number(_value())
    grouped = _questions(facts).groupBy(*GROUP).agg(
        F.max(F.col("question_type") == V.FILL_TYPE).alias("is_fill"),
        F.round(F.avg(number), 6).alias("mean"),
        F.round(F.stddev_pop(number), 6).alias("sd"),
        F.count(number).alias("n"),
    )
    return grouped.filter("is_fill AND n > 0").select(
        *GROUP, F.lit("numeric").alias("category"), "mean", "sd", "n"
    )


def upload_summary(facts: DataFrame) -> DataFrame:
    grouped = _per_respondent(facts).groupBy(*GROUP).agg(
        F.max("is_upload").alias("is_upload"),
        F.count("user_id").alias("denominator"),
        F.count(F.when(F.col("uploaded"), F.col("user_id"))).alias("count"),
    )
    return grouped.filter("is_upload").select(
        *GROUP, F.lit("uploaded").alias("category"), "count", "denominator",
        F.round(F.try_divide("count", "denominator"), 6).alias("percent"),
        F.col("denominator").alias("n"),
    )


def matrix_summary(facts: DataFrame, types: Sequence[str] = (*V.MATRIX_TYPES, V.PARSED_GRID_TYPE)) -> DataFrame:
    """Rows and respondents per grid cell; grid questions read from a form carry
    a third type name, which ``types=MATRIX_TYPES`` leaves out."""
    cell = [
        F.coalesce(first_filled(F.col("dimension_name"), F.col("dimension_title")), F.lit("")).alias("category"),
        F.coalesce(F.col("answer_component_label"), F.lit("")).alias("series"),
    ]
    per_user = (
        _prepared(facts).filter(F.col("question_type").isin(*types))
        .groupBy(*GROUP, *cell, "user_id").agg(F.count(F.lit(1)).alias("rows"))
    )
    return per_user.groupBy(*GROUP, "category", "series").agg(
        F.sum("rows").alias("count"), F.count("user_id").alias("n")
    )


def indicator_values(indicators: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return indicators.select(
        text("role"), text("subject"), F.lit("").alias("norm_id"), text("school"), text("indicator_id"),
        F.coalesce(F.col("indicator_name"), F.lit("")).alias("category"),
        F.col("indicator_value").alias("mean"), F.lit(1).cast("bigint").alias("n"),
    )


def as_metrics(rows: DataFrame, metric_type: str) -> DataFrame:
    """Common metric columns; measures a branch does not have are NULL."""
    have = set(rows.columns)
    text = lambda c: (F.col(c) if c in have else F.lit("")).alias(c)
    number = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    shaped = rows.select(
        F.lit(metric_type).alias("metric_type"),
        ids.scope_json("school", F.col("school")).alias("scope_key_json"),
        "school", "role", "subject", "norm_id",
        text("indicator_id"), text("category"), text("series"), text("stack"),
        number("count", "bigint"), number("denominator", "bigint"), number("percent", "double"),
        number("mean", "double"), number("sd", "double"), number("n", "bigint"),
    )
    hashed = ids.metric_id(*[F.col(c) for c in (
        "metric_type", "scope_key_json", "norm_id", "indicator_id", "category", "series", "stack")])
    return shaped.withColumn("metric_id", hashed)


def metrics_summary(facts: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """All metric branches in one table. ``(metric_id, role, subject)`` is the
    key: the id alone leaves out role and subject. The facts are stored once in the
    columns that the branches read, so whatever makes them runs once, not per branch."""
    facts = cut_lineage(facts.select(*FACT_COLUMNS))
    parts = [
        as_metrics(response_count(facts), "response_count"),
        as_metrics(option_summary(facts), "option_summary"),
        as_metrics(numeric_summary(facts), "numeric_summary"),
        as_metrics(upload_summary(facts), "upload_summary"),
        as_metrics(matrix_summary(facts), "matrix_summary"),
    ]
    if indicators is not None:
        parts.append(as_metrics(indicator_values(indicators), "indicator_value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def sources_of(rows: DataFrame, keys: Sequence[str], id_column: str, order: str) -> DataFrame:
    """Provenance as a long table: each source id once per key, with the place
    of its first appearance. Sorting by ``first_seen`` gives the audit list; a
    hot group is never folded into one array."""
    return rows.filter(F.coalesce(F.col(id_column), F.lit("")) != "").groupBy(*keys, id_column).agg(
        F.min(order).alias("first_seen")
    )


def fact_sources(facts: DataFrame, order: str = "ord") -> DataFrame:
    """Provenance of the option metrics, per category."""
    rows = _questions(facts).withColumn("category", category()).filter(F.col("category").isNotNull())
    return sources_of(rows, [*GROUP, "category"], "fact_id", order)
