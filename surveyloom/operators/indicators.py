"""Indicators rebuilt from a rule table.

A rule names source questions (or ``*``), optional component, field and
dimension, the grouping columns and a transform. All rules run in one plan:
they are joined to the facts once and grouped by (rule, key array).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions import ids
from surveyloom.functions.text import blank_to_null
from surveyloom.functions.values import answer_value, is_selected

ATTRIBUTES = ["school", "role", "subject", "grade", "semester"]
RULE_ARRAYS = ["source_norm_ids_json", "group_by_json"]
RULE_OBJECTS = ["value_mapping_json", "formula_json"]


def parse_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rules, and one check row per malformed JSON field of a rule."""
    def parsed(name: str, schema: str) -> Column:
        text = F.coalesce(blank_to_null(F.col(name)), F.lit("[]" if schema.startswith("array") else "{}"))
        return F.from_json(text, schema)

    have = set(rules.columns)
    arrays = [c for c in RULE_ARRAYS if c in have]
    objects = [c for c in RULE_OBJECTS if c in have]
    bad = [F.when(_not_json(F.col(c), "["), F.lit(c)) for c in arrays]
    bad += [F.when(_not_json(F.col(c), "{"), F.lit(c)) for c in objects]
    checked = rules.withColumn("_bad", F.array_compact(F.array(*bad)))
    issues = checked.select("rule_id", F.explode("_bad").alias("field")).select(
        F.lit("error").alias("severity"), F.lit("malformed_rule_json").alias("check_type"),
        F.col("rule_id").alias("key"),
        F.concat(F.col("field"), F.lit(" must be valid JSON of the expected shape")).alias("message"),
    )
    typed = checked.filter(F.size("_bad") == 0).select(
        "rule_id", "transform_type",
        *[c for c in ("target_indicator_id", "target_indicator_name", "output_grain", "output_value_type",
                      "answer_component_id", "field_id", "dimension_id") if c in have],
        parsed("source_norm_ids_json", "array<string>").alias("source_norm_ids"),
        parsed("group_by_json", "array<string>").alias("group_by"),
        parsed("value_mapping_json", "map<string,double>").alias("value_mapping"),
    )
    return typed, issues


def _not_json(c: Column, opening: str) -> Column:
    """The text is filled but is no JSON of the shape that opens this way."""
    text = F.trim(F.coalesce(c, F.lit("")))
    shape = "array<string>" if opening == "[" else "map<string,string>"
    return (text != "") & (~text.startswith(opening) | F.from_json(text, shape, {"mode": "PERMISSIVE"}).isNull()
                           | F.get_json_object(text, "$").isNull())


def matched_facts(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts paired with every rule that selects them. ``*`` is matched by an
    equi join as well: a fact offers its own id and the star."""
    wanted = rules.withColumn(
        "_norm", F.explode(F.when(F.array_contains("source_norm_ids", "*"), F.array(F.lit("*")))
                           .otherwise(F.array_distinct("source_norm_ids")))
    )
    filters = {c: F.lit(True) for c in ("answer_component_id", "field_id", "dimension_id")}
    for c in list(filters):
        if c in rules.columns:
            wanted = wanted.withColumnRenamed(c, f"_rule_{c}")
            need = blank_to_null(F.col(f"_rule_{c}"))
            filters[c] = need.isNull() | (need == F.coalesce(F.col(c), F.lit("")))
    offered = facts.withColumn(
        "_norm", F.explode(F.array(F.coalesce(F.col("norm_id"), F.lit("")), F.lit("*")))
    )
    joined = offered.join(wanted, "_norm")
    for condition in filters.values():
        joined = joined.filter(condition)
    return joined.drop("_norm", "_rule_answer_component_id", "_rule_field_id", "_rule_dimension_id")


def _group_key(columns: Sequence[str]) -> Column:
    """Values of the rule's own grouping columns; without any, its grain. The
    grain ``user`` means the respondent id."""
    pairs = []
    for c in columns:
        pairs += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    lookup = F.create_map(*pairs, F.lit("user"), F.coalesce(F.col("user_id"), F.lit("")))
    grain = F.when(F.coalesce(F.col("output_grain"), F.lit("")) != "", F.array("output_grain")).otherwise(
        F.array().cast("array<string>"))
    names = F.when(F.size("group_by") > 0, F.col("group_by")).otherwise(grain)
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(lookup, n), F.lit("")))


def rule_rows(facts: DataFrame, rules: DataFrame, order: str = "ord") -> DataFrame:
    """Facts that a rule of a known transform reads, with the rule's group key and score."""
    keyed = ["user_id", "school", "region", "role", "subject", "grade", "semester", "norm_id",
             "answer_component_id", "field_id", "dimension_id", "question_type"]
    known = rules.filter(F.col("transform_type").isin("scale_score", "multi_select_coverage"))
    value = answer_value(F.col("field_value"), F.col("raw_value"))
    return matched_facts(facts, known).select(
        "rule_id", "transform_type", _group_key([c for c in keyed if c in facts.columns]).alias("group_key"),
        F.try_element_at("value_mapping", value).alias("score"),
        is_selected(value).alias("selected"),
        blank_to_null(F.col("answer_component_id")).alias("component"),
        blank_to_null(F.col("user_id")).alias("user_id"),
        *ATTRIBUTES, "fact_id", "norm_id", F.col(order).alias("_ord"),
    )


def rebuild_indicators(facts: DataFrame, rules: DataFrame, order: str = "ord",
                       source_ids: bool = False) -> DataFrame:
    """One row per rule and group for the transforms ``scale_score`` and
    ``multi_select_coverage``; other transforms give nothing."""
    rows = rule_rows(facts, rules, order)
    key = ["rule_id", "group_key"]
    first = F.min_by(F.struct("user_id", *ATTRIBUTES), F.col("_ord")).alias("first")
    scale = rows.filter("transform_type = 'scale_score'").groupBy(*key).agg(
        F.avg("score").alias("mean_score"), first, F.count(F.lit(1)).alias("source_rows"),
    ).filter("mean_score IS NOT NULL").select(
        *key, F.col("mean_score").alias("value"), F.lit(None).cast("string").alias("label"), "first", "source_rows")
    # Respondents and components are folded pairwise first; the distinct counts
    # then run on that much smaller table.
    pairs = rows.filter("transform_type = 'multi_select_coverage'").groupBy(*key, "component", "user_id").agg(
        F.max("selected").alias("selected"), F.count(F.lit(1)).alias("n"),
        F.min("_ord").alias("_ord"), F.min_by(F.struct(*ATTRIBUTES), F.col("_ord")).alias("attributes"),
    )
    covered = pairs.groupBy(*key).agg(
        F.count_distinct("component").alias("components"),
        F.count_distinct(F.when(F.col("selected"), F.col("component"))).alias("chosen_components"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(F.col("selected"), F.col("user_id"))).alias("chosen_users"),
        F.min_by(F.struct("user_id", *[F.col(f"attributes.{c}").alias(c) for c in ATTRIBUTES]), F.col("_ord")).alias("first"),
        F.sum("n").alias("source_rows"),
    )
    by_component = F.col("components") > 0
    numerator = F.when(by_component, F.col("chosen_components")).otherwise(F.col("chosen_users"))
    denominator = F.when(by_component, F.col("components")).otherwise(F.col("users"))
    coverage = covered.select(
        *key, F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0)).alias("value"),
        F.concat_ws("/", numerator.cast("string"), denominator.cast("string")).alias("label"),
        "first", "source_rows")
    described = rules.select("rule_id", "target_indicator_id", "target_indicator_name", "output_grain",
                             "output_value_type")
    result = scale.unionByName(coverage).join(described, "rule_id").select(
        F.col("rule_id").alias("source_rule_id"),
        F.col("target_indicator_id").alias("indicator_id"),
        F.col("target_indicator_name").alias("indicator_name"),
        "output_grain", "group_key",
        F.when(F.col("output_grain") == "user", F.col("first.user_id")).alias("user_id"),
        *[F.col(f"first.{c}").alias(c) for c in ATTRIBUTES],
        F.round("value", 6).alias("indicator_value"), F.col("label").alias("indicator_value_label"),
        F.col("output_value_type").alias("value_type"), "source_rows",
    )
    if not source_ids:
        return result
    return _with_recon_id(result, rows)


def fact_digest(fact_id: Column) -> Column:
    """Order-free digest of the facts of a group: their number and the sum of the first 60
    bits of each one's MD5. It combines map-side, so a hot group sends one row per task."""
    head = F.conv(F.substring(F.md5(fact_id), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(head).cast("string"))


def indicator_sources(rows: DataFrame) -> DataFrame:
    """Source facts of every (rule, group) as a long table, each fact once, with its first place."""
    filled = rows.filter(blank_to_null(F.col("fact_id")).isNotNull())
    return filled.groupBy("rule_id", "group_key", "fact_id").agg(F.min("_ord").alias("place"))


def _with_recon_id(result: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``source_digest`` and ``recon_id``, by one formula for groups of any size: rule,
    indicator, grain, group key and the digest of the source facts."""
    digests = indicator_sources(rows).groupBy("rule_id", "group_key").agg(fact_digest(F.col("fact_id")).alias("source_digest")).select(
        F.col("rule_id").alias("source_rule_id"), "group_key", "source_digest")
    out = result.join(digests, ["source_rule_id", "group_key"], "left").withColumn(
        "source_digest", F.coalesce("source_digest", F.lit("0:0")))
    return out.withColumn("recon_id", ids.recon_id(
        F.col("source_rule_id"), F.col("indicator_id"), F.col("output_grain"), F.array_join("group_key", "\x1f"), F.col("source_digest")))
