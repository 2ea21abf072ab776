"""Report rules: parsing and scope filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.session import cut_lineage

SCOPE_FIELDS = ["school", "region", "role", "subject", "grade", "semester"]


def id_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _scope_values(json: Column, field: str) -> Column:
    """Allowed values of a scope field: a JSON list, one value, or NULL when the
    field is not named or its list is empty."""
    text = F.get_json_object(json, f"$.{field}")
    many = F.from_json(text, "array<string>")
    values = F.when(text.startswith("["), many).when(text.isNotNull(), F.array(text))
    return F.when(F.size(values) > 0, values)


def parse_report_rules(rules: DataFrame, json_fields=("filter_scope_json", "writing_metrics_json")) -> tuple[DataFrame, DataFrame]:
    """Typed rules plus one check row per JSON field that is no JSON object."""
    def bad(c: str) -> Column:
        text = F.trim(F.coalesce(F.col(c), F.lit("")))
        return (text != "") & (~text.startswith("{") | F.get_json_object(text, "$").isNull())

    checked = rules.withColumn("_bad", F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in json_fields])))
    issues = checked.select("report_rule_id", F.explode("_bad").alias("field")).select(
        F.lit("error").alias("severity"), F.lit("malformed_rule_json").alias("check_type"),
        F.col("report_rule_id").alias("key"),
        F.concat("field", F.lit(" must be a JSON object")).alias("message"),
    )
    scope = F.struct(*[_scope_values(F.col("filter_scope_json"), f).alias(f) for f in SCOPE_FIELDS])
    top_n = F.coalesce(F.get_json_object("writing_metrics_json", "$.top_n").try_cast("int"), F.lit(1))
    typed = checked.filter(F.size("_bad") == 0).drop("_bad").select(
        *[c for c in rules.columns if c not in ("norm_ids_or_indicator_ids", *json_fields)],
        id_list(F.col("norm_ids_or_indicator_ids")).alias("ids"),
        scope.alias("scope"), top_n.alias("top_n"),
    )
    return typed, issues


def apply_scopes(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with every rule whose scope they meet, by an index from (field, value) to rules.

    Rows of equal scope values meet the same rules, so only the distinct combinations of
    them look into the index: a combination offers its six values, each finds the rules
    that allow it, and a rule is met when all fields it names are. A rule that names
    none stands under a mark that every combination offers. No row ever holds the
    rules, and their number may grow with the data. A field the rows do not have counts
    as blank, as an absent value does; so does NULL."""
    at = [F.coalesce(F.col(f).cast("string"), F.lit("")) if f in rows.columns else F.lit("") for f in SCOPE_FIELDS]
    keyed = rows.withColumn("_scope", F.array(*at))
    combinations = cut_lineage(keyed.select("_scope").distinct().withColumn("_of", F.monotonically_increasing_id()))
    named = rules.select(F.monotonically_increasing_id().alias("_rule"), "report_rule_id", "scope")
    limits = F.filter(F.array(*[F.struct(F.lit(i).alias("field"), F.col("scope")[f].alias("values")) for i, f in enumerate(SCOPE_FIELDS)]),
                      lambda x: x["values"].isNotNull())
    free = F.array(F.struct(F.lit(-1).alias("field"), F.array(F.lit("")).alias("values")))
    listed = cut_lineage(named.select("_rule", "report_rule_id", F.when(F.size(limits) > 0, limits).otherwise(free).alias("limits")))
    index = listed.select("_rule", F.size("limits").alias("_all"), F.explode("limits").alias("limit")).select(
        "_rule", "_all", "limit.field", F.explode(F.array_distinct("limit.values")).alias("value"))
    offered = combinations.select("_of", F.posexplode(F.concat("_scope", F.array(F.lit("")))).alias("place", "value")).select(
        "_of", F.when(F.col("place") == len(SCOPE_FIELDS), -1).otherwise(F.col("place")).alias("field"), "value")
    met = offered.join(index, ["field", "value"]).groupBy("_of", "_rule", "_all").agg(F.count(F.lit(1)).alias("_met")).filter("_met = _all")
    rules_of = cut_lineage(met.join(listed.select("_rule", "report_rule_id"), "_rule").join(combinations, "_of").select("_scope", "report_rule_id"))
    return keyed.join(rules_of, "_scope").select("report_rule_id", *rows.columns)
