"""Chart rows, short texts, chart results and the nested report artifact.

The rule table is a hand-written list (one row per report section). All rules
are served by one join of their ids with the metric table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveyloom import fixed_values as V
from surveyloom.sources.local import small_table

BRANCHES = ["response_count", "option_summary", "numeric_summary", "upload_summary", "matrix_summary", "indicator_value"]
ROW_ORDER = ["category", "series", "stack", "branch", "role", "subject", "norm_id", "indicator_id", "school"]
MEASURES = ["count", "denominator", "percent", "mean", "sd", "n"]
SEVERITIES = ["ok", "warning", "error"]


def python_fixed(c: Column, digits: int = 1) -> Column:
    """Text of a non-negative number with one decimal, rounded on the exact binary
    value, ties to even. The built-in format rounds the shortest decimal instead,
    which differs on ties. The fraction is scaled to an exact integer."""
    one = F.lit(1 << 59)
    whole = F.floor(c)
    scaled = ((c - whole) * one.cast("double")).cast("bigint") * (10 ** digits)
    digit, rest = F.shiftright(scaled, 59), scaled.bitwiseAND(F.lit((1 << 59) - 1))
    half = F.lit(1 << 58)
    odd = digit.bitwiseAND(F.lit(1)) == 1
    units = whole * (10 ** digits) + digit + F.when((rest > half) | ((rest == half) & odd), 1).otherwise(0)
    base = F.lit(10 ** digits)
    return F.concat(((units - units % base) / base).cast("bigint").cast("string"),
                    F.lit("."), (units % base).cast("string"))


def percent_text(c: Column) -> Column:
    return F.concat(python_fixed(F.coalesce(c, F.lit(0.0)) * 100), F.lit("%"))


def number_text(c: Column) -> Column:
    """Up to six decimals, trailing zeros dropped."""
    return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def resolve_chart_types(rules: DataFrame) -> DataFrame:
    """Adds ``unified_type``; an unknown chart name gives the empty string."""
    aliases = small_table(rules.sparkSession, [(a, u) for u, names in V.CHART_ALIASES.items() for a in names],
                          "chart_type string, unified_type string")
    return rules.join(aliases, "chart_type", "left").withColumn("unified_type", F.coalesce("unified_type", F.lit("")))


def chart_checks(resolved: DataFrame) -> DataFrame:
    """Unknown chart names (error) and types drawn as a plain table (warning)."""
    unknown = F.struct(F.lit("error").alias("severity"), F.lit("unknown_chart_type").alias("check_type"),
                       F.concat(F.lit("Unknown chart type: "), "chart_type").alias("message"))
    fallback = F.struct(F.lit("warning").alias("severity"), F.lit("table_preview_fallback").alias("check_type"),
                        F.concat(F.lit("Chart type "), "unified_type",
                                 F.lit(" is rendered as table preview in the first version.")).alias("message"))
    found = F.array_compact(F.array(
        F.when(F.col("unified_type") == "", unknown),
        F.when(~F.col("unified_type").isin(V.DRAWN_CHART_TYPES), fallback)))
    return resolved.select(F.col("report_rule_id").alias("rule_id"), F.inline(found))


#: Stands for every metric where a rule names none; no id holds a control character.
EVERY = "\x00"


def chart_rows(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows of every rule: its ids, or all charted metrics when it names
    none. ``school`` is kept, so equal categories of several schools stay apart."""
    resolved = resolve_chart_types(rules).select(
        F.col("report_rule_id").alias("rule_id"), F.col("unified_type").alias("chart_type"), "ids", "top_n",
        "text_template_id", F.col("section_title").alias("title"))
    wanted = resolved.withColumn("_id", F.explode(F.when(F.size("ids") > 0, F.array_distinct("ids")).otherwise(F.array(F.lit(EVERY)))))
    rank = F.array_position(F.array(*[F.lit(b) for b in BRANCHES]), F.col("metric_type")).cast("int")
    offered = metrics.filter(F.col("metric_type").isin(V.CHARTED_METRICS)).withColumn("branch", rank).withColumn(
        "_id", F.explode(F.array_distinct(F.array(F.lit(EVERY), F.col("norm_id"), F.col("indicator_id")))))
    joined = offered.filter("_id != ''").join(wanted, "_id")
    # a metric with both ids named by one rule counts once
    twice = (F.col("_id") == F.col("indicator_id")) & (F.col("norm_id") != F.col("indicator_id")) & F.array_contains("ids", F.col("norm_id"))
    value = F.coalesce("percent", "mean", F.col("count").cast("double"))
    return joined.filter(~twice).select(
        "rule_id", "chart_type", "title", "text_template_id", "top_n", *ROW_ORDER, value.alias("value"), *MEASURES)


def _order() -> Column:
    return F.struct(*ROW_ORDER)


def largest_top_n(rules: DataFrame) -> int:
    return rules.agg(F.max("top_n")).first()[0] or 1


def topn_texts(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The most chosen options of every group. ``limit`` is the largest top_n of
    the rules: the ranking keeps that many rows per task before the shuffle."""
    shown = F.coalesce("percent", "value")
    by = W.partitionBy(*group).orderBy(F.coalesce(shown, F.lit(0.0)).desc(), *ROW_ORDER)
    ranked = rows.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= limit).filter("_rank <= top_n")
    entry = F.struct("_rank", F.concat("category", F.lit("（"), percent_text(shown), F.lit("）")).alias("text"))
    listed = ranked.groupBy(*group, "title").agg(F.array_sort(F.collect_list(entry)).alias("top"))
    return listed.select(*group, F.concat(
        F.lit("在"), "title", F.lit("方面，选择最多的"), F.size("top").cast("string"), F.lit("项为："),
        F.array_join(F.transform("top", lambda e: e["text"]), "、"), F.lit("。")).alias("text"))


def mean_extreme_texts(rows: DataFrame, group: list[str]) -> DataFrame:
    """Items with the highest and the lowest mean; of equal means the first in
    chart order is the highest, the last the lowest."""
    value = F.coalesce("mean", "value")
    falling = F.struct((-F.coalesce(value, F.lit(0.0))).alias("v"), *ROW_ORDER)
    item = F.struct("category", value.alias("value"))
    ends = rows.groupBy(*group, "title").agg(F.min_by(item, falling).alias("high"), F.max_by(item, falling).alias("low"))
    part = lambda e: F.concat(F.col(f"{e}.category"), F.lit("（"), number_text(F.col(f"{e}.value")), F.lit("）"))
    return ends.select(*group, F.concat(
        "title", F.lit("均值最高的题项为"), part("high"), F.lit("，最低的题项为"), part("low"), F.lit("。")).alias("text"))


def sample_size_texts(rows: DataFrame, group: list[str]) -> DataFrame:
    size = F.coalesce("n", "count", "denominator")
    return rows.groupBy(*group).agg(F.min_by(size, _order()).alias("size")).select(*group, F.concat(
        F.lit("共回收有效问卷"), F.coalesce(F.col("size").cast("string"), F.lit("")), F.lit("份。")).alias("text"))


def chart_texts(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    template = F.coalesce("text_template_id", F.lit(""))
    means, sizes = template == "item_mean_extremes", template == "sample_size"
    return (topn_texts(rows.filter(~means & ~sizes), group, limit)
            .unionByName(mean_extreme_texts(rows.filter(means), group))
            .unionByName(sample_size_texts(rows.filter(sizes), group)))


def chart_notes(rows: DataFrame, group: list[str], prefix: str = "备注：") -> DataFrame:
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("_n")).select(
        *group, "rows", F.concat(F.lit(prefix), F.lit("样本量 N="), F.col("_n").cast("string"), F.lit("。")).alias("note"))


def chart_results(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    """One row per chart: number of rows, text, note. ``rows`` feeds five branches,
    so it should be a stored table."""
    head = rows.groupBy(*group).agg(F.min("title").alias("title"), F.min("chart_type").alias("chart_type"))
    return head.join(chart_texts(rows, group, limit), group, "left").join(chart_notes(rows, group), group)


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c).cast("int")


def max_severity(checks: DataFrame, group: list[str]) -> DataFrame:
    """Worst severity and the numbers of errors and warnings per group."""
    worst = F.max(F.greatest(severity_rank(F.col("severity")), F.lit(1)))
    return checks.groupBy(*group).agg(
        worst.alias("_worst"), F.count_if(F.col("severity") == "error").alias("blocking"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    ).withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_worst"))).drop("_worst")


def report_sections(results: DataFrame, rules: DataFrame, target: str) -> DataFrame:
    """Sections in report order: every rule for every target, with its chart or a
    warning; charts without a rule follow in a chapter of their own. ``rules`` has
    an ``ord``; results are keyed by (target, rule_id)."""
    targets = results.select(target).distinct()
    # every target gets every section: the rule list travels with the target row
    # as an array, at most one entry per hand-written rule
    fields = ["ord", "report_rule_id", "chapter_id", "chapter_title", "section_title"]
    listed = rules.agg(F.collect_list(F.struct(*fields)).alias("_rules")).scalar()
    planned = targets.withColumn("_rules", listed).select(target, F.inline("_rules")).withColumnRenamed("report_rule_id", "rule_id")
    assigned = planned.join(results.withColumn("has_chart", F.lit(True)), [target, "rule_id"], "left")
    known = rules.select(F.col("report_rule_id").alias("rule_id"))
    chapter, title = V.UNASSIGNED_CHAPTER
    loose = results.join(known, "rule_id", "left_anti").withColumns({
        "ord": F.lit(2147483647), "chapter_id": F.lit(chapter), "chapter_title": F.lit(title),
        "section_title": F.col("title"), "has_chart": F.lit(True)})
    first = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), d)
    sections = assigned.unionByName(loose, allowMissingColumns=True).withColumns({
        "has_chart": F.coalesce("has_chart", F.lit(False)),
        "chapter_id": first("chapter_id", F.lit("chapter")),
    })
    return sections.withColumns({
        "chapter_title": first("chapter_title", F.col("chapter_id")),
        "section_title": first("section_title", F.coalesce("title", F.lit(""))),
        "issue": F.when(~F.col("has_chart"), F.concat(F.lit("Missing chart result for rule "), "rule_id", F.lit("."))),
    })


def report_artifacts(sections: DataFrame, target: str, title: str = V.REPORT_TITLE) -> DataFrame:
    """One nested report per target: chapters in order of first appearance, their
    sections in rule order."""
    section = F.struct("ord", "rule_id", "section_title", "has_chart", "text", "note", "issue")
    chapters = sections.groupBy(target, "chapter_id").agg(
        F.min(F.struct("ord", "rule_id")).alias("first"), F.min_by("chapter_title", F.struct("ord", "rule_id")).alias("chapter_title"),
        F.array_sort(F.collect_list(section)).alias("sections"))
    nested = F.array_sort(F.collect_list(F.struct("first", "chapter_id", "chapter_title", "sections")))
    return chapters.groupBy(target).agg(nested.alias("chapters")).withColumn("title", F.lit(title))
