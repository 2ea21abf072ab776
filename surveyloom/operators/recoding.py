"""Recoding of answer columns before scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions.text import blank_to_null
from surveyloom.functions.values import blank_numbers, blank_parts, hours_between, option_labels, plausible_sleep


def merge_options(df: DataFrame, column: str, table: DataFrame, target: str) -> DataFrame:
    """Options renamed by a table (option, merged); options it does not list stay."""
    renamed = table.select(F.col("option").alias(column), F.col("merged").alias("_merged"))
    return df.join(renamed, column, "left").withColumn(target, F.coalesce("_merged", column)).drop("_merged")


def reverse_items(df: DataFrame, items: Sequence[str], suffix: str = "_before") -> DataFrame:
    """max + 1 − x with the maximum of the observed data, original kept. All
    maxima are scalar subqueries of one aggregate."""
    present = [i for i in items if i in df.columns]
    maxima = {i: df.agg(F.max(F.col(i).cast("double"))).scalar() for i in present}
    backed = df.withColumns({i + suffix: F.col(i) for i in present})
    return backed.withColumns({i: maxima[i] + 1 - F.col(i).cast("double") for i in present})


def minus_one(df: DataFrame, items: Sequence[str], suffix: str | None = "_raw") -> DataFrame:
    """Items counted from zero instead of one, the original kept unless suffix is None."""
    backed = df.withColumns({i + suffix: F.col(i) for i in items}) if suffix else df
    return backed.withColumns({i: F.col(i).cast("double") - 1 for i in items})


def one_hot(df: DataFrame, column: str, options: Sequence[str], separator: str = r"\|\r\n|\|\n|\|") -> DataFrame:
    """A 0/1 column ``column_option`` per option of a multiple choice answer; an
    unanswered question stays NULL in all of them."""
    chosen = F.transform(F.split(column, separator), lambda x: F.trim(x))
    return df.withColumns({
        f"{column}_{o}": F.when(F.col(column).isNotNull(), F.array_contains(chosen, o).cast("int")) for o in options})


def skip_logic(df: DataFrame, rules: Sequence[tuple[str, Sequence[str], str, str | None]]) -> DataFrame:
    """Rules (gate column, gate answers, dependent column, fill): where the gate has
    one of the answers the dependent becomes NULL or the fill text. Gates are read
    as they were before any rule."""
    dependents: dict[str, Column] = {}
    for gate, answers, dependent, fill in rules:
        base = dependents.get(dependent, F.col(dependent))
        closed = F.coalesce(F.col(gate).isin(*answers), F.lit(False))
        dependents[dependent] = F.when(closed, F.lit(fill)).otherwise(base)
    return df.withColumns(dependents)


def sleep_durations(df: DataFrame, answer: Column, target: str) -> DataFrame:
    """Adds the hours slept by an answer ``wake hour|minute|bed hour|minute``. Parts, numbers
    and hours are a projection each: the formula names a number up to a hundred times,
    and in one expression each of them would split and parse the answer again."""
    blanks = ["_wake_h", "_wake_m", "_bed_h", "_bed_m"]
    cut = df.withColumn("_parts", blank_parts(answer))
    parsed = cut.withColumns(dict(zip(blanks, blank_numbers(F.col("_parts"), 4))))
    slept = parsed.withColumn("_hours", hours_between(*[F.col(b) for b in blanks]))
    return slept.withColumn(target, plausible_sleep(F.col("_hours"))).drop("_parts", *blanks, "_hours")


def value_labels(index: DataFrame) -> DataFrame:
    """Label dictionary (item, label, code) of the single choice items in an item
    index (item, options, reverse). A reversed item is labelled n..1."""
    labels = index.filter(blank_to_null(F.col("options")).isNotNull()).withColumn("_labels", option_labels(F.col("options")))
    coded = labels.select("item", "reverse", F.size("_labels").alias("_n"), F.posexplode("_labels").alias("_i", "label"))
    plain = F.col("_i") + 1
    code = F.when(F.coalesce(F.col("reverse") == "R", F.lit(False)), F.col("_n") + 1 - plain).otherwise(plain)
    return coded.select("item", "label", code.alias("code"))


def encode_choices(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the code of (item, answer); an "other_______…" answer counts by the
    text before its blank."""
    answer = F.trim(F.split("answer", "_______").getItem(0))
    return long.withColumn("label", answer).join(labels, ["item", "label"], "left").drop("label")
