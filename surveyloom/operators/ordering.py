"""Running sums and global numbering that never put one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveyloom.session import cut_lineage, shuffled


def running_sum(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str,
                span: int = 8192) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in order of the integer
    column ``position``. A group is cut into spans of positions; only the span
    totals of a group are ever ordered together, so a file holding a third of
    all rows is spread over many tasks."""
    block = F.floor(F.col(position) / span)
    rows = df.withColumn("_value", value).withColumn("_block", block)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(shuffled(bases), [*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_base"))
        .drop("_value", "_block", "_inside", "_base")
    )


def number_globally(df: DataFrame, order: Sequence[Column], name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Dense numbers 1, 2, … in global order. The rows are range-sorted and
    frozen by a checkpoint; only the row count per range passes through one
    task, never the rows. With ``keep`` only those columns are frozen."""
    ordered = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    frozen = cut_lineage(ordered.select(*keep, "_slot") if keep else ordered).withColumn("_range", F.shiftright("_slot", 33))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        frozen.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    in_range = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        frozen.join(starts, "_range")
        .withColumn(name, F.col("_start") + in_range + 1)
        .drop("_slot", "_range", "_start")
    )


def sum_before(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before a row in global order: the number of the
    first part of a thing that has ``value`` parts. Range-sorted and frozen as above; a
    range adds up its own rows, only its total passes through one task."""
    frozen = cut_lineage(
        df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_slot", 33))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = frozen.groupBy("_range").agg(F.sum(value).alias("_sum")).withColumn(
        "_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy("_range").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return frozen.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, "_range").withColumn(
        name, F.col("_start") + F.col("_inside")).drop("_slot", "_range", "_start", "_inside")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The row of every group that comes first, as an aggregate with map-side
    combine instead of a window over the whole group."""
    picked = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")
