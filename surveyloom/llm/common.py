"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveyloom.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder with a unique ``_row`` per row, so
    that repeated or null ids never meet in a later join."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def joined_to(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to a stored table of one row per ``key``, whose file size decides
    between a broadcast and a shuffle join. Keys of at least 1 % of the rows, at most
    100, are broadcast with what they meet; their rows are dealt out evenly in the
    shuffle, so no task holds a hot key."""
    names = [c for c in side.columns if c != key]
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.withColumn("_all", sizes.agg(F.sum("_n").alias("n")).scalar()).filter("100 * _n >= _all").select(key))
    often = hot.join(side, key, "left").select(key, F.struct(*names).alias("_often"))
    at = rows.join(F.broadcast(often), key, "left").withColumn(
        "_salt", F.when(F.col("_often").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    met = at.join(side.select(key, F.struct(*names).alias("_met"), F.lit(0).cast("bigint").alias("_salt")), [key, "_salt"], "left")
    return met.select(*rows.columns, *[F.coalesce(F.col("_often")[c], F.col("_met")[c]).alias(c) for c in names])


def in_block_pairs(rows: DataFrame, keys: list[str], spread: str, block_rows: int) -> DataFrame:
    """Deal the rows of every group to pairs of blocks (_x <= _y) of about
    ``block_rows`` rows, so that any two rows of a group meet in exactly one pair
    and no task holds a whole hot group. ``_block`` is a row's own block. Rows with a null
    key are in no group and fall into one block."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
    blocks = F.coalesce(F.ceil(F.col("_n") / block_rows), F.lit(1)).cast("int")
    dealt = (
        rows.join(sizes, keys, "left").withColumn("_blocks", blocks)
        .withColumn("_block", F.pmod(F.xxhash64(F.col(spread), F.lit(11)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    return dealt.withColumn("_x", F.least("_block", "_other")).withColumn("_y", F.greatest("_block", "_other")).drop(
        "_n", "_blocks", "_other")
