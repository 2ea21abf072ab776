"""CSV and JSON sources and sinks, file discovery."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.session import shared_folder

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, blank: bool = True,
             multi_line: bool = True) -> DataFrame:
    """Header CSV, every column a string, a byte-order mark tolerated; absent values are
    empty strings when ``blank``. ``columns`` picks by header name, in the given order,
    and a missing one is an error. Line breaks inside quotes make a file one task;
    with ``multi_line`` off large files are split."""
    df = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
          .option("inferSchema", False).csv(path))
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the header: {missing}")
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    return df.na.fill("") if blank else df


def write_csv(df: DataFrame, path: str, fields: Sequence[str], bom: bool = True) -> None:
    """Fields in the given order; other columns are ignored. Every part file
    opens with a byte-order mark, in its header, where wanted."""
    have = set(df.columns)
    named = [(F.col(c) if c in have else F.lit("")).cast("string").alias((BOM if bom and i == 0 else "") + c)
             for i, c in enumerate(fields)]
    df.select(*named).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def find_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below ``path`` whose name fits, editor temp files left out; the
    listing is Spark's own and the content is not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(path))
    return found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length").filter(
        ~F.col("name").startswith("~$")).orderBy("path")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the written tables, which all executors reach."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
