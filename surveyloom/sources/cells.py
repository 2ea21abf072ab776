"""Workbook content as a cells table.

One row per sheet row: source_file, sheet_index, sheet, row_index (1-based),
values ARRAY<STRING>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom import fixed_values as V
from surveyloom.functions.text import blank_to_null, strip
from surveyloom.session import lookup_side

SHEET = ["source_file", "sheet_index", "sheet"]


def clean_cells(cells: DataFrame) -> DataFrame:
    """Trimmed cells, absent ones as the empty string."""
    return cells.withColumn("values", F.transform("values", lambda v: strip(F.coalesce(v, F.lit("")))))


def has_content(values: Column) -> Column:
    return F.exists(values, lambda v: v != "")


def is_question_number(name: Column) -> Column:
    return name.rlike("^[0-9]+$")


def headers(cells: DataFrame) -> DataFrame:
    """The first row with content of every sheet. The row number is found first
    (a hash aggregate on numbers) and its cells are fetched after."""
    filled = cells.filter(has_content(F.col("values")))
    index = filled.groupBy(*SHEET).agg(F.min("row_index").alias("row_index"))
    return filled.join(lookup_side(index), [*SHEET, "row_index"]).select(
        *SHEET, F.col("values").alias("header"), F.col("row_index").alias("header_index"))


def keyed_rows(cells: DataFrame) -> DataFrame:
    """Rows below the header as MAP<header, value>: blank rows skipped, short rows
    padded, blank headers dropped; of equal headers the last column counts."""
    later = lambda i: F.slice("header", i + 2, F.size("header"))
    places = F.filter(
        F.transform("header", lambda h, i: F.struct(h.alias("key"), i.alias("i"), F.array_contains(later(i), h).alias("again"))),
        lambda e: (e["key"] != "") & ~e["again"],
    )
    heads = headers(cells).select(
        *SHEET, "header_index", F.transform(places, lambda e: e["key"]).alias("keys"),
        F.transform(places, lambda e: e["i"]).alias("places"))
    joined = cells.filter(has_content(F.col("values"))).join(lookup_side(heads), SHEET)
    values = F.transform("places", lambda i: F.coalesce(F.get("values", i), F.lit("")))
    return joined.filter(F.col("row_index") > F.col("header_index")).select(
        *SHEET, "row_index", F.map_from_arrays("keys", values).alias("row"))


def cell(key: str) -> Column:
    return F.coalesce(F.try_element_at("row", F.lit(key)), F.lit(""))


def detect_layouts(cells: DataFrame) -> DataFrame:
    """Per file: split (front page, type statistics and a numbered sheet), wide
    (the first row with content has several fields) or unknown."""
    fields = F.size(F.filter("values", lambda v: v != ""))
    # one row per sheet first, so that a sheet of any length is folded map-side
    sheets = cells.groupBy(*SHEET).agg(
        F.min(F.when(fields > 0, F.struct("row_index", fields.alias("fields")))).alias("first"))
    filled = F.col("first").isNotNull()
    files = sheets.groupBy("source_file").agg(
        F.max(F.col("sheet") == V.FRONT_PAGE_SHEET).alias("has_front_page"),
        F.max(F.col("sheet") == V.TYPE_STATS_SHEET).alias("has_type_stats"),
        F.count_if(is_question_number(F.col("sheet"))).alias("numbered_sheets"),
        F.coalesce(F.min_by(F.when(filled, F.col("first.fields")), F.when(filled, F.col("sheet_index"))),
                   F.lit(0)).cast("bigint").alias("first_row_fields"),
    )
    split = F.col("has_front_page") & F.col("has_type_stats") & (F.col("numbered_sheets") > 0)
    kind = F.when(split, "split_question_workbook").when(F.col("first_row_fields") > 1, "wide_table").otherwise("unknown")
    return files.withColumn("workbook_type", kind)


def front_pages(cells: DataFrame) -> DataFrame:
    """Front page as (source_file, key, value); of equal keys the last row counts."""
    rows = cells.filter((F.col("sheet") == V.FRONT_PAGE_SHEET) & (F.size("values") >= 2))
    return rows.select("source_file", "row_index", F.col("values")[0].alias("key"), F.col("values")[1].alias("value")
                       ).filter(blank_to_null(F.col("key")).isNotNull()).groupBy("source_file", "key").agg(
        F.max_by("value", "row_index").alias("value"))


def front_page_maps(cells: DataFrame) -> DataFrame:
    """One map per file (a front page is one printed page) plus the scope fields."""
    pages = front_pages(cells).groupBy("source_file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("front_page"))
    scope = [F.coalesce(F.try_element_at("front_page", F.lit(k)), F.lit("")).alias(k) for k in V.SCOPE_KEYS]
    return pages.select("source_file", "front_page", F.struct(*scope).alias("scope"))


def question_types(cells: DataFrame) -> DataFrame:
    rows = keyed_rows(cells.filter(F.col("sheet") == V.TYPE_STATS_SHEET))
    return rows.select("source_file", "row_index", cell("题号").alias("question_no"), cell("题型").alias("question_type")
                       ).filter(F.col("question_no") != "").groupBy("source_file", "question_no").agg(
        F.max_by("question_type", "row_index").alias("question_type"))
