"""From sheet rows to the long answer-fact table, its dimension table and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom import fixed_values as V
from surveyloom.functions import ids, text
from surveyloom.functions.text import blank_to_null, first_filled
from surveyloom.operators.ordering import first_rows
from surveyloom.session import cut_lineage, lookup_side
from surveyloom.sources.cells import cell, is_question_number, keyed_rows

TITLE_FIELDS = ["project_name", "form_title", "semester", "form_id", "subject", "role"]
COMPONENT_FIELDS = [
    "answer_component_id", "answer_component_type", "answer_component_label", "field_id", "field_name",
    "field_title", "dimension_id", "dimension_name", "dimension_group_name", "dimension_title",
]
QUESTION_FIELDS = ["norm_id", "question_type", "question_text", "canonical_question"]


# --- titles ---------------------------------------------------------------------------

def parse_titles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title parts of every file name, and one check row per name that does not
    have exactly four bracketed parts."""
    name = F.regexp_extract("source_file", r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    parts = F.transform(F.regexp_extract_all(stem, F.lit(r"\[([^\[\]]+)\]"), 1), text.squeeze_spaces)
    split = files.select("source_file", stem.alias("stem"), parts.alias("parts"))
    ok = F.size("parts") == 4
    title = F.col("parts")[1]
    subject = text.subject_from_title(title)
    role = text.role_from_title(title)
    titles = split.filter(ok).select(
        "source_file", "stem", F.col("parts")[0].alias("project_name"), title.alias("form_title"),
        F.col("parts")[2].alias("semester"), F.col("parts")[3].alias("form_id"), subject.alias("subject"),
        F.when((role == "") & (subject == "学校"), F.lit("学校")).otherwise(role).alias("role"),
    )
    checks = split.filter(~ok).select(
        F.lit("error").alias("severity"), F.lit("title_parts").alias("check_type"),
        F.col("source_file").alias("key"),
        F.concat(F.lit("Expected four bracketed parts, found "), F.size("parts").cast("string")).alias("message"),
    )
    return titles, checks


def title_conflicts(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields filled in both places with different values. ``pages`` holds
    source_file and the title fields as read from the front page."""
    def long(df: DataFrame, name: str) -> DataFrame:
        have = [c for c in TITLE_FIELDS if c in df.columns]
        clean = df.select("source_file", *[text.squeeze_spaces(F.col(c)).alias(c) for c in have])
        return clean.unpivot(["source_file"], have, "field", name).filter(F.col(name) != "")

    both = long(titles, "filename_value").join(long(pages, "front_page_value"), ["source_file", "field"])
    return both.filter(F.col("filename_value") != F.col("front_page_value")).select(
        F.lit("warning").alias("severity"), F.lit("title_metadata_conflict").alias("issue"), "source_file",
        "field", "filename_value", "front_page_value", F.lit(False).alias("blocking"))


# --- answer components ----------------------------------------------------------------------

def build_components(fields: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Fields × dimensions of the same question; a field without dimension and a
    dimension of a question without field are kept once. Both inputs are keyed
    rows of the mapping sheets; ``ord`` keeps the reading order."""
    question = ["source_file", "question_no", "question_id"]
    f = fields.select(
        "source_file", cell("题号").alias("question_no"), cell("题id").alias("question_id"),
        cell("字段id").alias("field_id"), cell("字段名称").alias("field_name"), cell("字段标题").alias("field_title"),
        F.col("row_index").alias("field_row"))
    d = dimensions.select(
        "source_file", cell("题号").alias("question_no"), cell("题id").alias("question_id"),
        cell("维度id").alias("dimension_id"), cell("维度名称").alias("dimension_name"),
        cell("维度组名称").alias("dimension_group_name"), cell("维度标题").alias("dimension_title"),
        F.col("row_index").alias("dimension_row"))
    joined = f.join(d, question, "full_outer")
    has_field, has_dimension = F.col("field_row").isNotNull(), F.col("dimension_row").isNotNull()
    values = ["field_id", "field_name", "field_title", "dimension_id", "dimension_name",
              "dimension_group_name", "dimension_title"]
    words = F.lower(F.concat_ws(" ", "field_name", "field_title", "dimension_title"))
    upload = F.lit(False)
    for hint in V.UPLOAD_HINTS:
        upload = upload | words.contains(hint)
    kind = (F.when(upload, "upload").when(has_dimension & ~has_field, "matrix_row")
            .when(has_field, "option").otherwise("scalar"))
    return joined.select(
        *question, kind.alias("answer_component_type"),
        F.struct(F.coalesce("field_row", F.lit(2147483647)).alias("f"),
                 F.coalesce("dimension_row", F.lit(0)).alias("d")).alias("ord"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in values],
    ).withColumn(
        "answer_component_id", ids.component_id(F.col("question_id"), F.col("field_id"), F.col("dimension_id"))
    ).withColumn("answer_component_label", F.coalesce(first_filled(F.col("field_title"), F.col("dimension_title")), F.lit("")))


def components_of(cells: DataFrame) -> DataFrame:
    return build_components(
        keyed_rows(cells.filter(F.col("sheet") == V.FIELD_SHEET)),
        keyed_rows(cells.filter(F.col("sheet") == V.DIMENSION_SHEET)))


def match_components(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Adds the struct ``component``: the first with equal field and dimension,
    else the first with the same non-empty field, else the only one of the
    question, else NULL; ``component_count`` is the number to choose from.
    ``rows`` has source_file, question_no, row_field_id and row_dimension_id."""
    question = ["source_file", "question_no"]
    components = cut_lineage(components)
    one = F.struct(*COMPONENT_FIELDS)
    exact = components.groupBy(*question, "field_id", "dimension_id").agg(F.min_by(one, F.col("ord")).alias("_exact"))
    by_field = components.filter("field_id != ''").groupBy(*question, "field_id").agg(
        F.min_by(one, F.col("ord")).alias("_by_field"))
    single = components.groupBy(*question).agg(
        F.count(F.lit(1)).alias("component_count"), F.min_by(one, F.col("ord")).alias("_single"))
    exact = exact.withColumnsRenamed({"field_id": "row_field_id", "dimension_id": "row_dimension_id"})
    by_field = by_field.withColumnRenamed("field_id", "row_field_id")
    joined = (
        rows.join(exact, [*question, "row_field_id", "row_dimension_id"], "left")
        .join(by_field, [*question, "row_field_id"], "left")
        .join(single, question, "left")
    )
    only = F.when(F.col("component_count") == 1, F.col("_single"))
    return joined.withColumn("component", F.coalesce("_exact", "_by_field", only)).withColumn(
        "component_count", F.coalesce("component_count", F.lit(0))).drop("_exact", "_by_field", "_single")


# --- questions ----------------------------------------------------------------------------------

def question_lookup(mapping: DataFrame, match_role: bool = False) -> DataFrame:
    """One mapping row per (subject, question number); of equal keys the last by
    ``ord``. The role is not part of the key unless asked for."""
    key = ["subject", "q_no"] + (["role"] if match_role else [])
    row = F.max_by(F.struct(*QUESTION_FIELDS), F.col("ord"))
    return mapping.groupBy(*key).agg(row.alias("question")).withColumnRenamed("q_no", "question_no")


# --- facts -----------------------------------------------------------------------------------------

def split_rows(cells: DataFrame) -> DataFrame:
    """One row per answer of the numbered sheets."""
    rows = keyed_rows(cells.filter(is_question_number(F.col("sheet"))))
    return rows.select(
        "source_file", F.col("sheet").alias("question_no"), "row", F.col("sheet").alias("source_sheet"),
        F.col("row_index").alias("source_row_index"))


def wide_rows(cells: DataFrame) -> DataFrame:
    """One row per (sheet row, numbered column) of the first sheet that is not a
    system sheet; blank answers stay. Files with numbered sheets are left out."""
    sheets = cells.groupBy("source_file").agg(
        F.max(is_question_number(F.col("sheet"))).alias("split"),
        F.coalesce(
            F.min(F.when(~F.col("sheet").isin(V.SYSTEM_SHEETS), F.col("sheet_index"))), F.min("sheet_index"),
        ).alias("sheet_index"),
    ).filter(~F.col("split")).drop("split")
    rows = keyed_rows(cells.join(sheets, ["source_file", "sheet_index"], "left_semi"))
    numbered = F.map_filter("row", lambda k, v: is_question_number(k))
    blank = F.create_map(*[F.lit(x) for k in ("字段id", "字段名称", "维度id", "维度名称") for x in (k, "")])
    own = F.map_filter("row", lambda k, v: ~k.isin("字段取值", "字段id", "字段名称", "维度id", "维度名称"))
    return rows.select("*", F.explode(numbered).alias("question_no", "_answer")).select(
        "source_file", "question_no",
        F.map_concat(own, blank, F.create_map(F.lit("字段取值"), F.col("_answer"))).alias("row"),
        F.col("sheet").alias("source_sheet"), F.col("row_index").alias("source_row_index"))


def unpivot_wide(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A wide answer table (columns named 1, 2, …) as one row per question;
    blank answers stay as rows."""
    numbered = [c for c in df.columns if c.isascii() and c.isdigit()]
    return df.unpivot(list(keep), numbered, "question_no", "field_value")


def build_facts(rows: DataFrame, titles: DataFrame, mapping: DataFrame, components: DataFrame) -> DataFrame:
    """Long answer facts with stable ids. ``matched`` is false where the question
    is not in the mapping; its norm id is then the local question key."""
    title = titles.select("source_file", *[F.col(c).alias(f"t_{c}") for c in TITLE_FIELDS], "stem")
    titled = rows.join(lookup_side(title), "source_file", "left").withColumns({
        "subject": F.coalesce(first_filled(F.col("t_subject"), cell("学科维度")), F.lit("")),
        "role": F.coalesce("t_role", F.lit("")),
        "row_field_id": cell("字段id"), "row_dimension_id": cell("维度id"),
    })
    asked = titled.join(question_lookup(mapping), ["subject", "question_no"], "left")
    chosen = match_components(asked, components)
    given = lambda c: F.coalesce(F.col(f"t_{c}"), F.lit(""))
    part = lambda c: F.coalesce(F.col(f"component.{c}"), F.lit(""))
    either = lambda c, key: F.coalesce(first_filled(part(c), cell(key)), F.lit(""))
    local_key = F.concat_ws("|", "role", "subject", "question_no")
    asked_for = lambda c: F.coalesce(F.col(f"question.{c}"), F.lit(""))
    facts = chosen.select(
        ids.dataset_id(*[F.col(f"t_{c}") for c in ("project_name", "role", "subject", "semester", "form_id")],
                       fallback=F.regexp_replace(F.regexp_extract("source_file", r"([^/\\]*)$", 1),
                                                 r"(?<=.)\.[^.]*$", "")).alias("dataset_id"),
        given("project_name").alias("project_name"), given("form_title").alias("form_title"),
        given("form_id").alias("form_id"), "role", "subject", cell("用户维度").alias("user_id"),
        cell("学校维度").alias("school"), cell("区域维度").alias("region"), cell("年级维度").alias("grade"),
        F.coalesce(first_filled(cell("学期维度"), given("semester")), F.lit("")).alias("semester"),
        "question_no", local_key.alias("local_question_key"),
        F.when(F.col("question").isNull(), local_key).otherwise(asked_for("norm_id")).alias("norm_id"),
        *[asked_for(c).alias(c) for c in QUESTION_FIELDS[1:]],
        *[part(c).alias(c) for c in COMPONENT_FIELDS[:3]],
        cell("字段取值").alias("field_value"), cell("字段取值").alias("raw_value"),
        either("field_id", "字段id").alias("field_id"), either("field_name", "字段名称").alias("field_name"),
        part("field_title").alias("field_title"), either("dimension_id", "维度id").alias("dimension_id"),
        either("dimension_name", "维度名称").alias("dimension_name"),
        part("dimension_group_name").alias("dimension_group_name"), part("dimension_title").alias("dimension_title"),
        cell("状态").alias("status"), "source_file", "source_sheet", "source_row_index",
        F.col("question").isNotNull().alias("matched"), "component_count", F.col("component"),
    )
    return facts.withColumn("fact_id", ids.fact_id(*[F.col(c) for c in (
        "dataset_id", "source_sheet", "source_row_index", "local_question_key", "answer_component_id",
        "field_id", "user_id")]))


def unmatched_checks(facts: DataFrame) -> DataFrame:
    """One warning per answer row whose question is not in the mapping."""
    return facts.filter(~F.col("matched")).select(
        F.lit("unmatched_question").alias("check_type"), F.lit("warning").alias("severity"), "source_sheet",
        "source_row_index", "local_question_key",
        F.lit("Question not found in normalized questionnaire mapping.").alias("message"))


def question_table(facts: DataFrame) -> DataFrame:
    """One row per local question and one per (question, component), each from
    the first fact in reading order."""
    order = [F.col("source_file"), F.col("source_sheet"), F.col("source_row_index")]
    shared = ["dataset_id", "role", "subject", "question_no", "norm_id", *QUESTION_FIELDS[1:]]
    empty = lambda c: F.lit("").alias(c)
    questions = first_rows(facts, ["local_question_key"], order, shared).select(
        F.lit("question").alias("entity_type"), "local_question_key", *shared,
        F.coalesce(first_filled(F.col("canonical_question"), F.col("question_text"), F.col("local_question_key")),
                   F.lit("")).alias("display_title"),
        *[empty(c) for c in COMPONENT_FIELDS], F.col("norm_id").alias("join_key"), empty("option_order"))
    chosen = facts.filter(F.coalesce(F.col("component.answer_component_id"), F.lit("")) != "").withColumns(
        {f"c_{c}": F.col(f"component.{c}") for c in COMPONENT_FIELDS})
    parts = first_rows(chosen, ["local_question_key", "c_answer_component_id"], order,
                       [*shared, "component_count", *[f"c_{c}" for c in COMPONENT_FIELDS if c != "answer_component_id"]])
    components = parts.select(
        F.lit("answer_component").alias("entity_type"), "local_question_key", *shared,
        F.col("c_answer_component_label").alias("display_title"),
        *[F.col(f"c_{c}").alias(c) for c in COMPONENT_FIELDS],
        F.concat_ws("|", "norm_id", "c_answer_component_id").alias("join_key"),
        F.when(F.col("component_count") == 1, F.lit("1")).otherwise("").alias("option_order"))
    return questions.unionByName(components)


# --- two sources --------------------------------------------------------------------------------------

def join_two_sources(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes=("_a", "_b")) -> DataFrame:
    """Full outer join on ``keys``; other columns of the same name get a suffix."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    named = [df.withColumnsRenamed({c: c + s for c in clash}) for df, s in zip((left, right), suffixes)]
    return named[0].join(named[1], list(keys), "full_outer")


def drop_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def reshape_export(df: DataFrame, drop: Sequence[str], rename: dict[str, str], value: str, label: str) -> DataFrame:
    """Drop and rename export columns; a chosen "other, …" label becomes "其他"."""
    shaped = df.drop(*drop).withColumnsRenamed(rename)
    other = (F.col(value).cast("string") == "1") & F.coalesce(F.col(label).rlike("其他，|其它，"), F.lit(False))
    return shaped.withColumn(label, F.when(other, F.lit("其他")).otherwise(F.col(label)))


def clean_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pasted markup out of text cells, ends trimmed."""
    def clean(c: Column) -> Column:
        return F.trim(text.replace_all(c, [('xml:space="preserve">', ""), ('xml:space="preserve"', "")]))
    return df.withColumns({c: clean(F.col(c)) for c in columns})


def clean_names(df: DataFrame, keep_spaces: bool = False) -> DataFrame:
    """Column names with white-space runs (no-break spaces included) squeezed to
    one blank, or removed."""
    return df.toDF(*[(" " if keep_spaces else "").join(c.split()) for c in df.columns])
