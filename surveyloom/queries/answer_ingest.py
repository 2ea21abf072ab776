"""Workbook and ingest queries.

The cells table is derived from the given tables: one split workbook per region
(orders are the answers of sheet 1, customers of sheet 2, suppliers of sheet 5),
one wide workbook from part, one plain list from nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import text
from surveyloom.operators import answers
from surveyloom.queries import query
from surveyloom.queries import bindings as B
from surveyloom.session import cut_lineage
from surveyloom.sources import cells as C
from surveyloom.sources.local import small_table

CELLS = "source_file string, sheet_index int, sheet string, row_index bigint, values array<string>"


def _listed(fixed):
    """A short hand-written table as one array, for an explode beside other rows."""
    return fixed.agg(F.collect_list(F.struct(*fixed.columns))).scalar()


def _file():
    return F.concat(F.lit("[课程监测]["), F.col("r_name"), F.lit("学科课程实施情况表（学生）][2024下][F"),
                    F.col("r_regionkey").cast("string"), F.lit("].xlsx"))


def _row(df, file, index, sheet, row_index, *values):
    return df.select(
        (F.lit(file) if isinstance(file, str) else file).alias("source_file"), F.lit(index).alias("sheet_index"),
        F.lit(sheet).alias("sheet"), row_index.cast("bigint").alias("row_index"),
        F.array(*[v.cast("string") if not isinstance(v, str) else F.lit(v) for v in values]).alias("values"))


FIXED_ROWS = [
    (1, "首页", ["项目名称 ", " 课程监测"]), (1, "首页", ["学科", "{region}"]), (1, "首页", ["学期", "2023上"]),
    (1, "首页", ["学期", "{semester}"]), (1, "首页", ["只有一格"]), (1, "首页", ["区域维度", "{region}"]),
    (2, "题型统计", ["题号", "题型"]), (2, "题型统计", ["1", "单选题"]), (2, "题型统计", ["2", "填空题"]),
    (2, "题型统计", ["5", "上传题"]),
    (3, "字段映射关系", ["题号", "题id", "字段id", "字段名称", "字段标题"]),
    (3, "字段映射关系", ["1", "Q1", "F", "status_f", "已完成"]), (3, "字段映射关系", ["1", "Q1", "O", "status_o", "进行中"]),
    (3, "字段映射关系", ["2", "Q2", "S", "upload_file", "余额"]),
    (4, "维度映射关系", ["题号", "题id", "维度id", "维度名称", "维度组名称", "维度标题"]),
    (4, "维度映射关系", ["1", "Q1", "D1", "dim1", "组", "高"]), (4, "维度映射关系", ["1", "Q1", "D2", "dim2", "组", "低"]),
    (4, "维度映射关系", ["9", "Q9", "D9", "dim9", "组", "其他"]),
    (5, "1", ["", ""]), (5, "1", ["字段取值", "用户维度", "学校维度", "区域维度", "年级维度", "字段id", "维度id", "状态"]),
    (6, "2", ["字段取值", "用户维度", "学校维度"]), (7, "5", ["字段取值", "用户维度"]),
]


def cells(spark, sf):
    """The raw cells table."""
    t = {n: B.table(spark, sf, n) for n in ("region", "nation", "customer", "orders", "supplier", "part")}
    fixed_rows, seen = [], {}
    for index, sheet, values in FIXED_ROWS:
        seen[sheet] = seen.get(sheet, 0) + 1
        fixed_rows.append((index, sheet, seen[sheet], values))
    fixed = small_table(spark, fixed_rows, "sheet_index int, sheet string, row_index bigint, values array<string>")
    region = t["region"].withColumn("source_file", _file())
    semester = F.when(F.col("r_regionkey") < 2, F.lit("2024下")).otherwise(F.lit("2024上"))
    filled_in = lambda v: F.replace(F.replace(v, F.lit("{region}"), F.col("r_name")), F.lit("{semester}"), semester)
    parts = [
        region.withColumn("_fixed", F.explode(_listed(fixed))).select("*", "_fixed.*").select(
            "source_file", "sheet_index", "sheet", "row_index", F.transform("values", filled_in).alias("values")),
    ]
    places = t["nation"].join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    people = t["customer"].join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].join(people, F.col("o_custkey") == F.col("c_custkey"))
    dimension = F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), F.lit("D1")).when(
        F.left("o_orderpriority", F.lit(1)) == "3", F.lit("D2")).otherwise(F.lit(""))
    answer = [F.col("o_orderpriority"), F.concat(F.lit(" "), F.col("c_custkey")), F.col("n_name"), F.col("r_name"),
              F.year("o_orderdate"), F.col("o_orderstatus"), dimension]
    row = _row(orders, F.col("source_file"), 5, "1", F.col("o_orderkey") + 3, *answer, "有效")
    short = F.col("values")[5] == "P"
    parts.append(row.withColumn("values", F.when(short, F.slice("values", 1, 7)).otherwise(F.col("values"))))
    owes = F.col("c_acctbal") < 0
    filled = lambda c: F.when(owes, F.lit("")).otherwise(c.cast("string"))
    parts += [
        _row(people, F.col("source_file"), 6, "2", F.col("c_custkey") + 2, filled(F.floor("c_acctbal")),
             filled(F.col("c_custkey")), filled(F.col("n_name"))),
        _row(t["supplier"].join(places, F.col("s_nationkey") == F.col("n_nationkey")), F.col("source_file"), 7, "5",
             F.col("s_suppkey") + 2, F.col("s_name"), F.col("s_suppkey")),
        small_table(spark, [("parts_wide.xlsx", 1, "Sheet1", 1, ["用户维度", "1", "2", "备注"])], CELLS),
        _row(t["part"], "parts_wide.xlsx", 1, "Sheet1", F.col("p_partkey") + 2, F.col("p_partkey"), F.col("p_brand"),
             F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.col("p_size").cast("string")), F.col("p_name")),
        _row(t["nation"], "notes.xlsx", 1, "notes", F.col("n_nationkey") + 1, F.col("n_name")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def clean(spark, sf):
    return C.clean_cells(cells(spark, sf))


def stored(spark, sf):
    """The clean cells as a table: the sheets' headers, titles and rows are all read from it,
    and none of the reads makes the cells anew."""
    return cut_lineage(clean(spark, sf))


FILE_SQL = "'[课程监测][' || r_name || '学科课程实施情况表（学生）][2024下][F' || r_regionkey || '].xlsx'"
PEOPLE_SQL = f"""files AS (SELECT r_regionkey, r_name, {FILE_SQL} AS source_file FROM region),
places AS (SELECT * FROM nation JOIN files ON n_regionkey = r_regionkey),
people AS (SELECT * FROM customer JOIN places ON c_nationkey = n_nationkey),
answers AS (SELECT * FROM orders JOIN people ON o_custkey = c_custkey),
sellers AS (SELECT * FROM supplier JOIN places ON s_nationkey = n_nationkey)"""


@query("layout_detect", f"""WITH {PEOPLE_SQL}
SELECT source_file, true AS has_front_page, true AS has_type_stats, 3::BIGINT AS numbered_sheets,
       2::BIGINT AS first_row_fields, 'split_question_workbook' AS workbook_type FROM files
UNION ALL SELECT 'parts_wide.xlsx', false, false, 0, 4, 'wide_table' FROM (SELECT count(*) FROM part)
UNION ALL SELECT 'notes.xlsx', false, false, 0, 1, 'unknown' FROM (SELECT count(*) FROM nation)""")
def layout_detect(spark, sf):
    return C.detect_layouts(clean(spark, sf))


@query("front_page_map", f"""WITH {PEOPLE_SQL}, pages AS (
  SELECT source_file, unnest([1, 2, 3, 4, 6]) AS row_index, unnest(['项目名称', '学科', '学期', '学期', '区域维度']) AS key,
         unnest(['课程监测', r_name, '2023上', CASE WHEN r_regionkey < 2 THEN '2024下' ELSE '2024上' END, r_name]) AS value
  FROM files)
SELECT source_file, key, arg_max(value, row_index) AS value FROM pages GROUP BY source_file, key""")
def front_page_map(spark, sf):
    maps = C.front_page_maps(clean(spark, sf))
    return maps.select("source_file", F.explode("front_page").alias("key", "value"))


ROWS_SQL = f"""{PEOPLE_SQL}, answer_rows AS (
  SELECT source_file, r_name, r_regionkey, '1' AS question_no, o_orderkey + 3 AS source_row_index,
         o_orderpriority AS value, CAST(c_custkey AS VARCHAR) AS user_id, n_name AS school, r_name AS region,
         CAST(year(o_orderdate) AS VARCHAR) AS grade, o_orderstatus AS field_id,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'D1' WHEN o_orderpriority[1] = '3' THEN 'D2' ELSE '' END
           AS dimension_id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '有效' END AS status
  FROM answers
  UNION ALL
  SELECT source_file, r_name, r_regionkey, '2', c_custkey + 2, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR),
         CAST(c_custkey AS VARCHAR), n_name, '', '', '', '', '' FROM people WHERE c_acctbal >= 0
  UNION ALL
  SELECT source_file, r_name, r_regionkey, '5', s_suppkey + 2, s_name, CAST(s_suppkey AS VARCHAR), '', '', '', '', '', ''
  FROM sellers)"""


@query("split_to_facts", f"""WITH {ROWS_SQL}
SELECT source_file, question_no, question_no AS source_sheet, source_row_index, value AS field_value, user_id, school,
       region, grade, field_id, dimension_id, status FROM answer_rows""")
def split_to_facts(spark, sf):
    rows = answers.split_rows(stored(spark, sf))
    return rows.select(
        "source_file", "question_no", "source_sheet", "source_row_index", C.cell("字段取值").alias("field_value"),
        C.cell("用户维度").alias("user_id"), C.cell("学校维度").alias("school"), C.cell("区域维度").alias("region"),
        C.cell("年级维度").alias("grade"), C.cell("字段id").alias("field_id"), C.cell("维度id").alias("dimension_id"),
        C.cell("状态").alias("status"))


@query("wide_sheet_rows", """SELECT p_partkey + 2 AS source_row_index, unnest(['1', '2']) AS question_no,
  unnest([p_brand, CASE WHEN p_size < 10 THEN '' ELSE CAST(p_size AS VARCHAR) END]) AS field_value,
  CAST(p_partkey AS VARCHAR) AS user_id, p_name AS remark FROM part""")
def wide_sheet_rows(spark, sf):
    sheet = clean(spark, sf).filter(F.col("source_file") == "parts_wide.xlsx")
    return answers.wide_rows(sheet).select(
        "source_row_index", "question_no", C.cell("字段取值").alias("field_value"),
        C.cell("用户维度").alias("user_id"), C.cell("备注").alias("remark"))


TYPE_NUMBER = {"click": "1", "error": "2", "purchase": "3", "signup": "4", "view": "5"}
TYPE_NUMBER_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NUMBER.items()) + " END"


@query("wide_to_facts", f"""WITH t AS (SELECT user_id, {TYPE_NUMBER_SQL} AS q, count(*) AS n FROM events GROUP BY ALL)
SELECT u.user_id, q.question_no, t.n AS field_value FROM (SELECT DISTINCT user_id FROM events) u
CROSS JOIN (SELECT unnest(['1', '2', '3', '4', '5']) AS question_no) q
LEFT JOIN t ON t.user_id = u.user_id AND t.q = q.question_no""")
def wide_to_facts(spark, sf):
    from surveyloom.functions.values import recode
    events = B.table(spark, sf, "events").withColumn("q", recode(F.col("event_type"), TYPE_NUMBER))
    wide = events.groupBy("user_id").pivot("q", list(TYPE_NUMBER.values())).agg(F.count(F.lit(1)))
    return answers.unpivot_wide(wide, ["user_id"])


def mapping(spark, sf):
    """Question mapping per subject; question 1 has two rows and the last counts."""
    region = B.table(spark, sf, "region")
    rows = [(1, "OLD0001", "1", "教师", "单选题", "旧题", "旧题"), (2, "QG0001", "1", "学生", "单选题", "优先级", "订单优先级"),
            (3, "QG0002", "2", "学生", "填空题", "余额", "")]
    fixed = small_table(spark, rows, "ord int, norm_id string, q_no string, role string, question_type string,"
                                     " question_text string, canonical_question string")
    return region.select(F.col("r_name").alias("subject"), F.explode(_listed(fixed)).alias("_fixed")).select("subject", "_fixed.*")


def facts(spark, sf, raw=None):
    """``raw``: the ``stored`` cells, where the caller reads them too."""
    raw = stored(spark, sf) if raw is None else raw
    titles, _ = answers.parse_titles(raw.select("source_file").distinct())
    return answers.build_facts(answers.split_rows(raw), titles, mapping(spark, sf), answers.components_of(raw))


COMPONENTS_SQL = """components AS (
  SELECT files.*, c.* FROM files CROSS JOIN (VALUES
    ('1', 'Q1', 'F', 'status_f', '已完成', 'D1', 'dim1', '组', '高', 'Q1:F:D1', 'option', '已完成'),
    ('1', 'Q1', 'F', 'status_f', '已完成', 'D2', 'dim2', '组', '低', 'Q1:F:D2', 'option', '已完成'),
    ('1', 'Q1', 'O', 'status_o', '进行中', 'D1', 'dim1', '组', '高', 'Q1:O:D1', 'option', '进行中'),
    ('1', 'Q1', 'O', 'status_o', '进行中', 'D2', 'dim2', '组', '低', 'Q1:O:D2', 'option', '进行中'),
    ('2', 'Q2', 'S', 'upload_file', '余额', '', '', '', '', 'Q2:S', 'upload', '余额'),
    ('9', 'Q9', '', '', '', 'D9', 'dim9', '组', '其他', 'Q9:D9', 'matrix_row', '其他'))
  c(question_no, question_id, field_id, field_name, field_title, dimension_id, dimension_name, dimension_group_name,
    dimension_title, answer_component_id, answer_component_type, answer_component_label))"""
FACTS_SQL = f"""WITH {ROWS_SQL}, {COMPONENTS_SQL},
picked AS (
  SELECT a.*, CASE WHEN question_no = '1' AND field_id IN ('F', 'O')
                     THEN 'Q1:' || field_id || ':' || CASE WHEN dimension_id = '' THEN 'D1' ELSE dimension_id END
                   WHEN question_no = '2' THEN 'Q2:S' END AS cid
  FROM answer_rows a),
hashed AS (
  SELECT p.source_file, p.r_name AS subject, '学生' AS role, p.question_no, p.source_row_index, p.value, p.user_id,
         p.school, p.region, p.grade, p.status,
         coalesce(c.field_id, p.field_id) AS field_id,
         coalesce(nullif(c.dimension_id, ''), p.dimension_id) AS dimension_id,
         coalesce(c.answer_component_id, '') AS cid, coalesce(c.answer_component_type, '') AS ctype,
         coalesce(c.answer_component_label, '') AS clabel,
         coalesce(c.dimension_name, '') AS dimension_name, coalesce(c.dimension_title, '') AS dimension_title,
         coalesce(c.field_name, '') AS field_name, coalesce(c.field_title, '') AS field_title,
         coalesce(c.dimension_group_name, '') AS dimension_group_name,
         '学生|' || p.r_name || '|' || p.question_no AS local_key,
         'ds_' || substr(sha1('课程监测|学生|' || p.r_name || '|2024下|F' || p.r_regionkey), 1, 12) AS dataset_id
  FROM picked p LEFT JOIN components c ON c.source_file = p.source_file AND c.answer_component_id = p.cid),
facts AS (
  SELECT *, 'f_' || substr(sha1(concat_ws('|', dataset_id, question_no, source_row_index, local_key, cid, field_id, user_id)), 1, 16)
            AS fact_id,
         CASE question_no WHEN '1' THEN 'QG0001' WHEN '2' THEN 'QG0002' ELSE local_key END AS norm_id,
         CASE question_no WHEN '1' THEN '单选题' WHEN '2' THEN '填空题' ELSE '' END AS question_type,
         CASE question_no WHEN '1' THEN '优先级' WHEN '2' THEN '余额' ELSE '' END AS question_text,
         CASE question_no WHEN '1' THEN '订单优先级' ELSE '' END AS canonical_question
  FROM hashed)"""


@query("facts_with_lookup", FACTS_SQL + """
SELECT fact_id, dataset_id, role, subject, question_no, local_key AS local_question_key, norm_id, question_type,
       canonical_question, cid AS answer_component_id, value AS field_value, field_id, dimension_id, dimension_name,
       user_id, school, '2024下' AS semester, source_file, source_row_index FROM facts""")
def facts_with_lookup(spark, sf):
    return facts(spark, sf).select(
        "fact_id", "dataset_id", "role", "subject", "question_no", "local_question_key", "norm_id", "question_type",
        "canonical_question", "answer_component_id", "field_value", "field_id", "dimension_id", "dimension_name",
        "user_id", "school", "semester", "source_file", "source_row_index")


@query("unmatched_checks", f"""WITH {ROWS_SQL}
SELECT 'unmatched_question' AS check_type, 'warning' AS severity, question_no AS source_sheet, source_row_index,
       '学生|' || r_name || '|5' AS local_question_key,
       'Question not found in normalized questionnaire mapping.' AS message FROM answer_rows WHERE question_no = '5'""")
def unmatched_checks(spark, sf):
    return answers.unmatched_checks(facts(spark, sf))


@query("component_build", f"""WITH {PEOPLE_SQL}, {COMPONENTS_SQL} SELECT * EXCLUDE (r_name, r_regionkey) FROM components""")
def component_build(spark, sf):
    return answers.components_of(stored(spark, sf)).drop("ord")


@query("component_lookup", FACTS_SQL + """
SELECT source_file, question_no, source_row_index, cid AS answer_component_id, ctype AS answer_component_type,
       clabel AS answer_component_label FROM facts""")
def component_lookup(spark, sf):
    raw = stored(spark, sf)
    rows = answers.split_rows(raw).withColumns({
        "row_field_id": C.cell("字段id"), "row_dimension_id": C.cell("维度id")})
    found = answers.match_components(rows, answers.components_of(raw))
    return found.select("source_file", "question_no", "source_row_index", *[
        F.coalesce(F.col(f"component.{c}"), F.lit("")).alias(c)
        for c in ("answer_component_id", "answer_component_type", "answer_component_label")])


@query("question_table", FACTS_SQL + """
SELECT DISTINCT 'question' AS entity_type, local_key AS local_question_key, dataset_id, role, subject, question_no,
  norm_id, question_type, question_text, canonical_question,
  coalesce(nullif(canonical_question, ''), nullif(question_text, ''), local_key) AS display_title,
  '' AS answer_component_id, '' AS answer_component_type, '' AS answer_component_label, '' AS field_id,
  '' AS field_name, '' AS field_title, '' AS dimension_id, '' AS dimension_name, '' AS dimension_group_name,
  '' AS dimension_title, norm_id AS join_key, '' AS option_order FROM facts
UNION ALL
SELECT DISTINCT 'answer_component', local_key, dataset_id, role, subject, question_no, norm_id, question_type,
  question_text, canonical_question, clabel, cid, ctype, clabel, field_id, field_name, field_title,
  CASE WHEN cid = 'Q2:S' THEN '' ELSE split_part(cid, ':', 3) END, dimension_name, dimension_group_name,
  dimension_title, norm_id || '|' || cid, CASE WHEN question_no = '2' THEN '1' ELSE '' END
FROM facts WHERE cid <> ''""")
def question_table(spark, sf):
    return answers.question_table(facts(spark, sf))


@query("title_conflicts", f"""WITH {PEOPLE_SQL}
SELECT 'warning' AS severity, 'title_metadata_conflict' AS issue, source_file, 'semester' AS field,
       '2024下' AS filename_value, '2024上' AS front_page_value, false AS blocking FROM files WHERE r_regionkey >= 2""")
def title_conflicts(spark, sf):
    return conflicts_of(stored(spark, sf))


def conflicts_of(raw):
    titles, _ = answers.parse_titles(raw.select("source_file").distinct())
    page = lambda k: F.coalesce(F.try_element_at("front_page", F.lit(k)), F.lit(""))
    pages = C.front_page_maps(raw).select(
        "source_file", page("项目名称").alias("project_name"), page("学科").alias("subject"), page("学期").alias("semester"))
    return answers.title_conflicts(titles, pages)


@query("title_parts", f"""WITH {PEOPLE_SQL}
SELECT source_file, '课程监测' AS project_name, r_name || '学科课程实施情况表（学生）' AS form_title, '2024下' AS semester,
       'F' || r_regionkey AS form_id, r_name AS subject, '学生' AS role, '' AS issue FROM files
UNION ALL SELECT unnest(['parts_wide.xlsx', 'notes.xlsx']), '', '', '', '', '', '', 'title_parts' FROM (SELECT count(*) FROM part)""")
def title_parts(spark, sf):
    titles, checks = answers.parse_titles(clean(spark, sf).select("source_file").distinct())
    columns = ["project_name", "form_title", "semester", "form_id", "subject", "role"]
    good = titles.select("source_file", *columns, F.lit("").alias("issue"))
    bad = checks.select(F.col("key").alias("source_file"), *[F.lit("").alias(c) for c in columns],
                        F.col("check_type").alias("issue"))
    return good.unionByName(bad)


#: Subject word of a form by market segment; others stand for themselves.
FORM_SUBJECTS = {"AUTOMOBILE": "生物", "BUILDING": "数学", "FURNITURE": "体育与健康", "MACHINERY": "学校"}
_SUBJECT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORM_SUBJECTS.items()) + " ELSE c_mktsegment END"


@query("heading_subjects", f"""WITH h AS (SELECT c_custkey, c_name, n_regionkey AS r, {_SUBJECT_SQL} AS s FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN r = 4 OR s = '学校' THEN c_name WHEN s = '生物' THEN '生物学' ELSE s END AS subject,
  CASE r WHEN 0 THEN '学生' WHEN 1 THEN '教师' WHEN 2 THEN '教研组' WHEN 3 THEN CASE WHEN s = '学校' THEN '学校' ELSE '' END ELSE '' END AS role FROM h""")
def heading_subjects(spark, sf):
    """Customers as forms whose first line names subject and role in the wording of their region; one region's are blank."""
    segment = F.col("c_mktsegment")
    subject = segment
    for k, v in FORM_SUBJECTS.items():
        subject = F.when(segment == k, F.lit(v)).otherwise(subject)
    wordings = ["高中{}学科课程实施与教材使用情况表（学生）", " {}教师课程实施与教材使用情况表", "{}教研组课程实施与教材使用情况表", "{}学科课程实施情况表 ", " 　"]
    heading = F.lit(None).cast("string")
    for region, words in enumerate(wordings):
        heading = F.when(F.col("n_regionkey") == region, F.replace(F.lit(words), F.lit("{}"), subject)).otherwise(heading)
    forms = B.table(spark, sf, "customer").join(B.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return forms.select("c_custkey", text.heading_parts(heading, F.col("c_name")).alias("_h")).select("c_custkey", "_h.*")


@query("two_source_full_join", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, d.n_chars, l.quality AS quality_label,
       CASE WHEN d.doc_id IS NOT NULL THEN d.n_chars % 2 END AS quality_text, l.toxic,
       CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side
FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""")
def two_source_full_join(spark, sf):
    left = B.table(spark, sf, "documents").select(
        F.concat(F.lit("S"), "doc_id").alias("account"), "doc_id", "lang", "n_chars",
        (F.col("n_chars") % 2).alias("quality"), F.lit(True).alias("in_left"))
    right = B.table(spark, sf, "labels").select(
        F.concat(F.lit("P"), "doc_id").alias("account"), "quality", "toxic", F.lit(True).alias("in_right"))
    left = left.withColumn("account", answers.drop_prefix(F.col("account"), "S")).drop("doc_id")
    right = right.withColumn("account", answers.drop_prefix(F.col("account"), "P"))
    joined = answers.join_two_sources(left, right, ["account"], ("_text", "_label"))
    side = F.when(F.col("in_left").isNull(), "right").when(F.col("in_right").isNull(), "left").otherwise("both")
    return joined.select(F.col("account").cast("bigint").alias("doc_id"), "lang", "n_chars", "quality_label",
                         "quality_text", "toxic", side.alias("side"))


@query("clean_export", """
SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS subject, CASE WHEN value > 10 THEN '1' ELSE '0' END AS field_value,
       CASE WHEN event_type = 'error' AND value > 10 THEN '其他' WHEN event_type = 'error' THEN '其他，说明' ELSE event_type END
         AS alternative, trim(props) AS props FROM events""")
def clean_export(spark, sf):
    exported = B.table(spark, sf, "events").select(
        F.col("event_id").alias("问题id"), F.col("ts").alias("状态"), F.col("user_id").cast("string").alias("用户维度"),
        F.col("event_type").alias("学科维度"), F.when(F.col("value") > 10, "1").otherwise("0").alias("field value"),
        F.when(F.col("event_type") == "error", F.lit("其他，说明")).otherwise(F.col("event_type")).alias("映射表-字段标题"),
        F.concat(F.lit('xml:space="preserve">  '), F.col("props"), F.lit('xml:space="preserve" ')).alias(" pro ps "))
    named = answers.clean_names(exported).withColumnRenamed("fieldvalue", "field_value")
    shaped = answers.reshape_export(
        named, ["问题id", "状态"], {"用户维度": "user_id", "学科维度": "subject", "映射表-字段标题": "alternative"},
        "field_value", "alternative")
    return answers.clean_strings(shaped, ["props"])


@query("csv_json_roundtrip", """SELECT doc_id, lang, source, text, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_json_roundtrip(spark, sf):
    from surveyloom.sources import files
    df = B.table(spark, sf, "documents")
    folder = files.scratch_folder(spark)
    files.write_csv(df, f"{folder}/csv", ["doc_id", "lang", "source", "n_chars"])
    files.write_json(df.select("doc_id", "text"), f"{folder}/json")
    back = files.read_csv(spark, f"{folder}/csv", ["doc_id", "lang", "source", "n_chars"])
    texts = files.read_json(spark, f"{folder}/json", "doc_id bigint, text string")
    return back.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(texts, "doc_id")
