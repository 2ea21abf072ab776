"""Small tables with known results."""

import hashlib
import pytest
from pyspark.sql import functions as F

from surveyloom.functions import ids, text, values
from surveyloom.operators import answers, charts, indicators, metrics, questions as Q, recoding, rules
from surveyloom.sources import cells as C, files
from surveyloom.sources.local import small_table

FACT = ("fact_id string, ord bigint, user_id string, school string, label string, value string, norm_id string, kind string,"
        " dimension string, component string")


def facts(spark, rows):
    full = [(f"f{i}", i, *r) if len(r) == 8 else (f"f{i}", i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows, 1)]
    df = small_table(spark, full, FACT)
    lit = lambda v: F.lit(v)
    return df.select(
        "fact_id", "ord", "user_id", "school", lit("教师").alias("role"), lit("历史").alias("subject"), lit("一区").alias("region"),
        lit("七年级").alias("grade"), lit("2024下").alias("semester"), "norm_id", F.coalesce("kind", lit("单选题")).alias("question_type"),
        F.coalesce("component", "label").alias("answer_component_id"), F.col("label").alias("answer_component_label"),
        F.col("value").alias("field_value"), F.col("value").alias("raw_value"), lit("").alias("field_id"), lit("").alias("dimension_id"),
        F.col("dimension").alias("dimension_name"), lit(None).cast("string").alias("dimension_title"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_respondents_and_shares(spark):
    f = facts(spark, [("U1", "一中", "同意", "1", "Q"), ("U2", "一中", "同意", "1", "Q"), ("U3", "一中", "不同意", "1", "Q"),
                      ("U4", "二中", "同意", "1", "Q"), ("U1", "一中", "同意", "1", "Q"), ("U9", "一中", "同意", "1", "")])
    assert rows(metrics.response_count(f), "school", "count") == [("一中", 3), ("二中", 1)]
    assert rows(metrics.option_summary(f), "school", "category", "count", "denominator", "percent") == [
        ("一中", "不同意", 1, 3, 0.333333), ("一中", "同意", 2, 3, 0.666667), ("二中", "同意", 1, 1, 1.0)]


def test_categories_without_label_and_without_user(spark):
    f = facts(spark, [("U1", "一中", None, "是", "Q"), ("", "一中", "", "否", "Q"), (None, "一中", "", "否", "Q"), ("U2", "一中", "", "", "Q")])
    assert rows(metrics.option_summary(f), "category", "count", "denominator") == [("否", 2, 2), ("是", 1, 2)]


def test_selected_only(spark):
    f = facts(spark, [("U1", "一中", "A", "1", "Q"), ("U2", "一中", "A", " 0 ", "Q"), ("U3", "一中", "A", "FALSE", "Q"), ("U3", "一中", "B", "未选", "Q")])
    assert rows(metrics.option_summary(f, selected_only=True), "category", "count", "denominator") == [("A", 2, 3)]


def test_numeric_upload_matrix(spark):
    f = facts(spark, [
        ("U1", "一中", None, "12", "N", "填空题"), ("U2", "一中", None, " 18 ", "N", "填空题"), ("U3", "一中", None, "1_0", "N", "填空题"),
        ("U4", "一中", None, "inf", "N", "填空题"), ("U1", "二中", None, "7", "N", "填空题"), ("U1", "三中", None, "x", "N", "填空题"),
        ("U1", "一中", None, "材料.docx", "U", "上传题"), ("U2", "一中", None, "", "U", "上传题"),
        ("U1", "一中", "目标清晰", "1", "M", "矩阵题", "课堂评价"), ("U1", "一中", "目标清晰", "1", "M", "矩阵题", "课堂评价"),
        ("U2", "一中", "目标清晰", "1", "", "表格组合题", "课堂评价")])
    assert rows(metrics.numeric_summary(f), "school", "mean", "sd", "n") == [("一中", 15.0, 3.0, 2), ("二中", 7.0, 0.0, 1)]
    assert rows(metrics.upload_summary(f), "count", "denominator", "percent") == [(1, 2, 0.5)]
    assert rows(metrics.matrix_summary(f), "norm_id", "category", "series", "count", "n") == [
        ("", "课堂评价", "目标清晰", 1, 1), ("M", "课堂评价", "目标清晰", 2, 1)]
    assert rows(metrics.matrix_summary(f, ["矩阵题", "量表题"]), "norm_id") == [("M",)]


RULE = ("rule_id string, source_norm_ids_json string, target_indicator_id string, target_indicator_name string, transform_type string,"
        " group_by_json string, value_mapping_json string, output_grain string, output_value_type string")


def rule(spark, *rs):
    return indicators.parse_rules(small_table(spark, rs, RULE))


def test_scale_score_and_ids(spark):
    f = facts(spark, [("U001", "一中", None, "非常符合", "Q"), ("U001", "一中", None, "比较符合", "Q"), ("U002", "二中", None, "比较符合", "Q"),
                      ("U003", "二中", None, "其他", "Q")])
    typed, issues = rule(spark, ("scale_001", '["Q"]', "IND_SCALE", "量表", "scale_score", '["user_id"]', '{"非常符合": 5, "比较符合": 4}', "user", "score"))
    built = indicators.rebuild_indicators(f, typed, source_ids=True)
    assert issues.count() == 0
    assert rows(built, "user_id", "school", "indicator_value") == [("U001", "一中", 4.5), ("U002", "二中", 4.0)]
    own = {r.fact_id for r in f.filter("user_id = 'U001'").collect()}
    digest = f"{len(own)}:{sum(int(hashlib.md5(i.encode()).hexdigest()[:15], 16) for i in own)}"
    assert rows(built.filter("user_id = 'U001'"), "source_digest", "recon_id") == [
        (digest, "r_" + hashlib.sha1(f"scale_001|IND_SCALE|user|U001|{digest}".encode()).hexdigest()[:16])]
    assert rows(metrics.indicator_values(built), "category", "mean", "n") == [("量表", 4.0, 1), ("量表", 4.5, 1)]


def test_coverage_stars_and_empty_lists(spark):
    f = facts(spark, [("U001", "一中", "A", "已选", "Q"), ("U001", "一中", "B", "已选", "Q"), ("U002", "一中", "A", "", "P")])
    typed, _ = rule(
        spark, ("all", '["*", "Q"]', "I", "n", "multi_select_coverage", '["school"]', "", "school", "ratio"),
        ("none", "[]", "I", "n", "multi_select_coverage", '["school"]', "", "school", "ratio"),
        ("whole", '["Q"]', "I", "n", "multi_select_coverage", "[]", "", "", "ratio"))
    built = indicators.rebuild_indicators(f, typed)
    assert rows(built, "source_rule_id", "indicator_value", "indicator_value_label", "source_rows") == [("all", 1.0, "2/2", 3), ("whole", 1.0, "2/2", 2)]


def test_malformed_rules_are_reported(spark):
    typed, issues = rule(spark, ("bad", '["Q"', "I", "n", "scale_score", "[]", "{}", "", ""), ("worse", "{}", "I", "n", "scale_score", "[]", "[1]", "", ""),
                         ("fine", "", "I", "n", "scale_score", "", "", "", ""))
    assert rows(typed, "rule_id") == [("fine",)]
    assert {(r.key, r.message.split()[0]) for r in issues.collect()} == {
        ("bad", "source_norm_ids_json"), ("worse", "source_norm_ids_json"), ("worse", "value_mapping_json")}


@pytest.mark.parametrize("n", [1, 5, 400])
def test_indicator_ids_follow_the_set_of_facts_only(spark, n):
    listed = [("U1", "一中", None, "a", "Q")] * n + [("U2", "二中", None, "a", "Q")]
    typed, _ = rule(spark, ("r", '["Q"]', "I", "n", "scale_score", '["school"]', '{"a": 1}', "school", ""))
    of = lambda f: {r.school: r.recon_id for r in indicators.rebuild_indicators(f, typed, source_ids=True).collect()}
    f = facts(spark, listed)
    once, again = of(f), of(f.orderBy(f["ord"].desc()))
    more = of(facts(spark, [*listed, ("U1", "二中", None, "a", "Q")]))
    assert once == again and once["一中"] != once["二中"]
    assert more["二中"] != once["二中"]


def test_hashed_keys(spark):
    l = F.lit  # noqa: E741
    got = one(
        spark, ids.dataset_id(l("课程实施监测"), l("教师"), l("历史"), l("2024下"), l("FORM1")).alias("d"),
        ids.fact_id(l("ds_e6e2e04ff156"), l("1"), l(2), l("教师|历史|1"), l("Q1:F1:D1"), l("F1"), l("U001")).alias("f"),
        ids.metric_id(l("response_count"), ids.scope_json("school", l("一中")), l("QG0001"), l(""), l("respondents"), l(""), l("")).alias("m"))
    assert got == ("ds_e6e2e04ff156", "f_c11f5b0a2027fdd6", "m_72f54d37133755da")


CELLS = "source_file string, sheet_index int, sheet string, row_index bigint, values array<string>"
NAME = "[课程实施监测][历史学科课程实施情况表（教师）][2024下][FORM1].xlsx"


def workbook(spark, sheets):
    listed = [(NAME, i, name, n, row) for i, (name, body) in enumerate(sheets, 1) for n, row in enumerate(body, 1)]
    return C.clean_cells(small_table(spark, listed, CELLS))


MAPPING = "ord int, norm_id string, subject string, q_no string, role string, question_type string, question_text string, canonical_question string"


def mapping(spark):
    return small_table(spark, [(1, "QG0001", "历史", "1", "教师", "单选题", "是否使用新教材", ""), (2, "QG0054", "语文", "54", "学生", "上传题", "", "")], MAPPING)


def test_split_workbook(spark):
    head = ["问题id", "字段id", "字段名称", "字段取值", "维度id", "维度名称", "学科维度", "年级维度", "学期维度", "学校维度", "区域维度", "用户维度", "状态"]
    book = workbook(spark, [
        ("首页", [["项目名称", "课程实施监测"], ["", "x"], ["单格"]]),
        ("1", [["", ""], head, ["Q1", "F1", "field_1", "1", "D1", "dim_1", "历史", "七年级", "2024下", "第一中学", "一区", "U001", "有效"], ["", None]]),
        ("99", [["字段取值", "用户维度"], ["未知答案", "U099"]]),
        ("字段映射关系", [["题号", "题id", "字段id", "字段名称", "字段标题"], ["1", "Q1", "F1", "field_1", "同意"], ["3", "Q3", "F3", "upload_file", "课堂学习评价材料"]]),
        ("维度映射关系", [["题号", "题id", "维度id", "维度名称", "维度组名称", "维度标题"], ["1", "Q1", "D1", "dim_1", "态度", "态度维度"]]),
    ])
    parts = answers.components_of(book)
    assert rows(parts, "answer_component_id", "answer_component_type", "answer_component_label") == [
        ("Q1:F1:D1", "option", "同意"), ("Q3:F3", "upload", "课堂学习评价材料")]
    titles, bad = answers.parse_titles(book.select("source_file").distinct())
    assert bad.count() == 0 and rows(titles, "subject", "role", "form_id") == [("历史", "教师", "FORM1")]
    built = answers.build_facts(answers.split_rows(book), titles, mapping(spark), parts)
    assert rows(built, "question_no", "norm_id", "answer_component_id", "answer_component_label", "source_row_index", "school") == [
        ("1", "QG0001", "Q1:F1:D1", "同意", 3, "第一中学"), ("99", "教师|历史|99", "", "", 2, "")]
    table = answers.question_table(built)
    assert rows(table, "entity_type", "join_key", "display_title", "option_order") == [
        ("answer_component", "QG0001|Q1:F1:D1", "同意", "1"), ("question", "QG0001", "是否使用新教材", ""), ("question", "教师|历史|99", "教师|历史|99", "")]
    assert rows(answers.unmatched_checks(built), "source_sheet", "local_question_key") == [("99", "教师|历史|99")]
    assert rows(C.detect_layouts(book), "workbook_type", "numbered_sheets") == [("wide_table", 2)]


def test_wide_workbook_and_layouts(spark):
    book = workbook(spark, [("首页", [["项目名称", "x"]]), ("Sheet1", [["用户维度", "学校维度", "区域维度", "1", "２"], ["U003", "第三中学", "三区", "是", "否"], ["U004", "四中", "", "", ""]])])
    got = answers.wide_rows(book).select("question_no", "source_sheet", "source_row_index", C.cell("字段取值").alias("v"), C.cell("用户维度").alias("u"))
    assert rows(got, "question_no", "source_sheet", "source_row_index", "v", "u") == [("1", "Sheet1", 2, "是", "U003"), ("1", "Sheet1", 3, "", "U004")]
    front = workbook(spark, [("首页", [["项目名称", "x"], ["学期维度", "旧"], ["学期维度", "新"]]), ("题型统计", [["题号", "题型"], ["1", "单选题"]]), ("1", [["字段取值"]])])
    assert rows(C.detect_layouts(front), "workbook_type") == [("split_question_workbook",)]
    assert rows(C.front_page_maps(front), "scope.学期维度", "scope.用户维度") == [("新", "")]
    assert rows(C.question_types(front), "question_no", "question_type") == [("1", "单选题")]


@pytest.mark.parametrize("title, subject, role", [
    ("地理学科课程实施与教材使用情况表（教师）", "地理", "教师"), ("化学学科课程实施情况表(教研组)", "化学", "教研组"),
    ("数学学科课程实施与教材使用情况表（学生）", "数学", "学生"), ("学校课程实施情况表", "学校", "学校"), ("情况", "情况", "")])
def test_titles(spark, title, subject, role):
    df = small_table(spark, [(f"a/[p][ {title} ][2024下][F1].xlsx",)], "source_file string")
    assert rows(answers.parse_titles(df)[0], "subject", "role", "project_name") == [(subject, role, "p")]


def test_title_checks(spark):
    df = small_table(spark, [("无括号.xlsx",)], "source_file string")
    good, bad = answers.parse_titles(df)
    assert good.count() == 0 and rows(bad, "severity", "key") == [("error", "无括号.xlsx")]
    left = small_table(spark, [("f", "地理", "教师", "")], "source_file string, subject string, role string, semester string")
    right = small_table(spark, [("f", "历史", " 教师 ", "2024")], "source_file string, subject string, role string, semester string")
    assert rows(answers.title_conflicts(left, right), "field", "filename_value", "front_page_value") == [("subject", "地理", "历史")]


def test_question_lines(spark):
    c = text.compact_text(F.lit("＊1． 你喜欢本学科课程吗？[单选题]"))
    is_header, number, kind, body, required = Q.header_parts(c)
    assert one(spark, is_header.alias("a"), number.alias("b"), kind.alias("c"), body.alias("d"), required.alias("e")) == (True, 1, "单选题", "你喜欢本学科课程吗?", True)
    assert one(spark, text.text_key(text.compact_text(F.lit("2、您所在校 其它　Ａ [[多选题]]："))).alias("k")) == ("学校其他A",)
    assert one(spark, text.component_key(text.compact_text(F.lit("其它：*____"))).alias("k")) == ("其他",)
    assert one(spark, text.blank_count(F.lit("a__b*＿＿c_d")).alias("n")) == (2,)
    d = text.dependency(F.lit("关联题目：当且仅当第12题选项3、选项 1、选项3被选中时需要作答"))
    assert one(spark, d["depends_on_q_no"].alias("q"), d["depends_on_option_orders"].alias("o"), d["dependency_required"].alias("r"), d["dependency_logic"].alias("l")) == (12, [1, 3], True, "当且仅当")
    assert one(spark, text.contrast_tokens(F.lit("选择性必修课程"), [["选择性必修", "必修"], ["盟市", "学校"]]).alias("t")) == (["选择性必修", None],)
    assert one(spark, text.char_grams(F.lit("𝒜bc")).alias("g"), text.char_grams(F.lit("a")).alias("h")) == (["𝒜b", "bc", "𝒜bc"], [])


def test_form_segmentation_and_components(spark):
    lines = [(1, "标题"), (2, "*1. 喜欢吗？[单选题]"), (3, "关联题目：2题选项1"), (4, "填写说明：x"), (5, "[1] 喜欢"), (6, "[2] 其他*__"), (7, "2. 备注[上传题]"), (8, "上传限制：1个")]
    df = small_table(spark, [("f", i, t) for i, t in lines], "source_file string, block_index bigint, text string")
    is_header, number, kind, body, required = Q.header_parts(F.col("text"))
    seg = Q.segment_blocks(df.withColumns({"h": is_header, "kind": kind, "q_no": number}), F.col("h"))
    assert rows(seg, "block_index", "question_no")[0] == (2, 1) and seg.count() == 7
    heads = seg.filter("h").select("question_no", F.col("kind").alias("question_type"))
    parts = Q.line_components(seg.filter("NOT h").join(heads, "question_no"))
    assert rows(parts, "question_no", "component_type", "component_label", "option_order") == [
        (1, "option", "[1] 喜欢", 1), (1, "option", "[2] 其他*__", 2), (2, "upload", "上传组件", 1)]
    entry, needed = text.needs_text_entry(F.col("component_label"))
    assert rows(parts.withColumns({"e": entry, "n": needed}), "option_order", "component_type", "e", "n")[-1] == (2, "option", True, True)
    grid = small_table(spark, [("f", 1, "量表题", r, c, t) for r, c, t in ((0, 0, ""), (0, 1, "[5] 很好"), (0, 2, "一般"), (1, 0, "目标"), (1, 1, "x"))],
                       "source_file string, question_no bigint, question_type string, row_index bigint, col_index bigint, text string")
    assert rows(Q.table_components(grid), "component_type", "component_label", "component_value", "option_order") == [
        ("matrix_row", "目标", "目标", 1), ("option", "一般", "一般", 2), ("option", "很好", "5", 1)]


def test_option_relations(spark):
    sets = {1: "ab", 2: "ba", 3: "abc", 4: "abcd", 5: "axcd", 6: "xy", 7: "", 8: "z", 9: "aabb", 10: "abxyz"}
    parts = small_table(spark, [(i, "option", c, n) for i, s in sets.items() for n, c in enumerate(s, 1)], "idx bigint, component_type string, component_label string, option_order bigint")
    labelled = Q.with_labels(parts)
    want = {(1, 1): "identical", (1, 2): "same_items_order_diff", (1, 3): "add_or_missing_1_2", (4, 5): "changed_1_2", (1, 6): "completely_different",
            (7, 8): "add_or_missing_1_2", (7, 4): "completely_different", (1, 9): "add_or_missing_1_2", (1, 10): "partial_overlap", (7, 7): "identical"}
    pairs = small_table(spark, list(want), "idx_a bigint, idx_b bigint")
    deltas = Q.multiset_deltas(pairs, Q.label_counts(labelled))
    got = Q.option_relations(pairs, deltas, Q.signatures(labelled))
    assert {(r.idx_a, r.idx_b): r.option_relation for r in got.collect()} == want
    texts = {(r.idx_a, r.idx_b): (r.missing_text, r.extra_text) for r in Q.delta_texts(deltas, labelled).collect()}
    assert texts[(4, 5)] == ("选项: b", "选项: x") and texts[(1, 9)] == (None, "选项: a | b")


def test_report_rules_and_scopes(spark):
    schema = "report_rule_id string, norm_ids_or_indicator_ids string, chart_type string, filter_scope_json string, writing_metrics_json string"
    typed, issues = rules.parse_report_rules(small_table(spark, [
        ("rr_001", "QG0001, IND_SCALE,,", "mpl_pie", '{"school": ["一中"], "role": "教师", "x": 1}', '{"top_n": 2}'), ("rr_002", "", "?", "", ""),
        ("rr_003", "", "", "{not json}", "")], schema))
    assert rows(issues, "key", "message") == [("rr_003", "filter_scope_json must be a JSON object")]
    assert rows(typed, "report_rule_id", "ids", "top_n") == [("rr_001", ["QG0001", "IND_SCALE"], 2), ("rr_002", [], 1)]
    df = small_table(spark, [("一中", "教师"), ("一中", "学生"), ("二中", "教师")], "school string, role string")
    assert rows(rules.apply_scopes(df, typed), "report_rule_id", "school", "role") == [
        ("rr_001", "一中", "教师"), ("rr_002", "一中", "学生"), ("rr_002", "一中", "教师"), ("rr_002", "二中", "教师")]
    assert rows(charts.chart_checks(charts.resolve_chart_types(typed)), "rule_id", "check_type") == [
        ("rr_001", "table_preview_fallback"), ("rr_002", "table_preview_fallback"), ("rr_002", "unknown_chart_type")]


@pytest.mark.parametrize("value", [0.0, 0.0005, 0.00049, 0.0625, 0.1235, 0.1234565, 0.29, 0.3333333, 0.999499, 0.9995, 1.0, 3.655, 0.125, 0.0015])
def test_percent_text_rounds_the_binary_value(spark, value):
    assert one(spark, charts.percent_text(F.lit(value)).alias("t")) == (f"{value * 100:.1f}%",)


def test_value_functions(spark):
    l = F.lit  # noqa: E741
    assert one(spark, *[values.parse_number(l(t)).alias(f"a{i}") for i, t in enumerate(("1.5", " -2 ", "1d", "", ".5", "1e3", "inf", "NaN", "12."))]) == (
        1.5, -2.0, None, None, 0.5, 1000.0, None, None, 12.0)
    assert one(spark, values.leading_score(l("4(符合)")).alias("a"), values.leading_score(l("x")).alias("b")) == (4.0, None)
    assert one(spark, values.chosen_count(l("a|\r\n其他x|\r\n其他y|\r\n以上都没做过"), "以上都没做过").alias("n")) == (2,)
    hours = lambda *p: values.sleep_hours(*[l(float(x)) for x in p])
    assert one(spark, hours(6, 30, 10, 15).alias("a"), hours(7, 0, 12, 30).alias("b"), hours(7, 0, 13, 0).alias("c"), hours(2, 0, 1, 0).alias("d")) == (8.25, 6.5, None, None)


def test_value_labels_and_skip_logic(spark):
    labels = recoding.value_labels(small_table(spark, [("i", "a//C//b_______//C//c", "R"), ("k", "x//C//y", None)], "item string, options string, reverse string"))
    assert rows(labels, "item", "label", "code") == [("i", "a", 3), ("i", "b", 2), ("i", "c", 1), ("k", "x", 1), ("k", "y", 2)]
    df = small_table(spark, [("没有", "x", "y"), ("有", "x", "y"), (None, "x", "y")], "gate string, p string, q string")
    got = recoding.skip_logic(df, [("gate", ["没有"], "p", None), ("gate", ["没有"], "q", "本学期没有参加")])
    assert {tuple(r) for r in got.collect()} == {("没有", None, "本学期没有参加"), ("有", "x", "y"), (None, "x", "y")}


def test_csv_keeps_marks_quotes_and_lines(spark, tmp_path):
    df = small_table(spark, [("1", 'a "b",\nc', None), ("2", "", "d")], "id string, t string, u string")
    files.write_csv(df, str(tmp_path / "out"), ["id", "t", "u", "more"])
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "out").glob("*.csv"))
    for columns in (None, ["id", "t", "u", "more"]):
        assert rows(files.read_csv(spark, str(tmp_path / "out"), columns), "id", "t", "u", "more") == [("1", 'a "b",\nc', "", ""), ("2", "", "d", "")]
    (tmp_path / "out" / "~$x.csv").write_text("x")
    assert all(not r.name.startswith("~$") for r in files.find_files(spark, str(tmp_path), "*.csv").collect())


def test_csv_is_read_by_header_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n", encoding="utf-8")
    assert rows(files.read_csv(spark, str(tmp_path), ["a", "b"]), "a", "b") == [("2", "1")]
    assert rows(files.read_csv(spark, str(tmp_path), ["b"], multi_line=False), "b") == [("1",)]
    with pytest.raises(ValueError, match="c"):
        files.read_csv(spark, str(tmp_path), ["a", "c"])


def test_all_white_space_is_trimmed(spark):
    blank = C.clean_cells(small_table(spark, [("f", 1, "s", 1, ["　 \t", " x　", None, "a　b\r\n"])], CELLS))
    assert rows(blank, "values") == [(["", "x", "", "a　b"],)]
    chosen = one(spark, *[values.is_selected(F.lit(v)) for v in ("0\n", "否　", " ", "1\t")])
    assert chosen == (False, False, False, True)


def test_compaction_is_the_same_for_plain_and_other_texts(spark):
    got = one(spark, *[text.compact_text(F.lit(v)) for v in (" a\t b\n", "ＡＢ　c", "", "①")], text.compact_text(F.lit(None).cast("string")))
    assert got == ("a b", "AB c", "", "1", "")


def test_ten_thousand_rules_meet_as_by_plain_looks(spark):
    import random

    from surveyloom.operators.rules import SCOPE_FIELDS, apply_scopes
    rng = random.Random(6)
    value = lambda f: rng.choice(["", *(f"{f}{k}" for k in range(8))])
    facts = [(i, *(rng.choice([None, value(f)]) if f == "grade" else value(f) for f in SCOPE_FIELDS)) for i in range(300)]
    facts += [facts[0]] * 50
    scopes = [{f: [value(f) for _ in range(rng.randrange(1, 4))] for f in rng.sample(SCOPE_FIELDS, rng.choice([0, 1, 2, 3, 6] if k % 50 == 0 else [3, 4, 6]))}
              for k in range(10_000)]
    names = ", ".join(f"{f} string" for f in SCOPE_FIELDS)
    rules = spark.createDataFrame([(f"r{k}", tuple(s.get(f) for f in SCOPE_FIELDS)) for k, s in enumerate(scopes)],
                                  "report_rule_id string, scope struct<" + ", ".join(f"{f}: array<string>" for f in SCOPE_FIELDS) + ">")
    got = apply_scopes(spark.createDataFrame(facts, f"fact bigint, {names}"), rules)
    want = sorted((f"r{k}", r[0]) for r in facts for k, s in enumerate(scopes)
                  if all((r[1 + i] or "") in s[f] for i, f in enumerate(SCOPE_FIELDS) if f in s))
    assert sorted((r["report_rule_id"], r["fact"]) for r in got.collect()) == want and len(want) > 10_000
    without = apply_scopes(spark.createDataFrame([(1, "x")], "fact bigint, note string"), rules)
    assert {r["report_rule_id"] for r in without.collect()} == {f"r{k}" for k, s in enumerate(scopes) if all("" in v for v in s.values())}
    assert apply_scopes(spark.createDataFrame(facts[:0], f"fact bigint, {names}"), rules).count() == 0


def test_headings_name_subject_and_role(spark):
    from surveyloom.functions import text
    lines = [("数学学科课程实施与教材使用情况表（学生）", "数学", "学生"), ("体育与健康学科课程实施与教材使用情况表（学生）", "体育与健康", "学生"),
             ("高中生物教师课程实施与教材使用情况表", "生物学", "教师"), ("学校", "form", "学校"), (" ", "form", ""), (None, "form", ""),
             ("历史学科", "历史", ""), ("语文教研组教师", "语文", "教师")]
    got = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(lines)], "i int, t string").select(
        "i", text.heading_parts(F.col("t"), F.lit("form")).alias("h")).orderBy("i").collect()
    assert [(r["h"]["subject"], r["h"]["role"]) for r in got] == [x[1:] for x in lines]
