"""Recoding of answer columns."""

from pyspark.sql import functions as F

from surveyloom.operators import recoding


def test_sleep_answers_are_split_and_parsed_once(spark, capsys):
    answers = [("7|30|10|15|",), ("6|0|1|30|",), ("7|30|15|0|",), ("x|30|10|15|",), (None,), ("7|0|12|0|",)]
    rows = recoding.sleep_durations(spark.createDataFrame(answers, "answer string"), F.col("answer"), "hours")
    assert [r.hours for r in rows.collect()] == [9.25, 4.5, None, None, None, 7.0]
    capsys.readouterr()
    rows.explain()
    plan = capsys.readouterr().out
    assert plan.count("split(") == 1 and plan.count("RLIKE") + plan.count("rlike") <= 4
