"""How the facts behind the metrics are made: once, and dealt by respondent."""

from surveyloom.operators import metrics
from surveyloom.queries import bindings as B

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_by_respondent(spark, capsys):
    """Beside a broadcast of all respondents every task counts all of them."""
    capsys.readouterr()
    for facts in (B.choice_facts, B.quantity_facts, B.grid_facts, B.multi_facts, B.upload_facts):
        facts(spark, SF).explain()
        plan = capsys.readouterr().out
        assert plan.count("BroadcastHashJoin") == 2  # nations and regions
        assert "c_custkey" in "".join(line for line in plan.split("\n") if "ShuffledHashJoin" in line)


def test_branches_read_stored_facts(spark, capsys):
    capsys.readouterr()
    metrics.metrics_summary(B.all_facts(spark, SF)).explain()
    plan = capsys.readouterr().out
    assert "lineitem.parquet" not in plan and "customer.parquet" not in plan
