"""A round of order-exact merging is planned in small parts."""

from pyspark.sql import functions as F

from surveyloom.operators import graph
from surveyloom.session import cut_lineage


def test_a_round_stores_what_it_reads_again(spark, capsys):
    """As one plan the decision of a round reads its edges some forty times."""
    links = [("a", "b", 1, 2, 1), ("b", "c", 2, 3, 2), ("c", "d", 3, 4, 3), ("a", "d", 1, 4, 4)]
    edges = spark.createDataFrame(links, "a string, b string, ga bigint, gb bigint, i bigint")
    held = spark.createDataFrame([(g, f"f{g}") for g in (1, 2, 3, 4)], "group bigint, source string")
    live = edges.select("a", "b", "ga", "gb", graph.at(F.col("i"), F.lit(0).cast("bigint")).alias("at"))
    open_ = cut_lineage(graph._open_edges(live, held, one_side_single=False))
    capsys.readouterr()
    taken = graph._decide(open_, held)
    taken.explain()
    assert capsys.readouterr().out.count("FileScan") <= 2
    # a and c arrive at b, each by its own first edge; the later edges wait
    assert {(r.node_a, r.node_b) for r in taken.collect()} == {("a", "b"), ("b", "c")}
