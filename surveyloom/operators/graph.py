"""Connected components and order-exact constrained merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.session import cut_lineage, shuffled


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (a, b); the component is its least node.
    Every round a node takes the least label among itself and its neighbours, then
    the label of its label, so long chains shrink by half. A node with a third of
    all edges costs one partial minimum per task."""
    links = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct().filter("a <> b"))
    labels = cut_lineage(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        seen = links.join(shuffled(labels.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near"))
        least = labels.join(shuffled(seen), "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        of_label = least.select(F.col("node").alias("component"), F.col("component").alias("jumped"))
        moved = cut_lineage(least.join(shuffled(of_label), "component", "left").select(
            "node", F.least("component", F.coalesce("jumped", "component")).alias("component"), "before"))
        changed = moved.filter("component <> before").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


class Merge:
    """Result of ``merge_in_order``.

    groups: (node, group, root, joined_at): every node that has an edge, its group,
    the group's root and the order at which its group first held two sources.
    accepted: (node_a, node_b, at) of the edges that merged.
    """

    def __init__(self, groups: DataFrame, accepted: DataFrame, rounds: int):
        self.groups, self.accepted, self.rounds = groups, accepted, rounds


def at(i: Column, j: Column) -> Column:
    return F.struct(i.alias("i"), j.alias("j"))


def merge_in_order(edges: DataFrame, nodes: DataFrame, sources: DataFrame, one_side_single: bool) -> Merge:
    """Merge groups edge by edge in order, each edge only while the two groups share
    no source (and, if asked, while at least one of them has a single source). The
    result is that of the sequential rule, for any number of edges.

    edges: (a, b, at) between nodes, ``at`` an orderable struct, unique; the node
    ``a`` holds the left question. nodes: (node, group, root), starting groups.
    sources: (group, source).

    A refusal is final, because groups only grow. So an edge can be decided as soon
    as it is the first open edge of both its groups. Moreover a group decides all
    arrivals at once: partners of one source for which the edge is their first, up
    to the first edge that must wait. Among arrivals of the same source the first
    one is taken.
    """
    touched = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    state = cut_lineage(nodes.join(shuffled(touched), "node", "left_semi"))
    held = cut_lineage(sources.join(shuffled(state.select("group").distinct()), "group", "left_semi").distinct())
    sizes = held.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    never, start = F.lit(None), at(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))
    state = cut_lineage(state.join(shuffled(sizes), "group", "left").select(
        "node", "group", "root", F.when(F.col("n") > 1, start).alias("joined_at")))
    of = state.select(F.col("node"), F.col("group"))
    live = (edges.join(shuffled(of.select(F.col("node").alias("a"), F.col("group").alias("ga"))), "a")
            .join(shuffled(of.select(F.col("node").alias("b"), F.col("group").alias("gb"))), "b"))
    accepted, rounds = None, 0
    while True:
        live = cut_lineage(_open_edges(live, held, one_side_single))
        if live.limit(1).count() == 0:
            break
        rounds += 1
        taken = cut_lineage(_decide(live, held))
        done = taken.select("node_a", "node_b", "at")
        accepted = done if accepted is None else accepted.unionByName(done)
        state, held, live = _apply(state, held, live, taken)
        state, held = cut_lineage(state), cut_lineage(held)
    if accepted is None:
        accepted = live.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "at")
    return Merge(state, accepted, rounds)


def _open_edges(live: DataFrame, held: DataFrame, one_side_single: bool) -> DataFrame:
    """Edges that may still merge, the first one per pair of groups."""
    sizes = held.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("one"))
    low, high = F.least("ga", "gb"), F.greatest("ga", "gb")
    pick = F.min_by(F.struct("a", "b", "ga", "gb", "at"), F.col("at"))
    first = live.filter("ga <> gb").groupBy(low.alias("low"), high.alias("high")).agg(pick.alias("e")).select("e.*")
    for side in "ab":
        first = first.join(shuffled(sizes.select(F.col("group").alias(f"g{side}"), F.col("n").alias(f"n{side}"), F.col("one").alias(f"one_{side}"))), f"g{side}")
    if one_side_single:
        first = first.filter("na = 1 OR nb = 1")
    # sources of the side that has fewer, looked up in the other side
    few = F.when(F.col("na") <= F.col("nb"), F.col("ga")).otherwise(F.col("gb"))
    many = F.when(F.col("na") <= F.col("nb"), F.col("gb")).otherwise(F.col("ga"))
    shared = (
        first.select("at", few.alias("group"), many.alias("many")).join(shuffled(held), "group")
        .join(shuffled(held.select(F.col("group").alias("many"), "source")), ["many", "source"], "left_semi")
        .select("at").distinct()
    )
    return first.join(shuffled(shared), "at", "left_anti").select("a", "b", "ga", "gb", "at", "na", "nb", "one_a", "one_b")


def _decide(live: DataFrame, held: DataFrame) -> DataFrame:
    """Accepted edges of this round as (hub, leaf, at, leaf_is_left, node_a, node_b). What is
    read several times is stored: as one plan it would stand in it forty times over, and
    the driver keeps a plan's text and metrics anew at each of its stages."""
    def directed(hub, leaf):
        return live.select(
            F.col(f"g{hub}").alias("hub"), F.col(f"g{leaf}").alias("leaf"), "at", (F.col(f"n{leaf}") == 1).alias("single"),
            F.col(f"one_{leaf}").alias("source"), F.lit(leaf == "a").alias("leaf_is_left"),
            F.col("a").alias("node_a"), F.col("b").alias("node_b"))
    both = directed("a", "b").unionByName(directed("b", "a"))
    first = both.groupBy("hub").agg(F.min("at").alias("first"))
    second = both.join(shuffled(first), "hub").filter(F.col("at") > F.col("first")).groupBy("hub").agg(F.min("at").alias("second"))
    turns = first.join(shuffled(second), "hub", "left")
    leaf_turn = turns.select(F.col("hub").alias("leaf"), F.col("first").alias("leaf_first"), F.col("second").alias("leaf_second"))
    ranked = cut_lineage(both.join(shuffled(leaf_turn), "leaf").join(shuffled(first), "hub").withColumn(
        "arrives", F.col("single") & (F.col("at") == F.col("leaf_first"))))
    waits = ranked.groupBy("hub").agg(F.min(F.when(F.col("arrives"), F.col("leaf_second")).otherwise(F.col("at"))).alias("wait"))
    ready = ranked.join(shuffled(waits), "hub").withColumn(
        "mutual", (F.col("at") == F.col("first")) & (F.col("at") == F.col("leaf_first")))
    arrivals = ready.filter(F.col("arrives") & (F.col("wait").isNull() | (F.col("at") < F.col("wait")))).groupBy("hub", "source").agg(
        F.min_by(F.struct("leaf", "at", "leaf_is_left", "node_a", "node_b"), F.col("at")).alias("e")).select("hub", "e.*")
    mutual = ready.filter("mutual").select("hub", "leaf", "at", "leaf_is_left", "node_a", "node_b")
    chosen = cut_lineage(arrivals.unionByName(mutual).distinct())
    counts = chosen.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    ranked_both = chosen.join(shuffled(counts), "hub").withColumnRenamed("n", "hub_n")
    # an edge taken from both ends stays with the end that takes more
    order = F.struct((-F.col("hub_n")).alias("n"), "hub")
    return ranked_both.groupBy("at").agg(
        F.min_by(F.struct("hub", "leaf", "leaf_is_left", "node_a", "node_b"), order).alias("e")).select("e.*", "at")


def _apply(state: DataFrame, held: DataFrame, live: DataFrame, taken: DataFrame):
    moves = taken.select(F.col("leaf").alias("group"), F.col("hub").alias("into"), F.col("at").alias("leaf_at"))
    roots = state.groupBy("group").agg(F.min("root").alias("leaf_root"))
    # the root is the left group's: it changes to the last leaf that stood left
    new_root = taken.filter("leaf_is_left").join(shuffled(roots.withColumnRenamed("group", "leaf")), "leaf").groupBy("hub").agg(
        F.max_by("leaf_root", "at").alias("new_root"))
    hubs = taken.groupBy("hub").agg(F.min("at").alias("hub_at")).withColumnRenamed("hub", "group")
    # the hub's old root is handed to its leaves when no leaf stood left
    old_root = roots.withColumnRenamed("group", "hub").withColumnRenamed("leaf_root", "hub_root")
    final_root = taken.select("hub").distinct().join(shuffled(old_root), "hub").join(shuffled(new_root), "hub", "left").select(
        F.col("hub").alias("into"), F.coalesce("new_root", "hub_root").alias("final_root"))
    moved = state.join(shuffled(moves), "group", "left").join(shuffled(hubs), "group", "left").withColumn("_to", F.coalesce("into", "group")).drop("into")
    state = moved.join(shuffled(final_root.withColumnRenamed("into", "_to")), "_to", "left").select(
        "node", F.col("_to").alias("group"), F.coalesce("final_root", "root").alias("root"),
        F.coalesce("joined_at", "leaf_at", "hub_at").alias("joined_at"))
    held = held.join(shuffled(moves), "group", "left").select(F.coalesce("into", "group").alias("group"), "source").distinct()
    for side in "ab":
        m = moves.select(F.col("group").alias(f"g{side}"), F.col("into").alias(f"into_{side}"))
        live = live.join(shuffled(m), f"g{side}", "left").withColumn(f"g{side}", F.coalesce(f"into_{side}", f"g{side}")).drop(f"into_{side}")
    return state, held, live.select("a", "b", "ga", "gb", "at")
