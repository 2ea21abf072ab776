"""Exact metric range join of embeddings: pivot cells, boundary replication, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import in_block_pairs
from surveyloom.operators.graph import connected_components
from surveyloom.session import cut_lineage

CELL_ROWS = 2048             # vectors of a cell that one task holds against as many others
LABEL_PIVOTS = 256           # pivots of one label, at most
PIVOT_BYTES = 16 * 2**20     # of all pivots together; labels beyond it are one cell each, dealt to block pairs
SLACK = 1e-9                 # on distances, so that rounding never loses a link


def _pivots(classes: DataFrame, cell_rows: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots per (label, dimension) of the groups with more than ``cell_rows`` vectors, in
    number as the rows: vectors of least hash in as many random parts. At most
    ``PIVOT_BYTES`` come to the driver, of the largest groups first."""
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    many = F.least(F.ceil(F.col("n") / cell_rows), F.lit(LABEL_PIVOTS))
    large = sizes.orderBy(F.col("n").desc(), "label", "dim").limit(PIVOT_BYTES // 64).select(
        "label", "dim", many.cast("int").alias("k")).collect()  # two pivots of four numbers are the least
    chosen, left = [], PIVOT_BYTES
    for r in large:
        need = 8 * r["k"] * r["dim"]
        if need > left:
            break
        chosen.append((r["label"], r["dim"], r["k"]))
        left -= need
    if not chosen:
        return {}
    spark = classes.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "label string, dim int, k int"))
    picked = classes.join(wanted, ["label", "dim"]).groupBy("label", "dim", F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")).alias("slot")).agg(
        F.min_by("unit", F.struct(F.xxhash64("node", F.lit(2)), "node")).alias("unit")).collect()
    groups: dict[tuple[str, int], list] = {}
    for r in sorted(picked, key=lambda r: r["slot"]):
        groups.setdefault((r["label"], r["dim"]), []).append(r["unit"])
    return {k: np.unique(np.array(v), axis=0) for k, v in groups.items()}


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0.0))


def _units(batch: pa.RecordBatch, rows: np.ndarray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bits").take(pa.array(rows)).to_pylist()), "<f8").reshape(-1, dim)


def _groups_of(batch: pa.RecordBatch):
    """((label, dim), row numbers) of a batch."""
    groups: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
        groups.setdefault(key, []).append(i)
    return [(k, np.array(v)) for k, v in groups.items()]


def _assigned(batches: Iterator[pa.RecordBatch], pivots: dict) -> Iterator[pa.RecordBatch]:
    """Each vector's cell, that of its nearest pivot, and its distance to that."""
    for batch in batches:
        units = batch.column("unit")
        bits = pa.array([np.array(u.as_py(), "<f8").tobytes() for u in units], pa.binary())
        batch = pa.RecordBatch.from_arrays([batch.column(n) for n in ("label", "dim", "node", "copies")] + [bits],
                                           ["label", "dim", "node", "copies", "bits"])
        cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        for key, rows in _groups_of(batch):
            if key in pivots:
                d = _distances(_units(batch, rows, key[1]), pivots[key])
                cell[rows] = d.argmin(1)
                far[rows] = d.min(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])


def _replicated(batches: Iterator[pa.RecordBatch], pivots: dict, radii: dict, reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its own cell, and as a guest in every earlier cell that may hold a
    partner. A partner u of cell i lies within ``reach`` of v; so by the triangle
    inequality d(v, p_i) <= radius of cell i + reach, and, u being nearer to p_i than to
    v's own pivot p_j, v lies within ``reach`` of the plane halfway between both."""
    for batch in batches:
        pick, cell, guest = [np.arange(batch.num_rows)], [batch.column("cell").to_numpy()], [np.zeros(batch.num_rows, bool)]
        for key, rows in _groups_of(batch):
            if key not in pivots:
                continue
            p = pivots[key]
            d = _distances(_units(batch, rows, key[1]), p)
            own = batch.column("cell").to_numpy()[rows]
            radius = np.array([radii.get((*key, k), -1.0) for k in range(len(p))])
            between = _distances(p, p)[own]
            nearest = d[np.arange(len(rows)), own][:, None]
            to_plane = (d**2 - nearest**2) / (2 * np.maximum(between, SLACK))
            meets = (radius >= 0) & (d <= radius + reach + SLACK) & (to_plane <= reach + SLACK) & (np.arange(len(p)) < own[:, None])
            at, other = np.nonzero(meets)
            pick.append(rows[at])
            cell.append(other.astype(np.int32))
            guest.append(np.ones(len(at), bool))
        out = batch.select(["label", "dim", "node", "copies", "bits"]).take(pa.array(np.concatenate(pick)))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(guest))],
                                         [*out.schema.names, "cell", "guest"])


def _block_links(group: pa.Table, cosine: float) -> pa.Table:
    """Partners of each vector within one block pair of a cell, counted with copies, and
    the least node its links reach there. Two guests never pair: their own cells see
    to them."""
    order = np.argsort(group.column("node").to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    node, copies, block, guest = (group.column(n).to_numpy() for n in ("node", "copies", "_block", "guest"))
    x = np.frombuffer(b"".join(group.column("bits").to_pylist()), "<f8").reshape(len(node), -1)
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    close &= ~(guest[:, None] & guest)
    if group.column("_x")[0].as_py() != group.column("_y")[0].as_py():
        close &= block[:, None] != block
    linked = np.flatnonzero(close.any(1))
    links = close[linked] @ copies
    inner, least = close[np.ix_(linked, linked)], np.arange(len(linked))
    while len(linked):  # rows are in order of their nodes, so the least index is the least node
        lower = np.minimum(least, np.where(inner, least, len(linked)).min(1))
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    return pa.table({"node": pa.array(node[linked], pa.int64()), "links": pa.array(links, pa.int64()),
                     "least": pa.array(node[linked][least], pa.int64())})


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other rows of the same
    label and length have a cosine of at least ``cosine``, and the least id reachable.

    Equal unit vectors of a label fold into one class first. On unit vectors the cosine
    is a distance. Pivots, in number as the rows, part a label's vectors into cells;
    a vector is copied to the earlier cells whose vectors may be in reach, so each pair
    meets in exactly one cell. A large cell is dealt to pairs of blocks. Tasks return
    counts and the least node reached, never pairs. Where vectors spread evenly in many
    dimensions the bounds exclude little and most cells get most vectors; clustered
    vectors stay in few.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without label or id, link with nothing (a null id has a null component and is not
    kept). Rows that share an id are one node and get a row each; other columns are not
    read, an empty table gives no row."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    raw = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), raw.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    peak = F.array_max(F.transform("x", F.abs))
    rows = rows.withColumn("peak", F.when(~F.coalesce(bad, F.lit(True)) & F.col("id").isNotNull() & F.col("label").isNotNull(), peak))
    scaled = F.when(F.col("peak") > 0, F.transform("x", lambda c: c / F.col("peak")))
    rows = rows.withColumn("scaled", scaled)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, c: a + c * c))
    rows = rows.withColumn("norm", norm).withColumn("unit", F.transform("scaled", lambda c: c / F.col("norm") + 0.0))
    digest = [F.when(F.col("unit").isNotNull(), F.xxhash64(F.lit(k), "label", "unit")) for k in (1, 2)]
    at = cut_lineage(rows.select("id", "label", "unit", F.size("unit").alias("dim"), digest[0].alias("h1"), digest[1].alias("h2")))
    keys = ["label", "dim", "h1", "h2"]
    classes = cut_lineage(at.filter("unit IS NOT NULL").groupBy(*keys).agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit")))
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes, cell_rows))
    assigned = cut_lineage(classes.select("label", "dim", "node", "copies", "unit").mapInArrow(
        lambda it: _assigned(it, pivots.value), "label string, dim int, node bigint, copies bigint, bits binary, cell int, far double"))
    radii = {}
    if pivots.value:  # as many rows as pivots
        parted = F.broadcast(classes.sparkSession.createDataFrame(list(pivots.value), "label string, dim int"))
        radii = {(r["label"], r["dim"], r["cell"]): r["r"] for r in assigned.join(parted, ["label", "dim"]).groupBy(
            "label", "dim", "cell").agg(F.max("far").alias("r")).collect()}
    dealt = assigned.drop("far").mapInArrow(
        lambda it: _replicated(it, pivots.value, radii, reach),
        "label string, dim int, node bigint, copies bigint, bits binary, cell int, guest boolean")
    blocks = in_block_pairs(cut_lineage(dealt), ["label", "dim", "cell"], "node", cell_rows)
    found = cut_lineage(blocks.groupBy("label", "dim", "cell", "_x", "_y").applyInArrow(
        lambda g: _block_links(g, cosine), "node bigint, links bigint, least bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    result = classes.select(*keys, "node", "copies").join(links, "node", "left").join(
        components, "node", "left").select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
                                           F.coalesce("component", "node").alias("_component"))
    component = F.coalesce("_component", "id")
    return at.select("id", *keys).join(result, keys, "left").select(
        F.col("id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
