"""Links and components of embeddings against all pairs."""

import math

import numpy as np
import pytest

from surveyloom.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<double>, label int, node string, copies int"


def brute(rows, least):
    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        a = np.array(v) / np.abs(v).max()
        return a / np.linalg.norm(a)
    live = [(k, i, lab, u) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and (u := unit(v)) is not None]
    links, parent = [0] * len(rows), {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x, (k, i, lab, u) in enumerate(live):
        for m, j, other, w in live[x + 1:]:
            if lab == other and len(u) == len(w) and float(u @ w) >= least:
                links[k] += 1
                links[m] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted([(i, links[k], None if i is None else root(i), i is not None and root(i) == i) for k, (i, _, _) in enumerate(rows)], key=repr)


def check(spark, rows, **options):
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), 0.93, **options).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 0.93)


@pytest.mark.parametrize("cell_rows", [2048, 24])
def test_clusters_copies_and_odd_vectors(spark, cell_rows):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre, spread = rng.normal(size=8), rng.choice([0.05, 0.2, 0.5])
        rows += [(100 * c + k, (centre + rng.normal(size=8) * spread).tolist(), int(c % 3)) for k in range(rng.integers(5, 60))]
    walk = rng.normal(size=8)
    for k in range(80):  # a chain whose ends are apart
        walk = walk / np.linalg.norm(walk) + rng.normal(size=8) * 0.1
        rows.append((5000 - k, walk.tolist(), 1))
    rows += [(6000 + k, rows[0][1], 0) for k in range(30)] + [(6100, rows[0][1], 1), (6101, rows[0][1], None), (6102, [2 * x for x in rows[0][1]], 0)]
    rows += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * 8, 0), (7003, [1.0, None] * 4, 0), (7004, [float("nan")] * 8, 0),
             (7005, [float("inf")] + [0.0] * 7, 0), (None, rows[0][1], 0), (7006, [1e-300] * 8, 2), (7007, [1e300] * 8, 2), (7008, [1.0, 0.0], 0),
             (7009, [-0.0, 1.0], 0), (7010, [0.0, 1.0], 0)]
    check(spark, rows, cell_rows=cell_rows)


def test_table(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(
        "/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows, cell_rows=16)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
