"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import in_block_pairs
from surveyloom.operators.graph import connected_components
from surveyloom.session import cut_lineage

BANDS, ROWS = 24, 5        # a pair at the least similarity 0.85 shares no band with probability (1 - 0.85^5)^24 < 1e-6
HASHES = BANDS * ROWS
BATCH = 24                 # hashes compared before the next look at the posterior
MISS = 1e-6                # a pair goes when P(similarity >= least | matches so far) is below this
BLOCK_ROWS = 512           # documents of a bucket that one task holds against as many others
CACHED_WORDS = 400_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MULTIPLIERS = (np.random.default_rng(20240517).integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _WordHash(dict):
    """64-bit hash of a word; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text; a shorter
    text with words is one shingle. bytes.lower and bytes.split know exactly A-Z and
    the six ASCII blanks."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = _mixed(mixed * _A + h[k:len(h) - width + 1 + k])
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> bytes:
    """``HASHES`` minima, 32 bits each, under odd multiplications modulo 2^64."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 4096):
            part = shingles[start:start + 4096]
            for k in range(HASHES):
                low = (part * _MULTIPLIERS[k]).min()
                if low < out[k]:
                    out[k] = low
    return (out >> np.uint64(32)).astype("<u4").tobytes()


def _signed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signs = [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), n)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signs.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
            ["doc_id", "n_shingles", "digest", "sign"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingle_set(t.as_py(), n).tobytes() for t in batch.column(1)], pa.binary())], ["rep", "shingles"])


def least_matches(least: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches that stay): after m matches of n the similarity has
    the posterior Beta(m + 1, n - m + 1), whose mass above ``least`` is a binomial sum."""
    out = []
    for n in range(batch, hashes + 1, batch):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _survives(one: np.ndarray, many: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of ``many`` that stay similar enough to ``one`` (or row by
    row to a matrix of as many rows), batch after batch."""
    alive, matches, start = np.arange(len(many)), np.zeros(len(many), np.int64), 0
    for n, fewest in bounds:
        own = one[start:n] if one.ndim == 1 else one[alive, start:n]
        matches = matches + (many[alive, start:n] == own).sum(axis=1)
        stay = matches >= fewest
        alive, matches, start = alive[stay], matches[stay], n
    return alive


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="mergesort")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), HASHES)


def _pruned(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    bounds = least_matches(percent / 100)
    for batch in batches:
        if batch.num_rows:
            stay = _survives(_matrix(batch.column("sign_a")), _matrix(batch.column("sign_b")), bounds)
            yield batch.select(["a", "b"]).take(pa.array(stay))


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("shingles_a"), batch.column("shingles_b")
        good = [i for i in range(batch.num_rows) if _similar(
            np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64), percent)]
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def _block_links(group: pa.Table, percent: int) -> pa.Table:
    """Links of one block pair that join documents of different components, as a forest:
    a pair whose ends are joined already is not looked at again."""
    bounds = least_matches(percent / 100)
    group = group.sort_by("rep")
    reps, block = group.column("rep").to_pylist(), group.column("_block").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    signs = _matrix(group.column("sign"))
    across = group.column("_x")[0].as_py() != group.column("_y")[0].as_py()
    _, label = np.unique(group.column("component").to_numpy(), return_inverse=True)
    label = label.astype(np.int64)
    a, b = [], []
    for i in range(len(reps) - 1):
        rest = np.arange(i + 1, len(reps))
        rest = rest[label[rest] != label[i]]
        if across:
            rest = rest[block[rest] != block[i]]
        for j in rest[_survives(signs[i], signs[rest], bounds)]:
            if label[j] != label[i] and _similar(sets[i], sets[j], percent):
                a.append(reps[i])
                b.append(reps[j])
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_components(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, component) of all ``reps``."""
    found = connected_components(edges).withColumnRenamed("node", "rep")
    return reps.join(found, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents link when their sets
    of word shingles have a Jaccard similarity of at least ``percent`` / 100.

    Equal sets fold into one representative, the least doc_id, before anything is
    compared. Representatives that share a band of their signature are candidates.
    First each bucket's members are held against its least member only: pairs are
    pruned batch by batch of hashes, survivors confirmed on their full sets, links
    joined to components. A bucket that still holds several components goes, dealt to
    block pairs, through the same steps for all its pairs across components. So every
    pair of a bucket is decided or known to be joined, without listing the pairs.

    Texts without words, null texts and rows without doc_id link with nothing (a null
    id has a null component and is not kept). Rows that share a doc_id are one node and
    get a row each; other columns are not read, an empty table gives no row. Bands need
    0.8 or more to find nearly all pairs."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = cut_lineage(source.mapInArrow(
        lambda it: _signed(it, shingle_words), "doc_id bigint, n_shingles bigint, digest binary, sign binary"))
    usable = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    # copies of one set: partial minima first, so a hot set sends one row per task
    classes = cut_lineage(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("sign").alias("sign")))
    reps = classes.groupBy("rep").agg(F.min("sign").alias("sign"))
    bands = cut_lineage(reps.select("rep", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.substring("sign", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])).alias("bucket")))
    leaders = bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = cut_lineage(bands.join(leaders, "bucket"))
    pairs = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda df, s: df.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "rep"])
    signs = reps.join(members.select("rep").distinct(), "rep", "left_semi")
    likely = cut_lineage(pairs.join(side(signs, "a"), "a").join(side(signs, "b"), "b").mapInArrow(
        lambda it: _pruned(it, percent), "a bigint, b bigint"))
    # full sets only of documents that met another one
    met = cut_lineage(members.select("rep").distinct())
    texts = source.withColumnRenamed("doc_id", "rep").join(met, "rep", "left_semi")
    sets = cut_lineage(texts.mapInArrow(lambda it: _sets(it, shingle_words), "rep bigint, shingles binary").groupBy("rep").agg(
        F.min("shingles").alias("shingles")))
    links = cut_lineage(likely.join(side(sets, "a"), "a").join(side(sets, "b"), "b").mapInArrow(
        lambda it: _confirmed(it, percent), "a bigint, b bigint"))
    joined = cut_lineage(_in_components(met, links))
    # what is left: buckets of several components, each set of members once
    at = members.join(joined, "rep")
    open_buckets = at.groupBy("bucket").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("rep") % F.lit(2**40)).alias("h1"), F.sum(F.xxhash64("rep", F.lit(5)) % F.lit(2**40)).alias("h2"),
    ).filter("c0 <> c1").groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = at.join(open_buckets, "bucket", "left_semi").select("bucket", "rep", "component").join(reps, "rep").join(sets, "rep")
    dealt = in_block_pairs(rest, ["bucket"], "rep", BLOCK_ROWS)
    more = cut_lineage(dealt.groupBy("bucket", "_x", "_y").applyInArrow(
        lambda g: _block_links(g, percent), "a bigint, b bigint"))
    ends = joined.select("rep", F.col("component").alias("_c"))
    between = more.join(side(ends, "a"), "a").join(side(ends, "b"), "b").select(F.col("_c_a").alias("a"), F.col("_c_b").alias("b"))
    merged = connected_components(between).select(F.col("node").alias("_c"), F.col("component").alias("_to"))
    final = joined.withColumnRenamed("component", "_c").join(merged, "_c", "left").select("rep", F.coalesce("_to", "_c").alias("_component"))
    of_set = classes.select("digest", "rep").join(final, "rep", "left").select(
        "digest", F.coalesce("_component", "rep").alias("_component"))
    at = signed.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return at.select("doc_id", "n_shingles", component.alias("component_id"),
                     F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its group, with all columns.

    A text without words is a group of its own and stays. Rows without doc_id cannot be
    told apart by it and go; all rows of a kept doc_id stay, repeated ones too. An empty
    table stays empty."""
    kept = cut_lineage(near_duplicates(docs, shingle_words, percent).filter("kept").select("doc_id").distinct())
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
