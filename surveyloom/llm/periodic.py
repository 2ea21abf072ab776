"""Periodic runs of words: recursive frequency splitting, then a lag scan of what is left."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_LENGTH = 24
LEAST_REPEATS = 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def surviving_segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches [begin, end) that can hold a run: each word occurs three times or more
    within its own stretch.

    Within a run every word comes back after each period, so three times at least. A
    rarer word of a segment is in none of its runs and splits it; the parts are judged
    by their own counts until nothing splits any more. The longest part goes on with its
    parent's counts, less those of what was cut off, and only the shorter ones are
    counted anew, so a word is counted at most log2(n) times however deep the splitting
    goes."""
    todo = [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        if end - begin < LEAST_LENGTH:
            continue
        words, part, counts = np.unique(ids[begin:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[part] < LEAST_REPEATS)
        order = places = None
        low, high = 0, end - begin
        while len(rare):
            cuts = np.concatenate(([low - 1], rare, [high]))
            sizes = np.diff(cuts) - 1
            longest = int(np.argmax(sizes))
            todo += [(begin + int(cuts[k]) + 1, begin + int(cuts[k + 1]))
                     for k in np.flatnonzero(sizes >= LEAST_LENGTH) if k != longest]
            was, (low, high) = (low, high), (int(cuts[longest]) + 1, int(cuts[longest + 1]))
            if high - low < LEAST_LENGTH:
                break
            gone, n = np.unique(np.concatenate((part[was[0]:low], part[high:was[1]])), return_counts=True)
            counts[gone] -= n
            scarce = gone[(counts[gone] > 0) & (counts[gone] < LEAST_REPEATS)]
            if order is None:  # places of every word, in order
                order = np.argsort(part, kind="stable")
                places = part[order] * np.int64(len(part)) + order
            first = np.searchsorted(places, scarce * np.int64(len(part)) + low)
            rare = np.sort(np.concatenate([order[first[counts[scarce] > k] + k] for k in range(LEAST_REPEATS - 1)]))
        else:
            yield begin + low, begin + high


def lag_scan(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment.

    At scale g the lag of a place is the distance to the next equal g words; lags of more
    than g/2 up to g count. A run of such a period q has 3q words and more, so g words fit
    in it with a shift of q, and g >= q words of it come back after q and no sooner. Hence
    the places of a run with the full g words are one stretch of equal lags, and any
    stretch of lag q is a run of smallest period q that cannot be extended. The names of
    2g words are pairs of the names of g words."""
    names = np.unique(ids, return_inverse=True)[1]
    n, g = len(ids), 1
    while LEAST_REPEATS * (g // 2 + 1) <= n:
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        if not same.any():
            return
        lag = np.zeros(len(names), np.int64)
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        lag[(lag <= g // 2) | (lag > g)] = 0
        edges = np.concatenate(([0], np.flatnonzero(lag[1:] != lag[:-1]) + 1, [len(lag)]))
        period = lag[edges[:-1]]
        length = np.diff(edges) + g - 1 + period
        found = (period > 0) & (length >= np.maximum(LEAST_LENGTH, LEAST_REPEATS * period))
        yield from zip(edges[:-1][found].tolist(), length[found].tolist(), period[found].tolist())
        if len(names) <= g:
            return
        names = np.unique(names[:-g] * np.int64(len(ids)) + names[g:], return_inverse=True)[1]
        g *= 2


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs by start, then period."""
    if len(words) < LEAST_LENGTH:
        return []
    ids = np.fromiter(map(defaultdict(count().__next__).__getitem__, words), np.int64, len(words))
    if (np.bincount(ids)[ids] < LEAST_REPEATS).all():
        return []
    return sorted((begin + start, length, period) for begin, end in surviving_segments(ids)
                  for start, length, period in lag_scan(ids[begin:end]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run but for its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            sizes, runs, texts = [], [], []
            for text in part.column(1):
                words = (text.as_py() or b"").split()  # at the six ASCII blanks
                found = runs_of(words)
                sizes.append(len(words))
                runs.append(found)
                texts.append(b" ".join(without_repeats(words, found)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _RUN_ARROW), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "text"])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row: its runs by start, then period, and the
    text without their repeats, words joined by one blank.

    A null or empty text has no words, no runs and the text ''. Every row is judged by
    itself: repeated rows and null ids give a row each, other columns are not read, an
    empty table gives no row. A very long text costs about n log(n) squared."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_detected, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, text string")


def _tail_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            h = zlib.crc32(str(doc_id).encode())
            words = texts[k].split() if doc_id is not None and h % 10 == 0 and texts[k] else []
            if words:
                n, g = len(words), h // 10
                at = g % n
                period = 1 + (n - at) // (3 + g % 8)
                cycle = words[at:at + period]
                texts[k] = b" ".join([*words[:at], *(cycle * -(-(n - at) // period))[:n - at]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by crc32 of the id, repeats a few
    words from a place on to its end. A document without id, text or words stays as it is."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_tail_repeated, f"doc_id {kind}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length/period, and hashes of all runs and of the text."""
    stronger = lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    top = F.aggregate("runs", F.lit(None).cast(RUN), stronger).alias("top")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top,
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                       F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
