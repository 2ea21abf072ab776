"""Context-triggered piecewise hashing: fingerprints of whole texts and their likeness."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from surveyloom.session import cut_lineage

WINDOW = 7        # bytes that decide on a boundary
FINEST = 2        # log2 of the smallest block size
MOST_PIECES = 64
SYMBOLS = 0x4E00  # a piece's hash of 12 bits is the character that many places on
_TABLE = np.random.default_rng(64).integers(0, 2**32, 256, dtype=np.uint32)


def _boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a piece may end, and the log2 of the largest block size at which
    it does: the rolling hash of the last bytes ends in that many ones."""
    mixed = _TABLE[np.frombuffer(data, np.uint8)]
    rolling = mixed.copy()
    for k in range(1, min(WINDOW, len(mixed))):
        rolling[k:] ^= (mixed[:-k] << np.uint32(3 * k)) | (mixed[:-k] >> np.uint32(32 - 3 * k))
    rolling ^= rolling >> np.uint32(15)
    at = np.flatnonzero((rolling & np.uint32(2**FINEST - 1)) == 2**FINEST - 1)
    above = rolling[at].astype(np.int64) + 1
    return at + 1, np.log2(above & -above).astype(np.int64)


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice that size``.

    A signature has one character for every piece, a hash of the whole piece. The block
    size is the least power of two, 4 or more, at which the text has at most 64 pieces,
    so no piece is ever cut off or run together. An empty text has empty signatures."""
    data = text.encode()
    ends, sizes = _boundaries(data)
    deepest = int(sizes.max(initial=FINEST)) + 1
    reaching = np.bincount(sizes, minlength=deepest + 1)[::-1].cumsum()[::-1]  # boundaries per block size
    closed = int(sizes[-1]) if len(ends) and ends[-1] == len(data) else FINEST - 1  # up to this size the text ends at a boundary
    level = FINEST
    while level < deepest and reaching[level] + (level > closed) > MOST_PIECES:
        level += 1
    signatures = []
    for each in (level, level + 1):
        stops = ends[sizes >= each].tolist()
        if len(data) and (not stops or stops[-1] != len(data)):
            stops.append(len(data))
        hashes = [zlib.crc32(data[a:b]) for a, b in zip([0, *stops], stops)]
        signatures.append("".join([chr(SYMBOLS + ((h ^ h >> 12 ^ h >> 24) & 0xFFF)) for h in hashes]))
    return f"{1 << level}:{signatures[0]}:{signatures[1]}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance of two fingerprints' signatures at a common block
    size, in shares of the longer one; 0 if they have none in common, null if either is
    null. Empty texts are alike among themselves."""
    size = lambda f: F.substring_index(f, ":", 1).cast("bigint")
    fine = lambda f: F.substring_index(F.substring_index(f, ":", 2), ":", -1)
    coarse = lambda f: F.substring_index(f, ":", -1)
    x = F.when(size(a) * 2 == size(b), coarse(a)).otherwise(fine(a))
    y = F.when(size(b) * 2 == size(a), coarse(b)).otherwise(fine(b))
    near = 1 - F.levenshtein(x, y) / F.greatest(F.char_length(x), F.char_length(y), F.lit(1))
    common = (size(a) == size(b)) | (size(a) * 2 == size(b)) | (size(b) * 2 == size(a))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(common, near).otherwise(F.lit(0.0))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint(t.as_py() or "") for t in batch.column(1)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row. A null text counts as empty; repeated rows and
    null ids give a row each, other columns are not read, an empty table gives no row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_printed, f"doc_id {kind}, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


_MADE = {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "_next_fingerprint": "string"}


def _beside(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    edited = edited_text(text, following)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, fingerprint(edited), next_own


def _table(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_order(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each row with what comes of the row behind it. The range's first row gives its text
    to ``_head``; the last one, whose next lies in another range, gives its text to ``_tail``."""
    held, where = None, None
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            out = []
            for doc_id, text, where in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns)):
                own = fingerprint(text)
                if held is None:
                    held = (doc_id, text, own, text)
                else:
                    out.append((*_beside(*held[:3], text, own), where, held[3], None))
                    held = (doc_id, text, own, None)
            yield from _table(out, schema)
    if held is not None:
        yield from _table([(held[0], len(held[1]), None, held[2], None, None, where, held[3], held[1])], schema)


def _joined_ends(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _table([_beside(*row) for row in zip(*(c.to_pylist() for c in batch.columns))], schema)


def beside_next(docs: DataFrame) -> DataFrame:
    """Every document, its edited text and the document behind it, by descending doc_id and
    from the last back to the first: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The rows are range-sorted once, so each text moves once; a task walks through its
    range, and the two texts at each border between ranges meet in a join on the range's
    number. Only those numbers, one per range, are ordered in a single task. A null text
    counts as empty; null ids come last, and rows of one id by a hash of their text, so a
    hot id spreads over ranges. One row alone is its own next; an empty table gives no row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text").asc(), F.asc("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = ", ".join(f"{n} {t}" for n, t in _MADE.items())
    kinds = f"doc_id {kind}, {made}, _range int, _head string, _tail string"
    shape = to_arrow_schema(StructType.fromDDL(kinds))
    near = [likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_next_fingerprint")).alias("near_next")]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    walked = cut_lineage(ranged.mapInArrow(lambda it: _in_order(it, shape), kinds).select(*names, *near, "_range", "_head", "_tail"))
    last = walked.filter(F.col("_tail").isNotNull())
    whole = W.orderBy("_range")  # one row per range
    following = last.select("_range").select("_range", F.coalesce(
        F.lead("_range").over(whole), F.min("_range").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_then"))
    heads = walked.filter(F.col("_head").isNotNull()).select(
        F.col("_range").alias("_then"), F.col("_head").alias("_after"), F.col("fingerprint").alias("_next_fingerprint"))
    ends = last.select("doc_id", "fingerprint", "_range", "_tail").join(following, "_range").join(heads, "_then")
    end_kinds = f"doc_id {kind}, {made}"
    end_shape = to_arrow_schema(StructType.fromDDL(end_kinds))
    met = ends.select("doc_id", "_tail", "fingerprint", "_after", "_next_fingerprint").mapInArrow(
        lambda it: _joined_ends(it, end_shape), end_kinds).select(*names, *near)
    return walked.filter(F.col("_tail").isNull()).select(*met.columns).unionByName(met)
