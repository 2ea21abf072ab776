"""Token sequences packed along a space-filling curve, so that alike documents lie together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveyloom.session import cut_lineage

LENGTH = 4096
END = 2                   # id after each document
DIMENSIONS, BITS = 4, 10  # of the curve
BUCKETS = 256             # of a document's hashed vector
HELD = 300_000    # pieces of text in each of the two generations a task remembers
MARKS = ".,;:!?*|#$%&-()"
_PROJECTION = np.random.default_rng(4096).standard_normal((BUCKETS, DIMENSIONS))


class ChunkIds(dict):
    """Ids of the pieces of text between ASCII blanks, as 16-bit little-endian bytes.

    Blanks never lie inside a token of the word vocabulary, so a text's ids are those
    of its pieces one after the other. A piece that is a plain word with marks behind
    it goes to the merges directly, the word and the marks each; any other piece goes
    through the whole tokenizer. Forgets all when too large."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        self.merges = self.tokenizer.model.tokenize
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256 on
        own = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
        others = iter(range(256, 512))
        self.letters = [chr(b) if b in own else chr(next(others)) for b in range(256)]
        self.words: dict[str, list[int]] = {}
        self.old: dict[bytes, bytes] = {}

    def _word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > HELD:
                self.words.clear()
            spelled = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            found = self.words[word] = [t.id for t in self.merges(spelled)]
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > HELD:
            self.old = dict(self)
            self.clear()
        known = self.old.get(chunk)
        if known is not None:
            self[chunk] = known
            return known
        text = chunk.decode("utf-8", "replace")
        word = text.rstrip(MARKS)
        lower = word.lower()
        if lower.isalpha() and word.isalpha() and max(lower) < "ɐ":
            ids = self._word(lower) + (self._word(text[len(word):]) if len(word) < len(text) else [])
        elif not word:
            ids = self._word(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        value = self[chunk] = np.array(ids, "<u2").tobytes()
        return value

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split())) + END.to_bytes(2, "little")


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def projected(ids: np.ndarray) -> np.ndarray:
    """A document's place: its ids hashed to a vector of unit length, and that projected."""
    hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    vector = np.bincount(hashed, minlength=BUCKETS).astype(np.float64)
    return (vector / np.linalg.norm(vector)) @ _PROJECTION


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers below 2^bits."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        for i in range(d):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_bit, q - 1, 0)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    ids_of = chunk_ids(path).of
    for batch in batches:
        ids = [ids_of(t.as_py()) for t in batch.column("text")]
        places = np.array([projected(np.frombuffer(x, "<u2")) for x in ids]).reshape(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
             *[pa.array(places[:, k]) for k in range(DIMENSIONS)]],
            ["_row", "doc_id", "doc_tokens", "ids", *[f"p{k}" for k in range(DIMENSIONS)]])


def _keyed(batches: Iterator[pa.RecordBatch], mean: list[float], spread: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.stack([batch.column(f"p{k}").to_numpy() for k in range(DIMENSIONS)], 1)
        even = 1 / (1 + np.exp(-1.7 * (at - mean) / spread))  # about even over (0, 1)
        cells = np.minimum((even * 2**BITS).astype(np.int64), 2**BITS - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("doc_tokens"), pa.array(hilbert_key(cells))], ["_row", "doc_tokens", "key"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = 0
    for batch in batches:
        n = batch.column("doc_tokens").to_numpy()
        ends = before + np.cumsum(n)
        if len(n):
            before = int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("_range"), batch.column("doc_tokens"), pa.array(ends - n)],
            ["_row", "_range", "doc_tokens", "inside"])


def _places(tokens: DataFrame) -> DataFrame:
    """(_row, begin): tokens before each document along the curve. The rows are
    range-sorted by (key, row), so copies with one key spread over tasks; a task sums up
    its own range, and only one total per range is ordered in a single task."""
    stats = tokens.agg(*[f(f"p{k}").alias(f"{n}{k}") for k in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = [stats[f"m{k}"] or 0.0 for k in range(DIMENSIONS)]
    spread = [stats[f"s{k}"] or 1.0 for k in range(DIMENSIONS)]
    keyed = cut_lineage(tokens.select("_row", "doc_tokens", *[f"p{k}" for k in range(DIMENSIONS)]).mapInArrow(
        lambda it: _keyed(it, mean, spread), "_row bigint, doc_tokens bigint, key bigint"))
    ranged = keyed.repartitionByRange("key", "_row").sortWithinPartitions("key", "_row").withColumn("_range", F.spark_partition_id())
    inside = cut_lineage(ranged.mapInArrow(_running, "_row bigint, _range int, doc_tokens bigint, inside bigint"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = inside.groupBy("_range").agg(F.sum("doc_tokens").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_range", "_start")  # a row per range
    return inside.join(F.broadcast(starts), "_range").select("_row", (F.col("inside") + F.col("_start")).alias("begin"))


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents
    in sequences of ``length`` tokens, a power of two; ids are 16-bit little-endian.

    Documents follow one another by the Hilbert key of their projected vectors and are
    cut where a sequence is full. The rest behind the last full sequence is cut into
    shorter sequences whose lengths are powers of two, so nothing is padded. A null or
    empty text is its end id alone; repeated rows are packed each; an empty table gives
    no piece."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("_row"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = cut_lineage(rows.mapInArrow(lambda it: _tokenized(it, path), f"_row bigint, doc_id {id_type}, doc_tokens bigint, ids binary, "
                                         + ", ".join(f"p{k} double" for k in range(DIMENSIONS))))
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    full = total // length
    cuts = [full * length]
    while cuts[-1] < total:
        cuts.append(cuts[-1] + (1 << ((total - cuts[-1]).bit_length() - 1)))
    cuts.append(total)  # so that the sequence after the last one has a start

    def sequence_at(position: Column) -> Column:
        late = sum([(position >= c).cast("bigint") for c in cuts[1:-1]], F.lit(0).cast("bigint"))
        return F.when(position < cuts[0], F.floor(position / length)).otherwise(F.lit(full) + late)

    def start_of(sequence: Column) -> Column:
        late = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in cuts]), F.greatest(sequence - full + 1, F.lit(1)).cast("int"))
        return F.when(sequence < full, sequence * length).otherwise(late)

    places = _places(tokens)
    at = tokens.select("_row", "doc_id", "doc_tokens", "ids").join(places.hint("shuffle_hash"), "_row")
    end = F.col("begin") + F.col("doc_tokens")
    at = at.withColumn("sequence_id", F.explode(F.sequence(sequence_at(F.col("begin")), sequence_at(end - 1))))
    at = at.withColumn("_from", start_of(F.col("sequence_id"))).withColumn("_to", start_of(F.col("sequence_id") + 1))
    low, high = F.greatest("begin", "_from"), F.least(end, F.col("_to"))
    at = at.select(
        "doc_id", (low - F.col("begin")).alias("start"), (high - low).alias("length"), "doc_tokens",
        F.col("sequence_id"), (low - F.col("_from")).alias("offset"), "ids")
    return at.withColumn("ids", F.expr("substring(ids, cast(2 * start + 1 as int), cast(2 * length as int))"))


def _with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes()) for x in batch.column("ids")]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids, as 32-bit integers, in place of the ids."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    kinds = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names)
    return pieces.select(*names, "ids").mapInArrow(_with_crc, f"{kinds}, ids_crc32 bigint").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
