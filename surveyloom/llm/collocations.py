"""Phrases whose words keep together, counted in hash containers under a trie of word ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import joined_to
from surveyloom.operators.ordering import number_globally
from surveyloom.session import cut_lineage

BREAK = b"."
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)
BURST = 2048         # suffixes a container holds before it becomes a node
ROOM = 300_000       # grams in a task's trie before subtrees are spilled
WORDS = 500_000      # distinct words a task numbers before it starts anew
BLOCK = 2_000_000    # bytes of text that are counted at a time
FILTER_BITS = 28     # log2 of the largest filter: 32 MB
SPAN = 1 << 16       # neighbouring bits of a filter that are summed together
PENDING = 8_000_000  # grams a task holds before equal ones are added up
_SHIFT = 40503       # sets the first word of a pair apart from the second
SLICES = 64          # of a prefix's suffixes, so that a hot prefix spreads over tasks


class Container(dict):
    """Counts by suffix, a tuple of word ids."""


class HatTrie:
    """Counts of tuples of word ids.

    A node is a dict from a word id (-1: the gram ends here) to a node or a container. A
    container that outgrows ``burst`` suffixes becomes a node whose containers hold what
    is left of them, so only crowded prefixes get deep. ``spill`` takes whole subtrees of
    the root, the largest first, and gives each as one run of (gram, count)."""

    def __init__(self, burst: int = BURST):
        self.root: dict = {}
        self.sizes: dict[int, int] = {}
        self.entries = 0
        self.burst = burst

    def add(self, gram: tuple[int, ...], n: int) -> None:
        node, at = self.root, 0
        while True:
            word = gram[at] if at < len(gram) else -1
            child = node.get(word)
            at += 1
            if child is None:
                child = node[word] = Container()
            if type(child) is Container:
                break
            node = child
        suffix = gram[at:]
        if suffix in child:
            child[suffix] += n
            return
        child[suffix] = n
        self.entries += 1
        self.sizes[gram[0]] = self.sizes.get(gram[0], 0) + 1
        if len(child) > self.burst:
            parts = node[word] = {}
            for rest, count in child.items():
                parts.setdefault(rest[0] if rest else -1, Container())[rest[1:]] = count

    def _walk(self, child, prefix: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
        if type(child) is Container:
            for suffix, n in child.items():
                yield prefix + suffix, n
        else:
            for word, below in child.items():
                yield from self._walk(below, prefix if word < 0 else (*prefix, word))

    def spill(self, keep: int) -> Iterator[list[tuple[tuple[int, ...], int]]]:
        """Subtrees until at most ``keep`` grams are left."""
        for word in sorted(self.sizes, key=self.sizes.__getitem__, reverse=True):
            if self.entries <= keep:
                return
            self.entries -= self.sizes.pop(word)
            yield list(self._walk(self.root.pop(word), (word,)))


class Ids(dict):
    """Numbers of one language's words, in a list of (lang, word) that all languages share."""

    def __init__(self, lang: str, names: list):
        super().__init__({BREAK: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return number


class Filter:
    """A bit per hash of what occurs often. It says yes to all of that and, by chance, to
    some others, which exact counts sort out later."""

    def __init__(self, bits: int, blocks: list[tuple[int, bytes]]):
        self.size = np.uint64(1 << bits)
        wide = len(blocks[0][1]) if blocks else 0
        self.held = np.zeros(max((1 << bits) // 8, wide), np.uint8)
        for number, block in blocks:
            self.held[number * wide:(number + 1) * wide] = np.frombuffer(block, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes % self.size).astype(np.int64)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Counter:
    """Counts the grams of one task: words without ``filters``; else, with those of words,
    pairs and so on, the phrases of two to ``longest`` words whose parts all pass."""

    def __init__(self, filters: list[Filter], longest: int):
        self.filters, self.longest = filters, longest
        self.begin()

    def begin(self) -> None:
        self.names: list = [("", BREAK)]
        self.ids: dict[str, Ids] = {}
        self.trie = HatTrie()
        self.known = np.zeros(1, bool)
        self.hashes = np.zeros(1, np.uint64)
        self.alone = np.zeros(1, np.int64)

    def number(self, lang: str, data: bytes) -> np.ndarray:
        if lang not in self.ids:
            self.ids[lang] = Ids(lang, self.names)
        words = data.replace(BREAK, b" . ").split()
        return np.fromiter(map(self.ids[lang].__getitem__, words), np.int64, len(words))

    def _learn(self) -> None:
        """Hashes of the words numbered since, and whether they pass the first filter."""
        new = self.names[len(self.hashes):]
        hashes = np.fromiter((zlib.crc32(lang.encode() + b"\0" + word) for lang, word in new), np.uint64, len(new))
        self.hashes = np.concatenate((self.hashes, hashes))
        if self.filters:
            self.known = np.concatenate((self.known, self.filters[0].has(hashes)))

    def places(self, parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The words end to end, breaks (0) between texts, and per filter where a word, a
        pair … begins that passes it and all before."""
        gap = np.zeros(1, np.int64)
        a = np.concatenate([x for part in parts for x in (part, gap)])
        self._learn()
        fits = self.known[a]
        fits[a == 0] = False
        runs = [fits]
        for k, passing in enumerate(self.filters[1:], 2):
            run, at = self.longer(runs[-1])
            run[at] = passing.has(self.gram_hashes(a, at, k))
            runs.append(run)
        return a, runs

    def longer(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a gram of one word more begins whose two halves begin at ``run``."""
        run = run[:-1] & run[1:]
        return run, np.flatnonzero(run)

    def gram_hashes(self, a: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        h = self.hashes[a[at]]
        for j in range(1, k):
            h = h * np.uint64(_SHIFT) + self.hashes[a[at + j]]
        return h

    def count(self, parts: list[np.ndarray]) -> None:
        if not self.filters:
            n = np.bincount(np.concatenate(parts), minlength=len(self.names))
            n[:len(self.alone)] += self.alone
            self.alone = n
            return
        a, runs = self.places(parts)
        for k in range(2, self.longest + 1):
            run = runs[k - 1] if k <= len(runs) else self.longer(run)[0]
            at = np.flatnonzero(run)
            if len(at):
                grams, n = np.unique(np.stack([a[at + j] for j in range(k)], 1), axis=0, return_counts=True)
                for gram, times in zip(grams.tolist(), n.tolist()):
                    self.trie.add(tuple(gram), times)

    def _run(self, grams: list[tuple[tuple[int, ...], int]]) -> pa.RecordBatch:
        """Rows in the order of their texts."""
        names = self.names
        rows = sorted((names[g[0]][0], b" ".join([names[w][1] for w in g]), n) for g, n in grams)
        lang, text, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                          ["lang", "gram", "n"])

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        for grams in self.trie.spill(keep):
            yield self._run(grams)
        if keep == 0:
            seen = np.flatnonzero(self.alone[1:]) + 1
            for begin in range(0, len(seen), 20_000):
                part = seen[begin:begin + 20_000]
                yield self._run([((w,), n) for w, n in zip(part.tolist(), self.alone[part].tolist())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """Texts in lots of about ``BLOCK`` bytes; longer ones are cut at breaks, which no phrase spans."""
    lot, size = [], 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                data, at = (text or b"").translate(_PLAIN), 0
                while at < len(data):
                    stop = data.find(BREAK, at + BLOCK) if len(data) - at > BLOCK else -1
                    stop = len(data) if stop < 0 else stop
                    lot.append((lang, data[at:stop]))
                    size, at = size + stop - at, stop
                    if size >= BLOCK:
                        yield lot
                        lot, size = [], 0
    if lot:
        yield lot


def _counted(batches: Iterator[pa.RecordBatch], filters: list[Filter], longest: int, room: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(filters, longest)
    for lot in _blocks(batches):
        counter.count([counter.number(lang, data) for lang, data in lot])
        if len(counter.names) > WORDS:
            yield from counter.runs(0)
            counter.begin()
        elif counter.trie.entries > room:
            yield from counter.runs(room // 2)
    yield from counter.runs(0)


def _bucketed(batches: Iterator[pa.RecordBatch], filters: list[Filter], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """(span, offsets, counts): how often the grams of one word more than the filters have,
    and whose parts pass them, fell on each bit, up to ``least`` times, in the order of
    the bits."""
    counter, kind, mask = Counter(filters, 2), np.uint8 if least < 256 else np.uint32, np.uint64((1 << bits) - 1)
    keys, counts, pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def added():
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *pending]), return_counts=True)
        pending.clear()
        every = np.concatenate((keys, new))
        order = np.argsort(every, kind="stable")
        firsts = np.flatnonzero(np.diff(every[order], prepend=np.uint64(1 << 63)))
        if not len(firsts):
            return keys, counts
        return every[order][firsts], np.minimum(np.add.reduceat(np.concatenate((counts, n))[order], firsts), least)
    for lot in _blocks(batches):
        a, runs = counter.places([counter.number(lang, data) for lang, data in lot])
        pending.append(counter.gram_hashes(a, counter.longer(runs[-1])[1], len(filters) + 1) & mask)
        if len(counter.names) > WORDS:
            counter.begin()
        if sum(map(len, pending)) > PENDING:
            keys, counts = added()
    keys, counts = added()
    spans = (keys >> np.uint64(16)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(spans, prepend=-1)).tolist()
    offsets, counts = (keys & np.uint64(SPAN - 1)).astype("<u2"), counts.astype(kind)
    for begin in range(0, len(cuts), 200):
        some = list(zip(cuts[begin:begin + 200], [*cuts[begin + 1:begin + 201], *[len(keys)][:len(cuts) - begin <= 200]]))
        yield pa.RecordBatch.from_arrays([
            pa.array(spans[[x for x, _ in some]], pa.int64()), pa.array([offsets[x:y].tobytes() for x, y in some], pa.binary()),
            pa.array([counts[x:y].tobytes() for x, y in some], pa.binary())], ["span", "offsets", "counts"])


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(span, bits): the bits of a span that were met ``least`` times in all. Counts stop
    there, so a byte or four are enough for each."""
    kind, sums = np.uint8 if least < 256 else np.uint32, {}
    for batch in batches:
        for span, offsets, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if span not in sums:
                sums[span] = np.zeros(SPAN, kind)
            at = np.frombuffer(offsets, "<u2")
            sums[span][at] = np.minimum(sums[span][at].astype(np.int64) + np.frombuffer(counts, kind), least)
    full = [(span, np.packbits(n >= least, bitorder="little").tobytes()) for span, n in sums.items() if (n >= least).any()]
    if full:
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in full], pa.int64()), pa.array([f[1] for f in full], pa.binary())], ["span", "bits"])


def _gram_filter(docs: DataFrame, filters: list[tuple], n_words: int, min_count: int) -> tuple[int, list[tuple[int, bytes]]]:
    """The filter of grams of one word more: a bit is set if the grams that fall on it are
    met ``min_count`` times together. Its size follows the number of words, so that few
    rare grams share a bit, up to 2^28 bits (32 MB); beyond that it lets more through."""
    bits = min(FILTER_BITS, max(16, (16 * n_words // min_count).bit_length()))
    shared = [docs.sparkSession.sparkContext.broadcast(f) for f in filters]
    met = docs.mapInArrow(lambda it: _bucketed(it, [Filter(*s.value) for s in shared], bits, min_count),
                          "span bigint, offsets binary, counts binary")
    full = met.repartition("span").mapInArrow(lambda it: _summed(it, min_count), "span bigint, bits binary")
    return bits, [(r["span"], bytes(r["bits"])) for r in full.collect()]


def _merged(docs: DataFrame, filters: list, longest: int, room: int) -> DataFrame:
    """(lang, gram, n): the runs of all tasks, merged per prefix partition."""
    shared = [docs.sparkSession.sparkContext.broadcast(f) for f in filters]
    runs = docs.mapInArrow(lambda it: _counted(it, [Filter(*s.value) for s in shared], longest, room), "lang string, gram string, n bigint")
    dealt = runs.withColumn("prefix", F.substring_index("gram", " ", 2)).withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(SLICES)))
    return dealt.repartition("lang", "prefix", "slice").groupBy("lang", "prefix", "slice", "gram").agg(F.sum("n").alias("n")).select("lang", "gram", "n")


def _word_filter(often: DataFrame) -> tuple[int, list[tuple[int, bytes]]]:
    """Bits of the often-met words; 32 bits each, 2^28 (32 MB) at most. A full filter lets
    more through, which costs time and changes no count."""
    bits = min(FILTER_BITS, max(15, (32 * often.count()).bit_length()))
    key = F.crc32(F.concat_ws("\0", "lang", "gram").cast("binary")) % (1 << bits) + 1
    blocks = often.select(key.alias("key")).groupBy(F.bitmap_bucket_number("key").alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("block"))
    return bits, [(r["number"] - 1, bytes(r["block"])) for r in blocks.collect()]


def frequent_grams(docs: DataFrame, min_count: int = 100, longest: int = 5, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, n) of all phrases of 1 to ``longest`` words met ``min_count`` times,
    (lang, n) of all words). A phrase is only counted if its words, and the bits of its
    pairs and triples, are met that often; all counts that are given are exact."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    words = cut_lineage(_merged(rows, [], 1, room))
    often = F.col("n") >= min_count
    n_words = words.agg(F.sum("n")).first()[0] or 0
    filters = [_word_filter(words.filter(often))]
    while len(filters) < min(longest, 3):
        filters.append(_gram_filter(rows, filters, n_words, min_count))
    phrases = cut_lineage(_merged(rows, filters, longest, room).filter(often))
    return words.filter(often).unionByName(phrases), words.groupBy("lang").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, room: int = ROOM) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of every language: (lang, rank, phrase,
    a, l, r, n, score), a phrase's score being that of its weakest cut in two.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends; counts are per
    language. Phrases inside a longer one that is met as often are left out. A null lang
    counts as ``und``, a null or empty text has no words; repeated rows count each, other
    columns are not read, an empty table gives no row. Equal scores go by count, then by
    the phrase's bytes.

    Four passes over the texts: words are counted; pairs of often-met words, then triples
    of such pairs, are summed on the bits of a filter; phrases whose parts all pass are
    counted exactly, in a trie per task. Filters have a fixed greatest size and only ever
    spare work. A prefix's grams are spread over slices, and ranks come from one range sort of
    all languages, so no language or prefix lands in one task."""
    grams, totals = frequent_grams(docs, min_count, longest, room)
    words = F.split("gram", " ")
    phrases = grams.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), words.alias("w")).filter(F.size("w") > 1)
    # a longer phrase met as often passes that on to its two longest parts, so those are all that must be looked at
    parts = phrases.filter(F.size("w") > 2).select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("w", 1, F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    inside = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = phrases.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    sides = [grams.select("lang", F.col("gram").alias(side), F.col("n").alias(n)) for side, n in (("first", "l"), ("rest", "r"))]
    cuts = cuts.join(sides[0], ["lang", "first"]).join(sides[1], ["lang", "rest"]).select("lang", "phrase", "a", "k", "l", "r")
    with_n = joined_to(cut_lineage(cuts), cut_lineage(totals), "lang")
    whole = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000 * {whole('a')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    weakest = with_n.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    placed = cut_lineage(number_globally(rows, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "_place"))
    firsts = cut_lineage(placed.groupBy("lang").agg(F.min("_place").alias("_first")))
    ranked = joined_to(placed, firsts, "lang").withColumn("rank", F.col("_place") - F.col("_first") + 1).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
