"""Encoding to and decoding from the pieces of a SentencePiece model, by a shared-prefix Viterbi search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
STAND_IN = "\ud800"  # for a mark in the text: half a surrogate pair, which no UTF-8 text has
HELD = 100_000  # words in each of the two generations a task remembers
LOT = 1000      # rows whose words are sorted and searched together


class Pieces:
    """The model's pieces and scores. A character that no piece spells, and a mark that
    stands in the text itself, becomes its UTF-8 bytes' pieces.

    Ids of words are remembered in two generations: when the younger one is full it
    becomes the older one, and a word met again moves back, so frequent words stay."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in n if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.score = {model.id_to_piece(i): (model.get_score(i), i) for i in n
                      if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.text = {i: p for p, (_, i) in self.score.items()}
        self.fallback = min(s for s, _ in self.score.values()) - 1
        spelled = [
            self.text[i].replace(MARK, " ").encode() if i in self.text else bytes([self.of_byte[i]]) if i in self.of_byte else b"" for i in n]
        self.sizes = np.array([len(x) for x in spelled])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def trie(self) -> list:
        """Children by character, score and id of the piece that ends here; encoding needs it."""
        root: list = [{}, None, None]
        for piece, (score, i) in self.score.items():
            node = root
            for c in piece:
                node = node[0].setdefault(c, [{}, None, None])
            node[1:] = score, i
        return root

    def _raw(self, c: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if c == STAND_IN else c).encode()]

    def search(self, words: list[str]) -> dict[str, bytes]:
        """Best ids of every word, which is read behind a mark. In sorted order the words are
        a depth-first walk through their trie: for the prefix shared with the word before,
        the forward scores stay, and so do the places in the piece trie of all pieces
        that are still open there."""
        found = {}
        firsts = self.trie[0].get
        best, back, opened, last = [0.0], [(0, None)], [[]], ""
        for word in sorted(words):
            marked = MARK + word
            keep = len(commonprefix((marked, last)))
            del best[keep + 1:], back[keep + 1:], opened[keep + 1:]
            now = opened[keep]
            for end in range(keep, len(marked)):
                c, still = marked[end], []
                top, begin_of, piece = best[end] + self.fallback, end, None
                for begin, (children, _, _) in now:
                    node = children.get(c)
                    if node is not None:
                        still.append((begin, node))
                        if node[1] is not None and best[begin] + node[1] > top:
                            top, begin_of, piece = best[begin] + node[1], begin, node[2]
                node = firsts(c)
                if node is not None:
                    still.append((end, node))
                    if node[1] is not None and best[end] + node[1] > top:
                        top, begin_of, piece = best[end] + node[1], end, node[2]
                best.append(top)
                back.append((begin_of, piece))
                opened.append(still)
                now = still
            ids, at = [], len(marked)
            while at:
                begin, piece = back[at]
                if piece is None:
                    ids += reversed(self._raw(marked[at - 1]))
                else:
                    ids.append(piece)
                at = begin
            found[word] = np.array(ids[::-1], "<i4").tobytes()
            last = marked
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids, 32 bits each."""
        split = [t.replace(MARK, STAND_IN).split(" ") if t else [] for t in texts]
        met = {w for s in split for w in s}
        if len(self.young) > HELD:
            self.young, self.old = {}, self.young
        fresh = met - self.young.keys()
        again = fresh & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        self.young.update(self.search(fresh - again))
        ids = self.young.__getitem__
        return [b"".join(map(ids, s)) for s in split]

    def decode(self, rows: list[bytes]) -> list[str]:
        """The texts of rows of ids, spelled all at once."""
        ids = np.frombuffer(b"".join(rows), "<i4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + sizes, sizes)
        flat = self.spelled[at].tobytes()
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *(len(r) // 4 for r in rows)])].tolist()
        return [flat[a:b].decode()[1:] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, LOT):
            part = batch.slice(begin, LOT)
            ids = pieces(path).encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row, ids as 32-bit little-endian; none for null and empty texts.

    A task sorts the distinct words of its next rows that it does not remember and searches
    them in one walk; a word of any length costs time in proportion to it. Repeated
    rows and null ids give a row each, other columns are not read, an empty table gives
    no row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, path), f"doc_id {kind}, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            texts = pieces(path).decode([i or b"" for i in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of every row of ``encode``; where there are no ids, or null, the
    text is empty, also for a text that was null. Repeated rows give a row each, other
    columns are not read, an empty table gives no row."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, path), f"doc_id {kind}, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Number and crc32 of the ids, length and crc32 of the text they give back."""
    return decoded.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.char_length("text").cast("bigint").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
