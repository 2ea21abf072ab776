"""Toxicity of whole texts: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import remainder
from surveyloom.session import cut_lineage

FIT_ROWS = 8000         # labelled rows the classifier is fitted on, at most, by hash order of doc_id
FOLDS = 3
THRESHOLD = 0.3
CACHED_WORDS = 400_000
PREFIXES = (4, 5, 6)    # a word is looked up whole and by its first letters
NEAR = 4                # words between a second person and a lexicon word
MARKS = ".,;:!?*|#$%&()[]{}<>\"'`~^_-+=/\\"

# fixed values: second-person words of English, German, French and Spanish
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos "
                          "tú usted ustedes ti tus su vosotros os".split())
PLAIN = str.maketrans("@4301!5$7", "aaeoiisst")
_TRIPLE, _INNER, _REPEATED = re.compile(r"(.)\1\1"), re.compile(r"[*._-]"), re.compile(r"(.)\1+")
_OBFUSCATED = re.compile(r"[a-z][@4301!5$7*._-]+[a-z]")

WORD_COLUMNS = ("weight", "hidden", "second", "capital", "upper", "letters", "digits", "marks", "loud", "obfuscated", "one")
FEATURES = ("hits", "density", "weight_density", "heaviest", "distinct", "hidden_hits", "near_second", "second_rate", "capital_rate",
            "upper_rate", "mark_rate", "loud_rate", "digit_rate", "obfuscated_rate", "word_length", "size")


def entries_of(word: str) -> list[str]:
    """Lexicon keys of a word: itself and its beginnings."""
    core = word.strip(MARKS).lower()
    return [core, *[core[:k] + "~" for k in PREFIXES if len(core) > k]] if len(core) > 2 else []


class WordTable(dict):
    """Row number of each word in ``rows``, a table of its features; starts anew when
    too large (between texts only)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows = lexicon, np.zeros((1024, len(WORD_COLUMNS)))

    def weigh(self, core: str) -> float:
        if len(core) < 3:
            return 0.0
        get = self.lexicon.get
        return max([get(core, 0.0), *[get(core[:k] + "~", 0.0) for k in PREFIXES if len(core) > k]])

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        core = word.strip(MARKS)
        plain = core.isalpha()
        weight, hidden, odd = self.weigh(core.lower()), 0.0, False
        if not plain:
            odd = _OBFUSCATED.search(word.lower()) is not None
        if weight == 0.0 and (odd or _TRIPLE.search(core)):
            shown = word.lower().translate(PLAIN)
            hidden = max(self.weigh(_INNER.sub("", shown).strip(MARKS)), self.weigh(_REPEATED.sub(r"\1", shown).strip(MARKS)))
        letters = len(core) if plain else sum(map(str.isalpha, word))
        upper = 0 if core.islower() else sum(map(str.isupper, core))
        self.rows[n] = (weight, hidden, core.lower() in SECOND_PERSON, upper == letters > 2, upper, letters,
                        0 if plain else sum(map(str.isdigit, core)), len(word) - letters, word.count("!") + word.count("?"), odd, 1)
        self[word] = n
        return n

    def features(self, text: str | None) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = (text or "").split()
        out = np.zeros(len(FEATURES))
        if not words:
            return out
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        rows = self.rows[at]
        n, total = len(words), rows.sum(axis=0)
        s = dict(zip(WORD_COLUMNS, total))
        weight = rows[:, 0] + rows[:, 1]
        hit = np.flatnonzero(weight)
        second = np.flatnonzero(rows[:, 2])
        near = 0
        if len(hit) and len(second):
            after = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(hit - second[np.minimum(after, len(second) - 1)]), np.abs(hit - second[np.maximum(after - 1, 0)]))
            near = int((gap <= NEAR).sum())
        size = max(s["letters"] + s["marks"], 1.0)
        out[:] = (len(hit), len(hit) / n, weight.sum() / n, weight.max(), len(np.unique(at[hit])), np.count_nonzero(rows[:, 1]), near,
                  s["second"] / n, s["capital"] / n, s["upper"] / size, s["marks"] / size, s["loud"] / size, s["digits"] / size,
                  s["obfuscated"] / n, size / n, np.log1p(n))
        return out


@dataclass
class Trees:
    """Boosted depth-limited trees on binned features, logistic loss, Newton leaves."""

    edges: list[np.ndarray]
    base: float
    splits: list[list[tuple[int, int]]]  # per tree, by node in breadth order: feature, last bin to the left
    leaves: list[np.ndarray]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, leaves in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            feature, cut = np.array(splits).T
            while node.size and node.min() < len(splits):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaves[node - len(splits)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(prior / (1 - prior))), [], [])
    at = model.binned(x)
    margin, width = np.full(len(y), model.base), bins + 1
    offset = np.arange(x.shape[1]) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight, node, splits = y - p, p * (1 - p), np.zeros(len(y), np.int64), []
        for level in range(depth):
            for k in range(2**level):
                mine = np.flatnonzero(node == 2**level - 1 + k)
                flat = (at[mine] + offset).ravel()
                many = x.shape[1]
                g = np.bincount(flat, np.repeat(gradient[mine], many), many * width).reshape(many, width).cumsum(1)
                h = np.bincount(flat, np.repeat(weight[mine], many), many * width).reshape(many, width).cumsum(1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g)**2 / (h[:, -1:] - h + ridge)
                feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
                splits.append((int(feature), int(cut)))
                node[mine] = 2 * node[mine] + 1 + (at[mine, feature] > cut)
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + ridge)
        model.splits.append(splits)
        model.leaves.append(value)
        margin += value[leaf]
    return model


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw, probability) of the rising step function nearest to the labels."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of raw
    for r, label in zip(raw[order], y[order]):
        blocks.append([label, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        # a trace of the raw margin keeps texts within a calibrated step in order
        return 0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw))


def lexicon_of(rows: list[tuple[str, list[int], list[int]]], toxic: list[int], clean: list[int], without: int | None) -> dict[str, float]:
    """Log odds of entries by document counts, leaving one fold out."""
    folds = [k for k in range(FOLDS) if k != without]
    t_all, c_all = sum(toxic[k] for k in folds) + 1, sum(clean[k] for k in folds) + 1
    out = {}
    for entry, t, c in rows:
        seen, other = sum(t[k] for k in folds), sum(c[k] for k in folds)
        weight = np.log((seen + 0.5) / t_all) - np.log((other + 0.5) / c_all)
        if seen >= 2 and weight > 1.5:
            out[entry] = float(weight)
    return out


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter() for _ in range(2 * FOLDS)]
    for batch in batches:
        for text, toxic, fold in zip(batch.column("text"), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()):
            counts[2 * fold + toxic].update({e for w in set((text.as_py() or "").split()) for e in entries_of(w)})
    names = list(set().union(*counts))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[
        pa.array([c[e] for e in names], pa.int64()) for c in counts]], ["entry", *[f"n{k}" for k in range(2 * FOLDS)]])


def _fold_features(batches: Iterator[pa.RecordBatch], lexicons: list[dict[str, float]]) -> Iterator[pa.RecordBatch]:
    tables = [WordTable(lexicon) for lexicon in lexicons]
    for batch in batches:
        x = [[*tables[fold].features(text.as_py()), toxic, fold] for text, toxic, fold in zip(
            batch.column("text"), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], ["x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most ``FIT_ROWS`` labelled rows outside the held-out part, one text of
    each: of an id's texts that of the least hash. The lexicon holds every entry of these
    rows that passes the test of its odds.

    The rows are split in folds. Features of a fold use a lexicon of the other folds,
    and calibration uses predictions of trees of the other folds, so neither has seen
    a row's own label. Without labels of both kinds every text scores the prior."""
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").filter(remainder(F.col("doc_id"), 4) != 2)
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    chosen = cut_lineage(chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")))
    # the chosen rows are at most FIT_ROWS short ones; of an id's texts one is kept, so there are no more of those
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = cut_lineage(met.groupBy("doc_id", "toxic", "fold").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic", "fold"))
    numbers = Counter({(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    toxic, clean = ([numbers[k, kind] for k in range(FOLDS)] for kind in (1, 0))
    prior = sum(toxic) / max(sum(toxic) + sum(clean), 1)
    if not sum(toxic) or not sum(clean):
        return Model({}, None, (np.zeros(1), np.zeros(1)), float(prior))
    names = [f"n{k}" for k in range(2 * FOLDS)]
    counted = rows.mapInArrow(_entry_counts, "entry string, " + ", ".join(f"{n} bigint" for n in names)).groupBy("entry").agg(
        *[F.sum(n).alias(n) for n in names])
    t, c = (sum(F.col(f"n{2 * k + kind}") for k in range(FOLDS)) for kind in (1, 0))
    odds = F.log((t + 0.5) / (sum(toxic) + 1)) - F.log((c + 0.5) / (sum(clean) + 1))
    best = counted.filter((t >= 2) & (odds > 1.5)).collect()  # words of at most FIT_ROWS texts
    entries = [(r["entry"], [r[f"n{2 * k + 1}"] for k in range(FOLDS)], [r[f"n{2 * k}"] for k in range(FOLDS)]) for r in best]
    lexicons = [lexicon_of(entries, toxic, clean, k) for k in range(FOLDS)]
    table = np.array([r["x"] for r in rows.mapInArrow(lambda it: _fold_features(it, lexicons), "x array<double>").collect()])
    table = table[np.lexsort(table.T)]  # the same order whatever task came first
    x, y, fold = table[:, :-2], table[:, -2], table[:, -1]
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if 0 < y[rest].sum() < rest.sum():
            raw[~rest] = fit_trees(x[rest], y[rest]).raw(x[~rest])
    return Model(lexicon_of(entries, toxic, clean, None), fit_trees(x, y), fit_isotonic(raw, y), float(prior))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = WordTable(model.lexicon)
    for batch in batches:
        x = np.array([table.features(t.as_py()) for t in batch.column("_text")]).reshape(-1, len(FEATURES))
        score = np.clip(model.scores(x), 0.0, 1.0)
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in batch.schema.names if n != "_text"], pa.array(score)], [
            *[n for n in batch.schema.names if n != "_text"], "_score"])


def _with_scores(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """``_doc`` (a struct of the columns) and ``_score`` of every row."""
    rows = docs.select(F.struct(*columns).alias("_doc"), F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("_doc").schema.add("_score", "double")
    return rows.mapInArrow(lambda it: _scored(it, shared.value), schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts get the
    score of a text without any word; rows with null doc_id count as not held out;
    repeated rows get one score each, all the same; an empty table gives no row."""
    at = _with_scores(docs, ["doc_id"], fit(docs, labels))
    return at.select("_doc.doc_id", (remainder(F.col("_doc.doc_id"), 4) == 2).alias("held_out"), F.col("_score").alias("score"),
                     (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; null ids
    and texts are judged like any other, repeated rows stay or go together."""
    at = _with_scores(docs, docs.columns, fit(docs, labels)).filter(F.col("_score") < THRESHOLD)
    return at.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
