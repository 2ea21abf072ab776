"""Held-out accuracy, calibration and the defined results of odd inputs."""

import zlib

import numpy as np
import pytest

from surveyloom.llm import toxicity

SF = "/root/testdata/sf0.1"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def area(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.score(docs, labels).toPandas(), labels.toPandas()


def test_every_row_and_held_out_accuracy(scored):
    got, labels = scored
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [held_out(i) for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    test = both[both["held_out"]]
    y = test["toxic"].to_numpy()
    assert area(y, test["score"].to_numpy()) > 0.98
    assert test["predicted"][y == 1].mean() > 0.9 and test["predicted"][y == 0].mean() < 0.03
    assert abs(test["score"].mean() - y.mean()) < 0.03


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(600)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, " \n"), (None, "idiot"), (-4, "a " * 100_000), (-5, "idiot"), (-5, "idiot")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "1 AS _doc", "'x' AS score", "2 AS toxic")
    got = toxicity.score(rows, labels).collect()
    assert len(got) == 607
    empty = {r["score"] for r in got if r["doc_id"] in (-1, -2, -3)}
    assert len(empty) == 1 and len({r["score"] for r in got if r["doc_id"] == -5}) == 1
    kept = toxicity.keep(rows, labels)
    assert kept.columns == rows.columns and kept.count() == sum(r["score"] < 0.3 for r in got)
    none = toxicity.score(rows, labels.filter("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score(rows.limit(0), labels).count() == 0 and toxicity.score(rows, labels.limit(0)).count() == 607


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_hidden_words_are_found():
    table = toxicity.WordTable({"idiot": 5.0, "lowei~": 4.0})
    names = dict(zip(toxicity.FEATURES, range(99)))
    for word, name in (("Idiot,", "hits"), ("1d1ot", "hidden_hits"), ("idi*ot", "hidden_hits"), ("idiiiot", "hidden_hits"), ("loweischaft", "hits")):
        assert table.features(f"you are {word} there")[names[name]] == 1, word
    assert table.features("you big idiot")[names["near_second"]] == 1
    assert table.features("you " + "x " * 9 + "idiot")[names["near_second"]] == 0


def test_isotonic_and_trees():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = (rng.random(3000) < x[:, 1] ** 2).astype(float)
    model = toxicity.fit_trees(x, y)
    raw = model.raw(x)
    knots, values = toxicity.fit_isotonic(raw, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()
    assert abs(np.interp(raw, knots, values).mean() - y.mean()) < 0.02 and area(y, raw) > 0.7


def plain_features(lexicon, text):
    """The features by plain counting, a word at a time."""
    import re
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)

    def weigh(core):
        return max([lexicon.get(k, 0.0) for k in [core] + [core[:n] + "~" for n in (4, 5, 6) if len(core) > n]]) if len(core) > 2 else 0.0
    weights, hidden, seconds, odd = [], [], [], []
    for w in words:
        core = w.strip(toxicity.MARKS)
        odd.append(not core.isalpha() and re.search(r"[a-z][@4301!5$7*._-]+[a-z]", w.lower()) is not None)
        weights.append(weigh(core.lower()))
        shown = "".join(dict(zip("@4301!5$7", "aaeoiisst")).get(c, c) for c in w.lower())
        forms = (re.sub("[*._-]", "", shown).strip(toxicity.MARKS), re.sub(r"(.)\1+", r"\1", shown).strip(toxicity.MARKS))
        hidden.append(max(map(weigh, forms)) if weights[-1] == 0 and (odd[-1] or re.search(r"(.)\1\1", core)) else 0.0)
        seconds.append(core.lower() in toxicity.SECOND_PERSON)
    both = [a + b for a, b in zip(weights, hidden)]
    hit = [i for i, x in enumerate(both) if x]
    n, size = len(words), max(sum(map(len, words)), 1)
    letters = [sum(c.isalpha() for c in w) for w in words]
    uppers = [sum(c.isupper() for c in w.strip(toxicity.MARKS)) for w in words]
    return [len(hit), len(hit) / n, sum(both) / n, max(both), len({words[i] for i in hit}), sum(x > 0 for x in hidden),
            sum(any(abs(i - j) <= 4 for j, s in enumerate(seconds) if s) for i in hit), sum(seconds) / n,
            sum(u == k > 2 for u, k in zip(uppers, letters)) / n, sum(uppers) / size, sum(len(w) - k for w, k in zip(words, letters)) / size,
            sum(w.count("!") + w.count("?") for w in words) / size, sum(c.isdigit() for w in words for c in w.strip(toxicity.MARKS)) / size,
            sum(odd) / n, size / n, np.log1p(n)]


def test_features_equal_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    model = toxicity.fit(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    table = toxicity.WordTable(model.lexicon)
    texts = [None, "", "!!! ???", "YOU 1d1ot!!! you", "a.b.c d-e x" * 3, *[r["text"] for r in docs if len(r["text"] or "") < 3000]]
    for text in texts:
        assert table.features(text) == pytest.approx(plain_features(model.lexicon, text), abs=1e-9), text


def test_a_hot_id_brings_one_text(spark):
    """Repeated ids give the model one text each, whatever their number."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    hot = docs.join(labels, "doc_id", "left_semi").limit(1)
    many = hot.crossJoin(spark.range(3000)).drop("id").unionByName(docs)
    again = toxicity.fit(many, labels)
    assert again.lexicon == model.lexicon and np.array_equal(again.knots[1], model.knots[1])
