"""Quality rules: repeated windows, and distance of a text's histograms from its language's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import joined_to, words_of
from surveyloom.session import cut_lineage

# fixed values: frequent function words of English, German, French and Spanish
COMMON_WORDS = (
    "the of and to in a is that it for on was be with as this by at are an from or have not you which his had but they "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach "
    "le la les un une et est en que dans du pour pas au qui sur ce il par plus ne se son avec "
    "el los las y por del lo su al como más pero sus le ya o este si porque entre cuando muy sin sobre"
).split()

CLASSES = ("lower", "blank", "upper", "digit", "mark", "symbol", "letter", "other")
#: What is taken out of a text one after the other; each pattern sees only what the earlier ones left.
CLASS_RUNS = ("[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()\-]+", "[#*$%&|<>]+", r"\p{L}+")

MIN_CHAR_WORDS, MAX_CHAR_DIVERGENCE = 20, 0.08
MIN_COMMON_WORDS, MAX_COMMON_DIVERGENCE = 80, 0.10


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document (``_doc`` with the columns to keep), from one pass over its whole text: counts of
    the base rules, characters per class and common words found. All built-in
    expressions; nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.select(F.struct(*keep).alias("_doc"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), text.alias("_t0"))
    at = at.withColumn("_words", words_of(F.col("_t0")))
    for i, run in enumerate(CLASS_RUNS):
        at = at.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", run, ""))
    left = [F.length(f"_t{i}") for i in range(len(CLASS_RUNS) + 1)]
    counts = [left[i] - left[i + 1] for i in range(len(CLASS_RUNS))] + [left[-1]]
    lines = F.filter(F.split("_t0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hits = F.transform(F.filter("_words", lambda w: F.lower(w).isin(COMMON_WORDS)), F.lower)
    at = at.select(
        "_doc", "lang", F.size("_words").cast("bigint").alias("n_words"),
        (left[0] - counts[1]).cast("bigint").alias("word_chars"), counts[5].cast("bigint").alias("n_symbols"),
        lines.alias("_lines"), F.array(*[c.cast("double") for c in counts]).alias("chars"),
        F.sort_array(hits).alias("_hits"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    at = at.withColumn("_kinds", F.array_distinct("_hits")).withColumn("_windows", F.when(F.size("_hashes") >= 5, F.transform(
        F.sequence(F.lit(1), F.size("_hashes") - 4),
        lambda i: F.xxhash64(*[F.element_at("_hashes", (i + k).cast("int")) for k in range(5)]))))
    repeats = F.col("_windows").isNotNull() & (F.size(F.array_distinct("_windows")) < F.size("_windows"))
    at = at.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: (
        F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False)))
    at = at.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"])))
    covered = F.transform("_starts", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_starts", k + 1) - p, F.lit(5))))
    ends = lambda w, k: F.coalesce(F.array_position("_hits", F.get("_kinds", k + 1)), F.size("_hits") + 1)
    return at.select(
        "_doc", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "chars", F.transform("_kinds", lambda w, k: F.struct(
            w.alias("word"), (ends(w, k) - F.array_position("_hits", w)).cast("double").alias("n"))).alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def language_references(features: DataFrame) -> DataFrame:
    """(lang, chars_ref, common_ref): mean histograms of the documents that pass the
    base rule and have enough words, for every language that has one and, under a
    null lang, for all."""
    solid = features.filter(~base_failed() & (F.col("n_words") >= MIN_CHAR_WORDS)).select(
        F.explode(F.array(F.col("lang"), F.lit(None).cast("string"))).alias("lang"), "n_words", "chars", "common")
    total = reduce(lambda a, b: a + b, [F.col("chars")[i] for i in range(len(CLASSES))])
    sums = solid.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("chars")[i] / total).alias(c) for i, c in enumerate(CLASSES)])
    seen = solid.select("lang", "n_words", F.explode("common").alias("c")).groupBy("lang", "c.word").agg(
        F.sum(F.col("c.n") / F.col("n_words")).alias("share"))
    maps = seen.groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "share")))).alias("common_ref"))
    return sums.join(maps, sums["lang"].eqNullSafe(maps["lang"]), "left").select(
        sums["lang"], F.array(*[F.col(c) / F.col("n") for c in CLASSES]).alias("chars_ref"),
        F.transform_values(F.coalesce("common_ref", F.create_map().cast("map<string,double>")),
                           lambda _, v: v / F.col("n")).alias("common_ref"))


def _half_terms(p: Column, q: Column) -> Column:
    """The terms of one bin of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A text's histograms of character classes and of common words (all other words
    form one bin) are held against the means of its language by Jensen-Shannon
    divergence (0 to 1). A divergence is null, and never rejects, below its least
    number of words: 20 for characters, 80 for words. A null text has no words and
    fails the base rule; every language, null ones together, has its own reference;
    without a document to make one, that of all documents is used. Repeated rows
    are judged one by one. An empty table gives an empty result."""
    features = cut_lineage(text_features(docs, keep))
    refs = cut_lineage(language_references(features))
    whole = refs.filter("lang IS NULL").select(F.struct("chars_ref", "common_ref").alias("r")).scalar()  # one row or none
    own = refs.filter("lang IS NOT NULL").select("lang", F.col("chars_ref").alias("_cl"), F.col("common_ref").alias("_wl"))
    at = joined_to(features, own, "lang").withColumn("_whole", whole)
    at = at.withColumn("_c", F.coalesce("_cl", "_whole.chars_ref")).withColumn("_w", F.coalesce("_wl", "_whole.common_ref"))
    total = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    char_terms = F.zip_with("chars", "_c", lambda n, q: _half_terms(n / F.col("_total"), q))
    share = F.transform("common", lambda x: F.struct(
        (x["n"] / F.col("n_words")).alias("p"), F.coalesce(F.element_at("_w", x["word"]), F.lit(0.0)).alias("q")))
    at = at.withColumn("_total", total).withColumn("_share", share)
    p_rest = F.greatest(F.lit(0.0), 1 - _total(F.transform("_share", lambda x: x["p"])))
    q_all = _total(F.map_values("_w"))
    q_seen = _total(F.transform("_share", lambda x: x["q"]))
    words = (_total(F.transform("_share", lambda x: _half_terms(x["p"], x["q"])))
             + _half_terms(p_rest, F.greatest(F.lit(0.0), 1 - q_all)) + F.greatest(F.lit(0.0), q_all - q_seen) / 2)
    at = at.withColumn("char_divergence", F.when(
        (F.col("n_words") >= MIN_CHAR_WORDS) & (F.col("_total") > 0), F.round(_total(char_terms), 9)))
    at = at.withColumn("word_divergence", F.when(F.col("n_words") >= MIN_COMMON_WORDS, F.round(words, 9)))
    far = F.coalesce(F.col("char_divergence") > MAX_CHAR_DIVERGENCE, F.lit(False)) | F.coalesce(
        F.col("word_divergence") > MAX_COMMON_DIVERGENCE, F.lit(False))
    return at.select(
        "_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~far).alias("kept"), "char_divergence", "word_divergence")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both divergences of every row."""
    at = _judged(docs, ["doc_id"])
    return at.select("_doc.doc_id", *[c for c in at.columns if c != "_doc"])


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Null ids are judged
    like any other, null and empty texts go with the base rules, repeated rows stay or go
    together; an empty table stays empty."""
    at = _judged(docs, docs.columns).filter("kept")
    return at.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
