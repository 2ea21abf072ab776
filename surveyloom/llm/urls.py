"""URL verdicts: host and path rules, and a ratio of two character language models elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import joined_to
from surveyloom.session import cut_lineage

#: (action, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4           # longest gram: three characters of context and the next one
DISCOUNT = 2.0      # weight of the shorter context in each estimate
MIN_COUNT = 3       # rarer grams back off to their shorter context
BINS = 400          # resolution of the calibration, over scores from -4 to 4
START = "^"
FOLDS = 5           # parts of the ruled URLs by hash: 0 calibrates the cut, 1 is held out for the error, the others train


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null if none does."""
    rule = action = F.lit(None).cast("string")
    for kind, of_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(prefix)
        rule, action = F.when(fits, of_host + prefix).otherwise(rule), F.when(fits, kind).otherwise(action)
    return rule, action


def _unruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Host and path without what any rule names: the longest such host at the host's end
    and the longest such prefix at the path's start."""
    own, rest = host, path
    for name in sorted({h for _, h, _ in rules}, key=len):
        own = F.when((host == name) | host.endswith("." + name), F.substring(host, F.lit(1), F.length(host) - len(name))).otherwise(own)
    for prefix in sorted({p for _, _, p in rules}, key=len):
        rest = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(rest)
    return own, rest


def _symbols(host: Column, path: Column) -> Column:
    """What the models read: digits are one symbol, characters beyond ASCII another."""
    plain = F.lower(F.concat(host, F.lit("/"), path))
    return F.regexp_replace(F.regexp_replace(plain, "[0-9]", "0"), r"[^\x21-\x7e]", "?")


def _positions(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row per character: its grams g1 … gN, which end in it, and their contexts c1 … c(N-1)."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("_text"))
    at = rows.filter(F.length("_text") > 0).withColumn("_padded", padded).select(
        *keep, "_padded", F.explode(F.sequence(F.lit(ORDER), F.length("_padded"))).alias("_i"))
    part = lambda start, n: F.substring(F.col("_padded"), start, F.lit(n))
    return at.select(
        *keep, *[part(F.col("_i") - k + 1, k).alias(f"g{k}") for k in range(1, ORDER + 1)],
        *[part(F.col("_i") - k, k).alias(f"c{k}") for k in range(1, ORDER)])


def train(labelled: DataFrame) -> DataFrame:
    """Model table (gram, ratio, back) from rows (_text, action).

    Both languages are estimated by p(x | context) = (n(context x) + d p(x | shorter
    context)) / (n(context) + d). ``ratio`` is ln p_block - ln p_allow of a gram;
    ``back`` is what a context adds when the gram itself was not kept. Counts come
    from all rows, by partial sums; every gram of ``MIN_COUNT`` and more, and every
    character, is kept, in a stored table."""
    at = _positions(labelled, ["action"])
    names = [f"g{k}" for k in range(1, ORDER + 1)]
    block = F.when(F.col("action") == "block", 1).otherwise(0)
    # the last gram of a position decides all shorter ones: count it first, then split it
    longest = at.groupBy(F.col(names[-1])).agg(F.sum(block).alias("b"), F.sum(1 - block).alias("a"))
    last = lambda n: F.substring(F.col(names[-1]), ORDER - n + 1, n)
    grams = longest.select(F.explode(F.array(*[F.struct(last(k).alias("gram"), F.lit(k).alias("k"), F.substring(
        F.col(names[-1]), ORDER - k + 1, k - 1).alias("context")) for k in range(1, ORDER + 1)])).alias("g"), "b", "a").select("g.*", "b", "a")
    grams = cut_lineage(grams.groupBy("gram", "k", "context").agg(F.sum("b").alias("b"), F.sum("a").alias("a")))
    contexts = grams.groupBy("context").agg(F.sum("b").alias("cb"), F.sum("a").alias("ca"))
    kept = grams.filter((F.col("k") == 1) | (F.col("b") + F.col("a") >= MIN_COUNT))
    kept = cut_lineage(kept.join(contexts, "context"))
    alphabet = kept.filter("k = 1").agg(F.count(F.lit(1)).alias("size")).scalar()
    known = kept.filter("k = 1").withColumn("size", alphabet).select("gram", *[
            ((F.col(n) + DISCOUNT / (F.col("size") + 1)) / (F.col("c" + n) + DISCOUNT)).alias("p" + n) for n in "ba"])
    levels = [known]
    for k in range(2, ORDER + 1):
        shorter = levels[-1].select(F.col("gram").alias("_short"), F.col("pb").alias("_pb"), F.col("pa").alias("_pa"))
        step = kept.filter(F.col("k") == k).withColumn("_short", F.substring("gram", 2, k - 1)).join(shorter, "_short")
        levels.append(step.select("gram", *[
            ((F.col(n) + DISCOUNT * F.col("_p" + n)) / (F.col("c" + n) + DISCOUNT)).alias("p" + n) for n in "ba"]))
    model = levels[0]
    for level in levels[1:]:
        model = model.unionByName(level)
    model = model.select("gram", (F.log("pb") - F.log("pa")).alias("ratio"))
    # a context of two characters and more is itself a gram or unseen
    back = contexts.filter((F.length("context") >= 1)).join(model.select(F.col("gram").alias("context")), "context", "left_semi").select(
        F.col("context").alias("gram"), (F.log(F.col("ca") + DISCOUNT) - F.log(F.col("cb") + DISCOUNT)).alias("back"))
    return cut_lineage(model.join(back, "gram", "left").select("gram", "ratio", F.coalesce("back", F.lit(0.0)).alias("back")))


def _values(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(g4, value): the log ratio of the last character of every gram of length ``ORDER``,
    which ends in all shorter grams and contexts of its place. A key meets no more
    of them than there are symbols to the power of what it leaves open."""
    n = f"g{ORDER}"
    last = lambda k, of: F.substring(F.col(n), ORDER - k + 1, of)
    at = grams
    for k in range(1, ORDER + 1):
        at = at.withColumn("gram", last(k, k)).join(model.select("gram", F.col("ratio").alias(f"r{k}")), "gram", "left").drop("gram")
    for k in range(1, ORDER):
        at = at.withColumn("gram", last(k + 1, k)).join(model.select("gram", F.col("back").alias(f"b{k}")), "gram", "left").drop("gram")
    value = F.coalesce("r1", F.lit(0.0))
    for k in range(2, ORDER + 1):
        value = F.coalesce(F.col(f"r{k}"), F.coalesce(F.col(f"b{k - 1}"), F.lit(0.0)) + value)
    return cut_lineage(at.select(n, value.alias("value")))


def score(rows: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, score): mean log ratio per character; above 0 the text reads like a
    rejected URL. Equal grams of a URL are folded first; distinct grams are looked up
    in the model, and their values joined back, by tables whose size decides how."""
    n = f"g{ORDER}"
    folded = cut_lineage(_positions(rows, [key]).groupBy(key, n).agg(F.count(F.lit(1)).alias("times")))
    met = joined_to(folded, _values(folded.select(n).distinct(), model), n)
    return met.groupBy(key).agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("score"))


def _cut(scored: DataFrame) -> float:
    """The score that parts accepted from rejected URLs with the least mean error of both
    kinds, from a histogram of ``BINS`` bins over all of them; 0, where both models read
    a URL alike, if one kind is missing."""
    bin_of = F.least(F.greatest(F.floor((F.col("score") + 4) * BINS / 8), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bin_of.alias("bin"), "action").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * BINS rows
    count = {(r["bin"], r["action"]): r["n"] for r in rows}
    total = {a: sum(n for (_, k), n in count.items() if k == a) for a in ("block", "allow")}
    if not total["block"] or not total["allow"]:
        return 0.0
    best, low = [], {"block": 0, "allow": 0}
    for i in range(BINS + 1):
        error = low["block"] / total["block"] + 1 - low["allow"] / total["allow"]
        best.append((round(error, 12), abs(i - BINS // 2), i))
        for a in low:
            low[a] += count.get((i, a), 0)
    return min(best)[2] * 8 / BINS - 4


def _scored(pages: DataFrame, id_col: str, url_col: str, rules) -> tuple[DataFrame, float]:
    """Every row with host, path, rule, action, fold and score, and the cut."""
    host, path = host_and_path(F.col(url_col))
    at = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    text = F.when((F.col("host") != "") | (F.col("path") != ""), _symbols(*_unruled(F.col("host"), F.col("path"), rules))).otherwise("")
    at = cut_lineage(at.withColumn("rule", rule).withColumn("action", action).withColumn("_text", text).withColumn(
        "_fold", F.pmod(F.xxhash64("_text", F.lit(10)), F.lit(FOLDS))).withColumn("_row", F.monotonically_increasing_id()))
    training = at.filter("action IS NOT NULL AND _fold > 1")
    sides = training.agg(F.count_if(F.col("action") == "block").alias("block"), F.count_if(F.col("action") == "allow").alias("allow")).first()
    scored = cut_lineage(at.join(score(at, train(training), "_row"), "_row", "left"))
    if not sides["block"] or not sides["allow"]:
        return scored, float("inf")
    return scored, _cut(scored.filter("action IS NOT NULL AND score IS NOT NULL AND _fold = 0"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    URLs that a rule decides train the models: accepted by allow rules, rejected by
    block rules. What the rules themselves name is left out of all texts, so the models
    learn what else such URLs have in common. The cut is calibrated on a fold of the ruled
    URLs that no model has read (equal texts share a fold). Other URLs are blocked if
    their mean log ratio per character is at least the cut. Null URLs, URLs without
    ``://`` and those with neither host nor path have a null score and are allowed; so is
    everything the rules leave open when one side has no training URL. Repeated rows are
    judged one by one; an empty table gives no row."""
    scored, cut = _scored(pages, id_col, url_col, rules)
    guess = F.when(F.col("score") >= cut, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("action", guess).alias("verdict"), "score")


def held_out_error(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(action, n, wrong): ruled URLs that neither trained nor calibrated, and how many of
    them the models alone would judge otherwise than their rule."""
    scored, cut = _scored(pages, id_col, url_col, rules)
    own = scored.filter("action IS NOT NULL AND score IS NOT NULL AND _fold = 1")
    blocked = F.col("score") >= cut
    return own.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if(blocked != (F.col("action") == "block")).alias("wrong"))
