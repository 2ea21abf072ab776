"""Secrets in texts: certain patterns, and weak parts that count only beside what completes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import numbered

# fixed values: the patterns of the base kinds, in listing order
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Weak parts: kind, role, pattern. None is reported alone.
WEAK = (
    ("login", "id", r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)\b)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""),
    ("phrase", "secret", r"""(?i:\b(?:password|passwd|passphrase|pwd|pin|secret|private_?key|auth)\b)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{4,}"""),
    ("blob", "secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z/+]*[0-9])(?=[0-9a-z/+]*[A-Z])(?=[0-9A-Z/+]*[a-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"),
    ("endpoint", "endpoint", r"\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+"),
    ("address", "endpoint", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])"),
)
#: The strong kinds by listing order, their roles in linking, then the weak kinds.
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {k: r for k, r, _ in WEAK}
BASE = ("assign", "access", "hex")
RANK = {k: i for i, k in enumerate(ROLES)}
ROLE_NAMES = ("id", "secret", "endpoint")
SCOPE = 256  # parts with at most so many code points between them share a scope


def spans_of(text: Column, pattern: str, least: int = 0) -> tuple[Column, Column]:
    """(matches, pieces): all leftmost matches and the texts between them; the
    place of a match is the length of all that stands before it."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _found(rows: DataFrame, kind: str, pattern: str, group: int | None = None) -> DataFrame:
    """Adds ``kind``: array of (start, end) of the matches in ``_text``; the regular
    expression runs over a text only if a first look finds a match."""
    text = F.when(F.col("_text").rlike(pattern), F.col("_text"))
    rows = rows.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).withColumn("_p", F.split(text, pattern, -1))
    if group is not None:
        rows = rows.withColumn("_g", F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    # lengths before each match, as a running sum over the few matches of a text
    steps = F.transform("_m", lambda m, i: F.length(F.get("_p", i)) + F.when(i > 0, F.length(F.get("_m", i - 1))).otherwise(0))
    rows = rows.withColumn("_s", steps)
    starts = F.aggregate(
        "_s", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all")), lambda a: a["all"])
    rows = rows.withColumn("_starts", starts)
    spans = F.transform("_m", lambda m, i: F.struct(
        F.get("_starts", i).alias("s"), (F.get("_starts", i) + F.length(m)).alias("e"),
        (F.length(F.get("_g", i)) if group is not None else F.lit(ASSIGN_LEAST)).alias("n")))
    kept = F.transform(F.filter(spans, lambda x: x["n"] >= ASSIGN_LEAST), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return rows.withColumn(kind, F.coalesce(kept, empty)).drop("_m", "_p", "_g", "_s", "_starts")


def parts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One stored row per document: _row, ``_doc`` with the columns to keep, and an
    array of spans per kind."""
    rows = docs.select(F.struct(*keep).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = _found(rows, "assign", ASSIGN, 2)
    rows = _found(rows, "access", ACCESS)
    rows = _found(rows, "hex", HEX)
    for kind, _, pattern in WEAK:
        rows = _found(rows, kind, pattern)
    return numbered(rows.drop("_text"))


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(
        F.lit(kind).alias("kind"), F.lit(ROLES[kind]).alias("role"), x["s"].alias("start"), x["e"].alias("end")))


def linked_weak(found: DataFrame) -> DataFrame:
    """(_row, kind, start, end, role) of the weak parts that have a complementary part in
    their scope: a secret needs an identifier or an endpoint beside it, an identifier
    a secret, an endpoint both others. Strong parts complete weak ones. Parts that share
    a character do not complete each other: one piece of text is no two parts.

    An interval join on (document, strip of ``SCOPE`` code points): a strip holds, per role,
    the starts and the ends that lie in it, at most ``SCOPE`` of each. A weak part looks for
    starts from its own end on, in the strip of its end and the next one, and for ends up
    to its own start, in the strip of its start and the one before; rows grow with the
    number of parts and are never pairs."""
    flat = found.select("_row", F.explode(F.concat(*[_tagged(k) for k in ROLES])).alias("p")).select("_row", "p.*")
    strip = lambda c: F.floor(F.col(c) / SCOPE)
    edges = flat.select("_row", "role", F.explode(F.array(
        F.struct(strip("start").alias("strip"), F.col("start"), F.lit(None).cast("int").alias("end")),
        F.struct(strip("end").alias("strip"), F.lit(None).cast("int").alias("start"), F.col("end")))).alias("x")).select("_row", "role", "x.*")
    strips = edges.groupBy("_row", "strip").agg(*[
        F.collect_set(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ROLE_NAMES for c in ("start", "end")])
    weak = flat.filter(F.col("kind").isin([k for k, _, _ in WEAK])).withColumn(
        "strip", F.explode(F.array_distinct(F.array(strip("start") - 1, strip("start"), strip("end"), strip("end") + 1))))
    met = weak.join(strips, ["_row", "strip"]).groupBy("_row", "kind", "start", "end", "role").agg(*[
        F.max(F.exists(f"{r}_start", lambda x: x.between(F.col("end"), F.col("end") + SCOPE))
              | F.exists(f"{r}_end", lambda x: x.between(F.col("start") - SCOPE, F.col("start")))).alias(r) for r in ROLE_NAMES])
    has = {r: F.col(r) for r in ROLE_NAMES}
    complete = F.when(F.col("role") == "secret", has["id"] | has["endpoint"]).when(
        F.col("role") == "id", has["secret"]).otherwise(has["id"] & has["secret"])
    return met.filter(complete).select("_row", "kind", "start", "end", "role")


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ranked = F.sort_array(spans)
    names = F.array(*[F.lit(k) for k in ROLES])
    return F.concat_ws(",", F.transform(ranked, lambda x: F.concat_ws(
        ":", F.element_at(names, x["rank"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def _ranked(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(RANK[kind]).alias("rank"), x["e"].alias("e")))


def scan(found: DataFrame) -> DataFrame:
    """The rows of ``parts`` with base and weak: arrays of (s, rank, e) spans in code
    points, end exclusive; rank is the kind's place in ``ROLES``."""
    ranks = reduce(lambda a, k: F.when(F.col("kind") == k, RANK[k]).otherwise(a), RANK, F.lit(-1))
    weak = linked_weak(found).groupBy("_row").agg(F.collect_list(F.struct(
        F.col("start").alias("s"), ranks.alias("rank"), F.col("end").alias("e"))).alias("weak"))
    base = F.concat(*[_ranked(k) for k in BASE])
    return found.select("_row", "_doc", base.alias("base"), *[
        F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE]).join(weak, "_row", "left").withColumn(
            "weak", F.coalesce("weak", F.array().cast("array<struct<s:int,rank:int,e:int>>")))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, all spans.
    Null and empty texts have none; repeated rows are scanned one by one."""
    at = scan(parts(docs, ["doc_id"]))
    return at.select(
        "_doc.doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "weak")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark`` (overlapping
    spans by one) and ``n_chars`` renewed; rows without a finding stay as they are."""
    at = scan(parts(docs, docs.columns)).withColumn("_spans", F.sort_array(F.concat("base", "weak")))
    text = F.col("_doc.text")

    def step(a, x):
        kept = F.substring(text, a["at"] + 1, x["s"] - a["at"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(
            x["s"] >= a["at"], F.concat(a["out"], kept, F.lit(mark))).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    at = at.withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(text))
    renewed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.when(F.size("_spans") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("_doc.n_chars"))
    return at.select(*[renewed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
