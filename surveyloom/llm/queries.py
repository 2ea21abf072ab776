"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from surveyloom.llm import (
    collocations, embeddings, fingerprints, html_text, language_model, minhash, packing, periodic, pieces, quality, secrets, toxicity, urls)
from surveyloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return keep


#: Place of the vocabulary on every executor.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


REACH_SQL = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(n, m) AS (SELECT a, b FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
parts AS (SELECT n, least(n, min(m)) AS component_id FROM reach GROUP BY n)"""


@query("op1_embedding_links", f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93), {REACH_SQL},
counts AS (SELECT a AS n, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN counts c ON c.n = vec_id LEFT JOIN parts p ON p.n = vec_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), VOCABULARY))


@query("op4_language_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates", f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))), {REACH_SQL}
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN parts ON n = doc_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op7_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


_STEPS = ", ".join(f"regexp_replace(t{i}, '{run.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i + 1}" for i, run in enumerate(quality.CLASS_RUNS))
_HALF = "((CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END) + (CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)) / 2"
#: For a language without a document that makes a reference, the operator uses that of all documents.
QUALITY_SQL = f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t0 FROM documents),
steps AS (SELECT *, list_filter(string_split_regex(t0, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, {_STEPS} FROM t),
counted AS (SELECT doc_id, lang, w, len(w) AS n_words, length(t0) - (length(t1) - length(t2)) AS word_chars, length(t5) - length(t6) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(t0) AS total,
  [length(t0) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5),
   length(t5) - length(t6), length(t6) - length(t7), length(t7)] AS chars FROM steps),
windows AS (SELECT doc_id, unnest(range(1, n_words - 3)) AS i, unnest(list_transform(range(1, n_words - 3),
  lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS x FROM counted WHERE n_words >= 5),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM often WHERE c > 1) GROUP BY doc_id),
base AS (SELECT c.*, coalesce(n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
  FROM counted c LEFT JOIN covered USING (doc_id)),
solid AS (SELECT * FROM base WHERE NOT base_failed AND n_words >= {quality.MIN_CHAR_WORDS}),
char_share AS (SELECT doc_id, lang, unnest(range(1, 9)) AS k, unnest(chars) / total AS p FROM base WHERE total > 0),
char_ref AS (SELECT lang, k, avg(p) AS q FROM char_share SEMI JOIN solid USING (doc_id) GROUP BY ALL),
char_jsd AS (SELECT doc_id, sum({_HALF.format(p='p', q='q')}) AS v FROM char_share JOIN char_ref USING (lang, k) GROUP BY doc_id),
common AS (SELECT doc_id, lang, word, count(*) / any_value(n_words) AS p FROM (
  SELECT doc_id, lang, n_words, lower(unnest(w)) AS word FROM base) WHERE word IN ({', '.join(f"'{w}'" for w in quality.COMMON_WORDS)}) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS n FROM solid GROUP BY lang),
common_ref AS (SELECT lang, word, sum(p) / any_value(n) AS q FROM common SEMI JOIN solid USING (doc_id) JOIN sizes USING (lang) GROUP BY lang, word),
whole AS (SELECT lang, coalesce(sum(q), 0) AS q_all FROM sizes LEFT JOIN common_ref USING (lang) GROUP BY lang),
seen AS (SELECT doc_id, sum({_HALF.format(p='p', q='coalesce(q, 0)')}) AS v, sum(p) AS p, sum(coalesce(q, 0)) AS q
  FROM common LEFT JOIN common_ref USING (lang, word) GROUP BY doc_id),
rest AS (SELECT b.doc_id, coalesce(v, 0) AS v, greatest(0, 1 - coalesce(p, 0)) AS pr, greatest(0, 1 - q_all) AS qr, greatest(0, q_all - coalesce(q, 0)) / 2 AS missed
  FROM base b JOIN whole USING (lang) LEFT JOIN seen USING (doc_id)),
judged AS (SELECT b.*, CASE WHEN n_words >= {quality.MIN_CHAR_WORDS} THEN round(c.v, 9) END AS char_divergence,
  CASE WHEN n_words >= {quality.MIN_COMMON_WORDS} THEN round(r.v + {_HALF.format(p='pr', q='qr')} + missed, 9) END AS word_divergence
  FROM base b LEFT JOIN char_jsd c USING (doc_id) LEFT JOIN rest r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_divergence, word_divergence,
  NOT base_failed AND NOT coalesce(char_divergence > {quality.MAX_CHAR_DIVERGENCE}, false)
    AND NOT coalesce(word_divergence > {quality.MAX_COMMON_DIVERGENCE}, false) AS kept FROM judged"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op11_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(table(spark, sf_dir, "documents"))


@query("op12_collocations", """WITH t AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM t),
flat AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k)),
grams AS (SELECT lang, k, phrase, count(*) AS a FROM flat GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE k >= 2 AND a >= 100),
own AS (SELECT * FROM often o WHERE NOT EXISTS (SELECT 1 FROM often p WHERE p.lang = o.lang AND p.k > o.k AND 100 * p.a >= 100 * o.a
  AND contains(' ' || p.phrase || ' ', ' ' || o.phrase || ' '))),
cuts AS (SELECT *, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS s FROM own),
scored AS (SELECT o.lang, o.phrase, o.a, c, f.a AS l, g.a AS r, n, (1000::HUGEINT * o.a * n) // (f.a::HUGEINT * g.a) AS score
  FROM cuts o JOIN totals t ON t.lang = o.lang JOIN grams f ON f.lang = o.lang AND f.phrase = array_to_string(s[:c], ' ')
  JOIN grams g ON g.lang = o.lang AND g.phrase = array_to_string(s[c + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score FROM weakest QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(periodic.repeat_tails(table(spark, sf_dir, "documents"))))
