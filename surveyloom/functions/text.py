"""Column functions on question text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from surveyloom import fixed_values as V

# Unicode white space as the cleaning rules mean it, ASCII separators included.
SPACE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; Spark has no built-in for it."""
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def strip(c: Column) -> Column:
    """Without white space, as ``SPACE`` knows it, at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def compact_text(c: Column) -> Column:
    plain = c.rlike(r"^[\x00-\x7f]*\z")  # composition leaves ASCII alone: such texts stay out of Python
    return squeeze_spaces(F.coalesce(F.when(plain, c), nfkc(F.when(~plain, c))))


def drop_question_tags(c: Column) -> Column:
    """Remove ``[…题]`` tags and a trailing colon from compacted text."""
    return F.regexp_replace(squeeze_spaces(F.regexp_replace(c, V.TYPE_TAG_PATTERN, "")), "[:：]+$", "")


def replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def drop_terms(c: Column, terms: Sequence[str]) -> Column:
    """Remove literal terms, longest first."""
    return replace_all(c, [(t, "") for t in sorted(terms, key=len, reverse=True)])


def text_key(compacted: Column) -> Column:
    """Key of an already compacted text: number, tags, wording variants, white
    space and punctuation removed."""
    c = F.regexp_replace(compacted, r"(?s)" + V.QUESTION_PATTERN, "$2")
    c = replace_all(drop_question_tags(c), V.TEXT_REPLACEMENTS)
    c = F.regexp_replace(c, SPACE, "")
    return F.regexp_replace(c, V.PUNCTUATION_CLASS, "")


def comparison_text(key: Column, terms: Sequence[str] = V.SUBJECT_TERMS) -> Column:
    return drop_terms(F.regexp_replace(key, r"第\d+题", "第N题"), terms)


def topic_text(key: Column, terms: Sequence[str] = V.SUBJECT_TERMS,
               stop_terms: Sequence[str] = V.TOPIC_STOP_TERMS) -> Column:
    return drop_terms(comparison_text(key, terms), stop_terms)


def component_key(compacted: Column) -> Column:
    """Key of an option or row label: blanks and stars at the end do not count."""
    c = F.replace(compacted, F.lit("其它"), F.lit("其他"))
    c = F.trim(F.regexp_replace(c, V.TRAILING_BLANK_PATTERN, ""))
    c = F.trim(F.regexp_replace(c, V.TRAILING_STAR_PATTERN, ""))
    return text_key(c)


def blank_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(V.BLANK_PATTERN))


def char_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the whole text, repeats kept. The text is cut into
    characters once; a substring per gram would walk the text from its start."""
    def grams(chars: Column, n: int) -> Column:
        last = F.size(chars) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    # wrapping the character list in an array binds it, so it is made once per text
    bound = F.array(F.filter(F.split(c, ""), lambda ch: ch != ""))
    return F.flatten(F.transform(bound, lambda chars: F.concat(*[grams(chars, n) for n in range(low, high + 1)])))


def gram_statistics(c: Column) -> Column:
    """(grams, total, most, norm2) of the character n-grams of one text: distinct ones, all,
    the highest count and the sum of squared counts. Equal grams stand together in the
    sorted list of the text; a gram's count is the distance between two ends of runs, so
    nothing of a text ever leaves its row."""
    bound = F.array(F.array_sort(char_grams(c)))
    ends = lambda grams: F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: ~F.get(grams, i).eqNullSafe(F.get(grams, i - 1)))
    counts = lambda last: F.transform(last, lambda e, k: (e - F.coalesce(F.get(last, k - 1), F.lit(0))).cast("bigint"))
    found = F.transform(F.filter(bound, lambda grams: F.size(grams) > 0), lambda grams: F.get(F.transform(F.array(ends(grams)), counts), F.lit(0)))
    return F.get(F.transform(found, lambda n: F.struct(
        F.size(n).cast("bigint").alias("grams"), F.aggregate(n, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"),
        F.array_max(n).alias("most"), F.aggregate(n, F.lit(0).cast("bigint"), lambda s, x: s + x * x).alias("norm2"))), F.lit(0))


def char_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda ch: ch != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(char_set(a), char_set(b))


def set_jaccard(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(both / either)


def length_ratio_ok(len_a: Column, len_b: Column, ratio: float = V.LENGTH_RATIO) -> Column:
    short, long = F.least(len_a, len_b), F.greatest(len_a, len_b)
    return (short > 0) & (short / F.nullif(long, F.lit(0)) >= ratio)


def contrast_tokens(c: Column, sets: Sequence[Sequence[str]] = V.CONTRAST_SETS) -> Column:
    """Per set of opposing words the longest one found in the text, else NULL."""
    found = []
    for words in sets:
        case = F.lit(None).cast("string")
        for word in reversed(sorted(words, key=len, reverse=True)):
            case = F.when(c.contains(word), F.lit(word)).otherwise(case)
        found.append(case)
    return F.array(*found)


def contrasts_conflict(a: Column, b: Column) -> Column:
    """Both texts name a word of the same set, and not the same one."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.exists(pairs, lambda p: F.coalesce(p["a"] != p["b"], F.lit(False)))


def question_type(c: Column) -> Column:
    """The known type named by the last ``[…题]`` tag, else that tag's text."""
    tags = F.regexp_extract_all(c, F.lit(V.TYPE_TAG_PATTERN), 1)
    last = squeeze_spaces(F.try_element_at(tags, F.lit(-1)))
    case = F.when(F.size(tags) == 0, F.lit(""))
    for known in V.QUESTION_TYPES:
        case = case.when(last.contains(known), F.lit(known))
    return case.otherwise(last)


def option_code(c: Column) -> tuple[Column, Column]:
    """``[3] label`` → (``3``, ``label``); a label without code is its own value."""
    code = F.regexp_extract(c, V.OPTION_CODE_PATTERN, 1)
    label = F.regexp_extract(c, V.OPTION_CODE_PATTERN, 2)
    plain = code == ""
    return F.when(plain, c).otherwise(code), F.when(plain, c).otherwise(label)


def needs_text_entry(label: Column) -> tuple[Column, Column]:
    """(is a text-entry option, entry is required)."""
    required = label.rlike(V.REQUIRED_ENTRY_PATTERN)
    base = F.trim(F.regexp_replace(label, V.TRAILING_BLANK_PATTERN, ""))
    base = F.trim(F.regexp_replace(base, V.TRAILING_STAR_PATTERN, ""))
    hinted = F.lit(False)
    for hint in V.TEXT_ENTRY_HINTS:
        hinted = hinted | base.contains(hint)
    return required | hinted, required


def is_instruction(c: Column) -> Column:
    hit = F.lit(False)
    for prefix in V.INSTRUCTION_PREFIXES:
        hit = hit | c.startswith(prefix)
    return hit


def dependency(c: Column) -> Column:
    """Struct for a skip-logic line, NULL for any other line."""
    body = F.regexp_extract(c, V.DEPENDENCY_PATTERN, 1)
    orders = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(body, F.lit(V.DEPENDENCY_OPTION_PATTERN), 1), lambda s: s.cast("int"))))
    return F.when(
        body != "",
        F.struct(
            c.alias("dependency_text"),
            F.when(body.contains("当且仅当"), F.lit("当且仅当")).alias("dependency_logic"),
            blank_to_null(F.regexp_extract(body, V.DEPENDENCY_QUESTION_PATTERN, 1)).cast("int").alias("depends_on_q_no"),
            orders.alias("depends_on_option_orders"),
            body.contains("需要作答").alias("dependency_required"),
        ),
    )


def role_from_title(title: Column, roles: Sequence[str] = V.TITLE_ROLES) -> Column:
    case = F.lit("")
    for role in reversed(roles):
        case = F.when(title.contains(role), F.lit(role)).otherwise(case)
    return case


def subject_from_title(title: Column, noise: Sequence[str] = V.TITLE_NOISE) -> Column:
    subject = squeeze_spaces(replace_all(title, [(t, "") for t in noise]))
    subject = F.trim(F.regexp_replace(subject, "学科$", ""))
    school_only = role_from_title(title) == "学校"
    return F.when(subject != "", subject).when(school_only, F.lit("学校")).otherwise(title)


def heading_parts(heading: Column, name: Column) -> Column:
    """(subject, role) of a form's first line; a blank line is read as the form's ``name``,
    which also stands for a subject that nothing is left of. Phrases are taken out in
    their order, then role words and brackets, then a closing ``学科``."""
    own = compact_text(heading)
    shown = F.when(own != "", own).otherwise(name)
    role = role_from_title(shown, V.HEADING_ROLES)
    left = strip(replace_all(shown, [(p, "") for p in (*V.HEADING_PHRASES, *V.HEADING_TOKENS)]))
    left = strip(F.regexp_replace(left, "学科$", ""))
    subject = canonical_subject(compact_text(F.when(left != "", left).otherwise(name)))
    return F.struct(subject.alias("subject"), F.when((subject == "学校") & (role == ""), "学校").otherwise(role).alias("role"))


def canonical_subject(c: Column) -> Column:
    case = c
    for alias, subject in V.SUBJECT_ALIASES.items():
        case = F.when(c == alias, F.lit(subject)).otherwise(case)
    return case
