"""Stable hashed keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from surveyloom.functions.text import blank_to_null


def hashed(prefix: str, length: int, *parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, length))


def dataset_id(project: Column, role: Column, subject: Column, semester: Column, form: Column,
               fallback: Column | None = None) -> Column:
    """Hash of the non-empty title parts, of the file stem when there are none."""
    base = F.concat_ws("|", *[blank_to_null(c) for c in (project, role, subject, semester, form)])
    stem = F.coalesce(blank_to_null(fallback) if fallback is not None else F.lit(None), F.lit("dataset"))
    return F.concat(F.lit("ds_"), F.substring(F.sha1(F.coalesce(blank_to_null(base), stem)), 1, 12))


def fact_id(*parts: Column) -> Column:
    return hashed("f_", 16, *parts)


def metric_id(*parts: Column) -> Column:
    return hashed("m_", 16, *parts)


def recon_id(*parts: Column) -> Column:
    return hashed("r_", 16, *parts)


def json_text(c: Column) -> Column:
    """A JSON string literal; quotes, backslashes and line ends escaped."""
    c = F.coalesce(c, F.lit(""))
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def scope_json(field: str, c: Column) -> Column:
    """``{"school": "x"}`` with the spacing that hashed ids are built on."""
    return F.concat(F.lit('{"%s": ' % field), json_text(c), F.lit("}"))


def json_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ", "), F.lit("]"))


def component_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[blank_to_null(p) for p in parts])
