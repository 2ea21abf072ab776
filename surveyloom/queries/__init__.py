"""Registered queries: a Spark callable and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated callable under ``name``."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return keep


def load_all() -> None:
    from surveyloom.queries import (  # noqa: F401
        answer_ingest, charts, crosstabs, matching, metrics, question_forms, recoding, resolution, scoring, statistics,
    )
