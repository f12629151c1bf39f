"""All queries over the reference tables, by name, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import batches, control, ingest, more, relations, reports, runs, scores, selection, texts, values, verdicts

FLAGSHIP = "rule03_cascade"
MODULES = (selection, relations, runs, batches, ingest, control, scores, texts, values, reports, more, verdicts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
