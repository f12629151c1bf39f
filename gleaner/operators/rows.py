"""Choosing rows: first or last of a key, rule cascades, membership, problem lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which should be total.

    An aggregate rather than a window, so that copies are dropped before the shuffle.
    """
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns if c not in keys)), rank).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def last_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in df.columns if c not in keys)), rank).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def cascade(rules: list[tuple[Column | str, Column]], otherwise: str = "kept") -> Column:
    """The reason of the first rule that holds; a rule that is null doesn't hold."""
    reason: Column | None = None
    for name, holds in rules:
        label = name if isinstance(name, Column) else F.lit(name)
        reason = F.when(holds, label) if reason is None else reason.when(holds, label)
    return F.lit(otherwise) if reason is None else reason.otherwise(F.lit(otherwise))


def staged(df: DataFrame, rules: list[tuple[Column | str, Column]], column: str = "reason", live: str = "kept") -> DataFrame:
    """Further rules over rows whose reason is still ``live``; earlier reasons stay."""
    for name, holds in rules:
        label = name if isinstance(name, Column) else F.lit(name)
        df = df.withColumn(column, F.when((F.col(column) == live) & holds, label).otherwise(F.col(column)))
    return df


def threshold(source: Column, by_source: dict[str, float], default: float) -> Column:
    """The float threshold of a source, as stored values are floats and must be compared as such."""
    out = F.lit(default).cast("float")
    for name, value in sorted(by_source.items()):
        out = F.when(source == name, F.lit(value).cast("float")).otherwise(out)
    return out


def problems(checks: list[tuple[str, Column]]) -> Column:
    """Every check that fails, in order, as an array; an unknown check counts as failed."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))


def present(df: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``df`` with a flag whether its key stands in ``other``; null keys never do."""
    seen = other.select(*keys).na.drop().distinct().withColumn(flag, F.lit(True))
    return df.join(seen, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def numbered(df: DataFrame, keys: list[str], order: list[Column], output: str = "rn") -> DataFrame:
    return df.withColumn(output, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
