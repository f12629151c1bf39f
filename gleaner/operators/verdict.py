"""A verdict for each run from its final rates and the trends of its evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import sequence


def _last(df: DataFrame, share: float, least: int, flag: str) -> DataFrame:
    """Marks the last ``max(least, ceil(share * n))`` rows of each run."""
    w = W.partitionBy("run")
    rank, n = F.row_number().over(w.orderBy(F.desc("step"))), F.count("*").over(w)
    return df.withColumn(flag, rank <= F.greatest(F.lit(least), F.ceil(n * share)))


def _change(y: Column, within: Column, scale: Column | None = None, least: int = 2) -> Column:
    """The least-squares change of ``y`` over the steps of a window, relative to its mean size."""
    y = F.when(within & y.isNotNull(), y)
    x = F.when(y.isNotNull(), F.col("step").cast("double"))
    size = F.avg(F.abs(y)) if scale is None else F.avg(F.abs(F.when(within, scale)))
    change = F.regr_slope(y, x) * (F.max(x) - F.min(x)) / F.nullif(size, F.lit(0.0))
    return F.when((F.count_distinct(x) >= 2) & (F.count(y) >= least), change)


def verdicts(
    history: DataFrame, final: DataFrame, version: int = 1, go: float = 1.2, promising: float = 1.5, most_truncated: float = 0.005, share: float = 0.2, least: int = 3,
    improving: float = 0.01, widening: float = 0.02, overfit: float = 0.01, gap: float = 0.25,
) -> DataFrame:
    """``run``, the counts and changes behind it, and ``verdict``: GO, PROMISING, NO-GO or INCONCLUSIVE.

    ``history`` has ``run, step, epoch, phase, rate, rate_full, held, probe``, ``final`` has ``run, set,
    student, teacher, n, n_truncated``. Trends read the last ``max(least, ceil(share * n))`` evaluations
    after step 0. In version 2 evaluations closer than ``gap`` epochs to the last one kept are left out
    first, and the rate's trend reads only those of the phase ``stable``, of which there must be
    ``least``; it is that of the complete sets where every one of them has it. A run without a history
    or without final rates has null trends or no sets within reach.
    """
    if version not in (1, 2):
        raise ValueError("the version must be 1 or 2")
    rows = history.filter("step > 0")
    if version == 2:
        rows = sequence.thinned(rows, ["run"], ["step"], "epoch", gap)
    rows = _last(rows, share, least, "in_window")
    if version == 2:
        stable = _last(rows.filter("phase = 'stable'"), share, least, "in_tail").select("run", "step", "in_tail")
        whole = W.partitionBy("run")
        rows = rows.join(stable, ["run", "step"], "left").withColumn("of_rate", F.coalesce("in_tail", F.lit(False)) & (F.count("in_tail").over(whole) >= least))
        complete = F.min(F.when(F.col("of_rate"), F.col("rate_full").isNotNull())).over(whole)
        rows = rows.withColumn("rate", F.when(F.coalesce(complete, F.lit(False)), F.col("rate_full")).otherwise(F.col("rate")))
    else:
        rows = rows.withColumn("of_rate", F.col("in_window"))
    window = F.col("in_window")
    trends = rows.groupBy("run").agg(
        _change(F.col("rate"), F.col("of_rate"), least=least if version == 2 else 2).alias("rate_change"),
        _change(F.col("held"), window).alias("held_change"),
        _change(F.col("probe"), window).alias("probe_change"),
        _change(F.col("held") - F.col("probe"), window, F.col("held")).alias("gap_change"),
    )
    ratio = F.when(F.col("teacher") > 0, F.col("student") / F.col("teacher")).when(F.col("student") == 0, 0.0).otherwise(float("inf"))
    sets = final.groupBy("run").agg(F.count_if(ratio <= go).alias("n_go"), F.count_if(ratio <= promising).alias("n_promising"), F.try_divide(F.sum("n_truncated").cast("double"), F.sum("n")).alias("truncated"))
    out = trends.join(sets, "run", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_go", "n_promising")})
    better = F.coalesce(F.col("rate_change") <= -improving, F.lit(False))
    over = F.coalesce((F.col("probe_change") < -overfit) & (F.col("held_change") > overfit), F.lit(False))
    passes = F.coalesce(F.col("truncated") <= most_truncated, F.lit(False)) & F.coalesce(F.col("gap_change") <= widening, F.lit(False))
    verdict = (
        F.when(over, "NO-GO")
        .when((F.col("n_go") >= 2) & passes, "GO")
        .when((F.col("n_promising") >= 2) & better, "PROMISING")
        .when((F.col("n_promising") < 2) & F.col("rate_change").isNotNull() & ~better, "NO-GO")
        .otherwise("INCONCLUSIVE")
    )
    why = (
        F.when(over, "over-fitting").when(verdict == "GO", "within reach").when(verdict == "PROMISING", "still improving").when(verdict == "NO-GO", "out of reach and flat")
        .when(F.col("rate_change").isNull(), "trend unknown").when(F.col("n_promising") >= 2, "within reach but flat").otherwise("out of reach but improving")
    )
    changes = ("rate_change", "held_change", "probe_change", "gap_change", "truncated")
    return out.select("run", "n_go", "n_promising", *(F.round(c, 6).alias(c) for c in changes), verdict.alias("verdict"), why.alias("reason"))
