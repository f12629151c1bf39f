"""Mixing sources to target weights (problem 6).

Method: Poisson replication. A source's target share of the total size, over its own size, is the mean
rate at which its documents are to be repeated. A hash of the document, seeded, gives a uniform
number; the inverse of the Poisson distribution with that mean turns it into the document's count.
Documents are exploded by their counts and shuffled globally by another hash.

A cap on repeats truncates the distribution: the mean before truncation is solved for so that the
truncated mean is the wanted rate. Where even the cap on every document falls short of the target,
every document gets the cap and the source is reported as short.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fold_name

TEMPORARY = ("_folded", "_named", "_base", "_steps", "_u", "_count", "_order")
PLAN = "source string, folded string, target_share double, max_repeats double, size bigint, rate double, mean double, short boolean, base int, steps array<double>"


def poisson_steps(mean: float) -> tuple[int, list[float]]:
    """The lowest count with weight and the distribution function from there, until it is 1 to 1e-15."""
    if mean <= 0:
        return 0, [2.0]
    wide = 12 * math.sqrt(mean) + 30
    low, high = max(0, math.floor(mean - wide)), math.ceil(mean + wide)
    steps, total = [], 0.0
    for k in range(low, high + 1):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        steps.append(min(total, 1.0))
        if total > 1 - 1e-15:
            break
    return low, steps


def truncated_mean(mean: float, cap: int) -> float:
    """The mean of min(X, cap) for a Poisson X."""
    low, steps = poisson_steps(mean)
    return low + sum(1 - s for k, s in enumerate(steps) if low + k < cap) if low < cap else float(cap)


def solve_mean(rate: float, cap: int | None) -> float:
    """The Poisson mean whose truncated mean is ``rate``; infinite where the cap can't give it."""
    if cap is None:
        return rate
    if rate >= cap:
        return math.inf
    low, high = 0.0, max(1.0, 2 * rate)
    while truncated_mean(high, cap) < rate:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if truncated_mean(mid, cap) < rate else (low, mid)
    return (low + high) / 2


def mixing_plan(documents: DataFrame, targets: DataFrame, size: str) -> DataFrame:
    """One row for each target: its size, wanted rate, Poisson mean and whether its cap falls short.

    Source names are compared without regard to case, width or outer blanks. A source without
    documents has size 0; null sizes count as 0; documents of other sources don't count at all. Only
    the sums of the sources named in ``targets`` reach the driver.
    """
    wanted = targets.filter("source is not null").select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("double"), fold_name(F.col("source")).alias("folded"))
    sums = documents.groupBy("source").agg(F.sum(F.coalesce(F.col(size), F.lit(0)).cast("bigint")).alias("size"))
    sums = sums.select(fold_name(F.col("source")).alias("folded"), "size").groupBy("folded").agg(F.sum("size").alias("size"))
    held = wanted.join(sums, "folded", "left").select("source", "folded", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).alias("size")).collect()
    total = sum(r["size"] for r in held)
    rows = []
    for r in sorted(held, key=lambda r: r.source):
        own, cap, share = r["size"], r.max_repeats, r.target_share or 0.0
        short = cap is not None and cap * own < share * total
        rate = share * total / own if own else 0.0
        mean = solve_mean(rate, None if cap is None else int(cap))
        base, steps = (int(cap), [2.0]) if math.isinf(mean) else poisson_steps(mean)
        if cap is not None and not math.isinf(mean):
            steps = steps[: max(0, int(cap) - base)] or [2.0]
        rows.append((r.source, r.folded, share, cap, own, rate, None if math.isinf(mean) else mean, short, base, steps))
    return documents.sparkSession.createDataFrame(rows, PLAN)


def replicate(documents: DataFrame, plan: DataFrame, key: str, seed: str = "mix") -> DataFrame:
    """Each document of a planned source by its count, in global hash order.

    All columns pass; ``source`` is written as in the plan, and ``copy``, which replaces a column of
    that name, numbers the copies from 1. The count depends on the seed and the key only, so rows that
    share a key share their count. Rows with a null or unplanned source give nothing.
    """
    documents = documents.drop("copy", *TEMPORARY)
    known = plan.select(F.col("source").alias("_named"), F.col("folded").alias("_folded"), F.col("base").alias("_base"), F.col("steps").alias("_steps"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / F.lit(float(1 << 53))
    count = F.col("_base") + F.size(F.filter("_steps", lambda s: s <= F.col("_u")))
    # One row for each named source; the documents stay where they are.
    rows = documents.withColumn("_folded", fold_name(F.col("source"))).join(F.broadcast(known), "_folded")
    rows = rows.withColumn("_u", uniform).withColumn("_count", count).filter("_count > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count")))).withColumn("source", F.col("_named"))
    return rows.withColumn("_order", F.xxhash64(F.lit(seed + " order"), key, "copy")).orderBy("_order", key, "copy").drop(*TEMPORARY)


def share_report(mixed: DataFrame, plan: DataFrame, size: str) -> DataFrame:
    """Target and actual share of each source, with its documents, copies and most repeats."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_copies"), F.max("copy").alias("most_copies"), F.sum(F.coalesce(F.col(size), F.lit(0)).cast("bigint")).alias("n_out"))
    total = got.agg(F.sum("n_out").alias("n_all"))
    return (
        plan.select("source", "target_share", "max_repeats", "short", F.col("size").alias("n_in"))
        .join(got, "source", "left")
        .crossJoin(total)
        .select("source", "target_share", F.round(F.coalesce("n_out", F.lit(0)) / F.col("n_all"), 6).alias("actual_share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"), "short")
    )
