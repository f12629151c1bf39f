"""Ratios of sums, stratified paired resampling and comparisons with intervals."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import sequence
from gleaner.session import materialise, ship

DRAWS = "stratum string, replicate int, system string, num double, den double"


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """A ratio, null where the denominator is 0."""
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), digits)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """``keys`` and a column for each of ``shares``: exact quantiles with linear interpolation, null values apart.

    Equal values are counted first, and ranks are running totals over range partitions, so a group with
    most of the rows, or with values all different, is held by no task. A key without values has no row.
    """
    counted = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    ranked = materialise(sequence.running_total(counted, ["_x"], "_n", "_upto", keys), "ranked")
    sizes = ranked.groupBy(*keys).agg(F.max("_upto").alias("_size")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_size")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    at = {name: F.lit(share) * (F.col("_size") - 1) for name, share in shares.items()}
    holds = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    near = reduce(lambda a, b: a | b, [holds(f(h)) for h in at.values() for f in (F.floor, F.ceil)])
    kept = ranked.join(sizes, same).filter(near)
    pick = lambda place: F.max(F.when(holds(place), F.col("_x")))
    out = kept.groupBy(*keys).agg(*(x.alias(f"_{name}{i}") for name, h in at.items() for i, x in enumerate((pick(F.floor(h)), pick(F.ceil(h)), F.max(h - F.floor(h))))))
    return out.select(*keys, *(F.round(F.col(f"_{n}0") + (F.col(f"_{n}1") - F.col(f"_{n}0")) * F.col(f"_{n}2"), digits).alias(n) for n in shares))


def point_sums(scores: DataFrame) -> DataFrame:
    """``stratum, system, num, den`` over all rows."""
    return scores.groupBy("stratum", "system").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def resampled_sums(scores: DataFrame, replicates: int, seed: str = "boot", block_rows: int = 50_000) -> DataFrame:
    """``stratum, replicate, system, num, den``: rows drawn with replacement within each stratum.

    ``scores`` has ``stratum, id, system, num, den``. A stratum is cut by hash into blocks of bounded
    size. For each replicate the blocks' shares of the draws come from one multinomial, which every
    task works out from the block sizes and a seed, and a block spreads its share over its own rows by
    another; together they are one multinomial over all rows, so multiplicities total the stratum's
    size. A row has one multiplicity for all systems, so comparisons are paired. Blocks, not strata,
    are what a task holds.
    """
    ship(scores.sparkSession)
    held = scores.groupBy("stratum").agg(F.ceil(F.countDistinct("id") / block_rows).cast("int").alias("blocks"))
    rows = scores.join(held, "stratum").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    sizes = rows.groupBy("stratum", "block").agg(F.countDistinct("id").alias("n"))
    # The sizes of a stratum go to each of its blocks once, not to every row.
    shape = sizes.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("sizes"))
    shape = shape.select(F.col("stratum").alias("of"), "sizes", F.explode("sizes.block").alias("part"))

    def draw(pdf: pd.DataFrame, shape: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["stratum", "replicate", "system", "num", "den"])
        stratum, block = str(pdf["stratum"].iloc[0]), int(pdf["block"].iloc[0])
        by = {x["block"]: x["n"] for x in shape["sizes"].iloc[0]}
        key = zlib.crc32((seed + stratum).encode())
        n = np.array(list(by.values()))
        shares = np.random.default_rng(key).multinomial(n.sum(), n / n.sum(), size=replicates)[:, list(by).index(block)]
        ids, at = np.unique(pdf["id"].to_numpy(str), return_inverse=True)
        systems, of = np.unique(pdf["system"].to_numpy(str), return_inverse=True)
        value = np.zeros((len(ids), 2 * len(systems)))
        np.add.at(value, (at, of), pdf["num"].to_numpy(float))
        np.add.at(value, (at, of + len(systems)), pdf["den"].to_numpy(float))
        rng = np.random.default_rng([key, block + 1])
        sums = np.vstack([rng.multinomial(s, np.full(len(ids), 1 / len(ids))) @ value for s in shares])
        return pd.DataFrame(
            {
                "stratum": stratum,
                "replicate": np.repeat(np.arange(replicates), len(systems)),
                "system": np.tile(systems, replicates),
                "num": sums[:, : len(systems)].ravel(),
                "den": sums[:, len(systems) :].ravel(),
            }
        )

    parts = rows.groupBy("stratum", "block").cogroup(shape.groupBy("of", "part")).applyInPandas(draw, DRAWS)
    return parts.groupBy("stratum", "replicate", "system").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def hashed_draws(scores: DataFrame, replicates: int, seed: str = "draw", lot: int = 1_000) -> DataFrame:
    """``stratum, replicate, system, num, den`` as ``resampled_sums``, but by hashes alone, so that any engine draws the same.

    Draw ``i`` of a replicate takes the row whose number in the order of ids is a hash modulo the
    stratum's size. As many draws are made as there are rows, in lots spread over the tasks; they are
    counted by row before the rows are met. For few replicates: the draws are ``replicates`` times the rows.
    """
    ids = scores.select("stratum", "id").distinct().withColumn("one", F.lit(1).cast("bigint"))
    numbered = materialise(sequence.running_total(ids, ["id"], "one", "k", ["stratum"]).drop("one"), "numbered")
    sizes = numbered.groupBy("stratum").agg(F.max("k").alias("size")).filter("stratum is not null")
    lots = sizes.select("stratum", "size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("*", F.explode(F.expr(f"sequence(0L, (size - 1) div {lot})")).alias("lot"))
    each = lots.repartition("stratum", "replicate", "lot").select("stratum", "size", "replicate", F.explode(F.expr(f"sequence(lot * {lot}, least(size, lot * {lot} + {lot}) - 1)")).alias("i"))
    h = F.sha2(F.concat_ws("|", F.lit(seed), "stratum", F.col("replicate").cast("string"), F.col("i").cast("string")), 256)
    k = (F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") % F.col("size") + 1).alias("k")
    times = each.select("stratum", "replicate", k).groupBy("stratum", "replicate", "k").agg(F.count("*").alias("times"))
    drawn = times.join(numbered, ["stratum", "k"]).join(scores.select("stratum", "id", "system", "num", "den"), ["stratum", "id"])
    return drawn.groupBy("stratum", "replicate", "system").agg(F.sum(F.col("num") * F.col("times")).alias("num"), F.sum(F.col("den") * F.col("times")).alias("den"))


def compared(point: DataFrame, draws: DataFrame, a: str, b: str, level: float = 0.95, noise: float = 0.0, n_noisy: int = 0, inflate: float = 1.0) -> DataFrame:
    """Per stratum the ratio of two systems' rates, its bootstrap interval and the verdict.

    The interval is that of the log ratio, from its variance over the replicates and, for each of
    ``n_noisy`` systems that would come out differently if trained again, the square of ``noise``; zero
    sums give null. ``inflate`` turns the variance of other replicates, as those that leave out a block
    each, into that of the ratio.
    """

    def log_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
        rate = lambda s: F.try_divide(F.sum(F.when(F.col("system") == s, F.col("num"))), F.sum(F.when(F.col("system") == s, F.col("den"))))
        return df.groupBy(*keys).agg(rate(a).alias("ra"), rate(b).alias("rb")).withColumn("d", F.when((F.col("ra") > 0) & (F.col("rb") > 0), F.log("ra") - F.log("rb")))

    z = {0.9: 1.6448536, 0.95: 1.9599640, 0.99: 2.5758293}[level]
    spread = log_ratio(draws, ["stratum", "replicate"]).groupBy("stratum").agg(F.sqrt(F.var_samp("d") * inflate + F.lit(n_noisy * noise**2)).alias("sd"))
    out = log_ratio(point, ["stratum"]).join(spread, "stratum", "left")
    low, high = F.exp(F.col("d") - z * F.col("sd")), F.exp(F.col("d") + z * F.col("sd"))
    verdict = F.when(high < 1, "better").when(low > 1, "worse").when(F.col("d").isNotNull(), "within")
    return out.select("stratum", F.round(F.exp("d"), 6).alias("ratio"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), verdict.alias("verdict"))
