"""Plans of epochs: repeats by weight, shuffled pools of like length, micro-batches, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import sequence
from gleaner.session import materialise

LANE = 64  # steps that one task groups


def _hash(tag: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(tag), *(F.col(p).cast("string") for p in parts)), 256)


def repeats(weight: Column, record: Column, tag: str) -> Column:
    """``floor(weight)`` copies, and one more with the probability of the rest, from a hash of the record."""
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit(tag), record), 256), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return (F.floor(weight) + F.when(uniform < weight - F.floor(weight), 1).otherwise(0)).cast("bigint")


def pools(df: DataFrame, order: list[str], size: str, room: int) -> DataFrame:
    """Adds ``pool``: rows in a global order, cut where the running total before them passes a multiple of ``room``."""
    upto = sequence.running_total(df, order, size, "_upto")
    return upto.withColumn("pool", F.expr(f"(_upto - {size}) div {room}").cast("bigint")).drop("_upto")


def epoch_plan(rows: DataFrame, epoch: int, micro: int, step: int, micro_tokens: int, pool_micro: int = 20) -> DataFrame:
    """``place, pool, batch, id, copy, size, tokens``: the micro-batches of each step of an epoch.

    ``rows`` has ``id, size, tokens, weight``; sizes are whole numbers. Rows are repeated by weight,
    shuffled by hash and cut into pools of ``pool_micro`` micro-batches; a pool is packed longest first
    under the padded size ``micro`` and the padded tokens ``micro_tokens``. Micro-batches are shuffled
    again and grouped into steps of about ``step``, by lanes of ``LANE`` steps so that no task walks
    all of them, and ``place`` numbers the steps in a last shuffle. Depends on ids and epoch alone.
    """
    tag = f"{epoch}"
    n = repeats(F.col("weight"), F.col("id"), f"rep{tag}")
    drawn = rows.filter("weight > 0 and size >= 0").withColumn("_n", n).filter("_n > 0")
    drawn = drawn.select("id", "size", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("copy")).withColumn("h", _hash(f"order{tag}", "id", "copy"))
    pooled = pools(drawn, ["h"], "size", micro * pool_micro).withColumn("longest_first", -F.col("size"))
    packed = materialise(sequence.packed_batches(pooled, ["pool"], ["longest_first", "h"], {"size": micro, "tokens": micro_tokens}), "packed")
    each = packed.groupBy("pool", "batch").agg(F.sum("size").alias("total")).withColumn("h", _hash(f"micro{tag}", "pool", "batch"))
    lanes = pools(each.withColumnRenamed("pool", "of"), ["h"], "total", step * LANE).withColumnRenamed("pool", "lane")
    steps = materialise(sequence.grouped_steps(lanes, ["lane"], ["h"], "total", step).withColumn("h", _hash(f"step{tag}", "lane", "step")), "steps")
    placed = sequence.running_total(steps.select("h", F.lit(1).cast("bigint").alias("one")).distinct(), ["h"], "one", "place")
    steps = steps.join(placed.select("h", "place"), "h").select("place", F.col("of").alias("pool"), "batch")
    return packed.join(steps, ["pool", "batch"]).select("place", "pool", "batch", "id", "copy", "size", "tokens")


def micro_batches(plan: DataFrame) -> DataFrame:
    """``place, pool, batch, n, real, padded, tokens, padded_tokens, longest`` of each micro-batch of a plan."""
    each = plan.groupBy("place", "pool", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("real"), F.max("size").alias("longest"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most_tokens"))
    return each.select("place", "pool", "batch", "n", "real", (F.col("n") * F.col("longest")).alias("padded"), "tokens", (F.col("n") * F.col("most_tokens")).alias("padded_tokens"), "longest")


def plan_stats(plan: DataFrame) -> DataFrame:
    """One row: steps, micro-batches and rows, how much of the padded room is real, and the extremes."""
    micro = micro_batches(plan)
    by_step = micro.groupBy("place").agg(F.count("*").alias("n_micro"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("real", "padded", "tokens", "padded_tokens")), F.max("padded").alias("most_padded"), F.max("n").alias("most_rows"), F.max("tokens").alias("most_tokens"))
    share = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), 6)
    return by_step.agg(
        F.count("*").alias("n_steps"), F.sum("n_micro").alias("n_micro"), F.sum("n").alias("n_rows"), F.sum("real").alias("real"), share("real", "padded").alias("real_share"), share("tokens", "padded_tokens").alias("token_share"),
        F.min("real").alias("least_step"), F.max("real").alias("most_step"), F.max("most_padded").alias("most_padded"), F.max("most_rows").alias("most_rows"), F.max("most_tokens").alias("most_tokens"),
    )


def extremes(plan: DataFrame) -> DataFrame:
    """The micro-batch that is worst by each criterion: ``criterion, pool, batch, value``; the first one of equals."""
    picks = {"longest": "longest", "padded": "padded", "padded_tokens": "padded_tokens", "tokens": "tokens", "rows": "n"}
    micro = micro_batches(plan)
    first = micro.agg(*(F.max_by(F.struct("pool", "batch", F.col(c).alias("value")), F.struct(F.col(c), -F.col("pool"), -F.col("batch"))).alias(k) for k, c in picks.items()))
    return first.select(F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(k).alias("r")) for k in picks))).alias("e")).select("e.criterion", "e.r.*")
