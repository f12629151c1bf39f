"""Growing inputs as streams: tails, tables of changes, deduplication on resume, follow mode and patience."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators import sequence
from gleaner.session import ship
from gleaner.sources.files import exists, listed


def tail(spark: SparkSession, path: str, schema, kind: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as they come; the rate limit is the closest to holding back input."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there now into Parquet, once; a second call goes on from where this one ended."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(target)
    query.awaitTermination()


COMPACT = 20  # batches after which the changes so far become one


def keep_changes(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Everything there now into a table of changes: of each micro-batch only what ``partial`` makes of it is written.

    ``merge`` turns changes of several batches into one and is used by ``changes`` and every ``COMPACT``
    batches, when all changes so far become a base. A batch that is repeated after a crash writes its
    change again under its own number, so it counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{target}/change={number:010d}")
        if (number + 1) % COMPACT == 0:
            changes(batch.sparkSession, target, merge, number).write.mode("overwrite").parquet(f"{target}/base={number:010d}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changes(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame], upto: int | None = None) -> DataFrame:
    """The table that ``keep_changes`` holds: its last base and the changes since."""
    names = [n for n in listed(spark, target) if exists(spark, f"{target}/{n}/_SUCCESS") and (upto is None or int(n.partition("=")[2]) <= upto)]
    bases = [n for n in names if n.startswith("base=") and (upto is None or int(n.partition("=")[2]) < upto)]
    since = int(bases[-1].partition("=")[2]) if bases else -1
    parts = bases[-1:] + [n for n in names if n.startswith("change=") and int(n.partition("=")[2]) > since]
    if not parts:
        raise FileNotFoundError(f"{target} holds no change yet")
    return merge(spark.read.schema(spark.read.parquet(f"{target}/{parts[0]}").schema).parquet(*(f"{target}/{n}" for n in parts)))


def last_values(keys: list[str], order: str, values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """For ``keep_changes``: the last value of each key, of equally late ones the greatest."""

    def last(df: DataFrame) -> DataFrame:
        whole = F.struct(order, *values)
        return df.groupBy(*keys).agg(F.max_by(whole, whole).alias("_r")).select(*keys, "_r.*")

    return last


def window_sums(at: str, key: str, value: str, width: str = "1 hour") -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """For ``keep_changes``: counts and sums by event-time window and key. A row counts however late it comes."""

    def partial(df: DataFrame) -> DataFrame:
        out = df.groupBy(F.window(F.col(at).cast("timestamp"), width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        return out.select(F.col("w.start").alias("began"), key, "n", "total")

    return partial, lambda df: df.groupBy("began", key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def touch(spark: SparkSession, path: str) -> None:
    """An empty file as a marker."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True).close()


def remove(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def follow(spark: SparkSession, folder: str, take: Callable[[list[str], int], None], done: str, hold: str | None = None, pause: Callable[[], None] = lambda: time.sleep(10)) -> dict[str, int]:
    """Takes up the entries of a folder as they appear, until the file ``done`` stands and none is left.

    The folder is listed anew each time; ``take`` gets the names not taken yet and the number of the
    round. While the file ``hold`` stands nothing is taken. The marker is looked for before the listing,
    so that what was written before it is never missed. Gives the rounds, the pauses held and idle ones.
    """
    taken: set[str] = set()
    counts = {"rounds": 0, "held": 0, "idle": 0}
    while True:
        if hold and exists(spark, hold):
            counts["held"] += 1
            pause()
            continue
        over = exists(spark, done)
        fresh = [n for n in listed(spark, folder) if n not in taken and not n.startswith(("_", "."))]
        if fresh:
            take(fresh, counts["rounds"])
            taken.update(fresh)
            counts["rounds"] += 1
        elif over:
            return counts
        else:
            counts["idle"] += 1
            pause()


def distinct_stream(stream: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Each key once, however often a resumed writer sends it, with state bounded by the watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def patience_stream(stream: DataFrame, key: str, step: str, value: str, most: int, absolute: float = 0.0, relative: float = 0.0, floor: float | None = None, least: int = 0) -> DataFrame:
    """``best, since, evals, trigger`` of each run as in ``sequence.patience``, carried from batch to batch.

    A run's rows of one micro-batch are put in order in memory, so the rate of the input bounds them;
    batches must come in the order of steps.
    """
    ship(stream.sparkSession)
    follow_on = sequence.patience_step(most, absolute, relative, floor, least)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, 0, 0]
        if held[0] is not None and held[0] != held[0]:
            held[0] = None
        rows = pd.concat(list(batches)).sort_values(step)
        out = [(k[0], s, *follow_on(held, v)) for s, v in zip(rows[step], rows[value])]
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=[key, step, "best", "since", "evals", "trigger"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {step} bigint, best double, since int, evals int, trigger string", "best double, since int, evals int", "append", GroupStateTimeout.NoTimeout)
