"""Ordered operators: runs, islands, running totals, folds that carry state from row to row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import materialise, ship


def collapsed(symbols: Column, blank: str) -> Column:
    """Repeats of the symbol before are dropped, then blanks; an empty array stays empty."""
    kept = F.filter(symbols, lambda x, i: (i == 0) | (x != F.get(symbols, i - 1)))
    return F.filter(kept, lambda x: x != blank)


def frames_needed(tokens: Column) -> Column:
    """Length plus one for each pair of equal neighbours."""
    return F.size(tokens) + F.size(F.filter(tokens, lambda x, i: (i > 0) & (x == F.get(tokens, i - 1))))


def dense(size: Column, places: Column, values: Column, blank) -> Column:
    """``blank`` everywhere but at the listed places."""
    at = F.map_from_arrays(places, values)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda t: F.coalesce(F.try_element_at(at, t), F.lit(blank)))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, output: str = "island") -> DataFrame:
    """A running number for each run of equal values within a key; null counts as a value."""
    w = W.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn(output, F.sum("_fresh").over(w).cast("bigint")).drop("_fresh")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each run with its number, value, length and the first and last of the leading order column."""
    marked = islands(df, keys, order, value)
    return marked.groupBy(*keys, "island").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def running_total(df: DataFrame, order: list[str], value: str, output: str = "upto", keys: list[str] | None = None) -> DataFrame:
    """A running sum over a global order, or over the order within each key, without a window of one task.

    Rows are range-partitioned by key and order and written, each partition sums its own rows, and the
    totals of the partitions before are added: one number for each partition, or for each partition and
    key that meet, so a key with most of the rows is spread like any other.
    """
    keys = keys or []
    placed = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    totals = placed.groupBy("_part", *keys).agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum(value).over(W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    # Without keys there is one row for each partition.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    joined = placed.withColumn(output, own).join(before if keys else F.broadcast(before), same)
    return joined.withColumn(output, F.col(output) + F.col("_before")).drop("_part", "_p", "_before", *(f"_k{i}" for i in range(len(keys))))


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``keys, digest, n``: SHA-256 of each key's values in order, joined by line feeds.

    The digest is a chain by definition, so a key's rows pass one task; they stream through it sorted,
    and only the state of the digest is held.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    streamed = df.select(*keys, *order, F.coalesce(value, F.lit("")).alias("_value")).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, n = None, None, 0

        def made() -> list:
            return [] if state is None else [(*last, state.hexdigest(), n)]

        names = [*keys, "digest", "n"]
        for pdf in batches:
            out = []
            own = pdf[keys].astype(object).where(pdf[keys].notna(), None).apply(tuple, axis=1)
            for key, lot in pdf["_value"].groupby((own != own.shift()).cumsum(), sort=False):
                text = "\n".join(lot)
                at = own.loc[lot.index[0]]
                if state is not None and at == last:
                    state.update(("\n" + text).encode())
                else:
                    out += made()
                    last, state, n = at, hashlib.sha256(text.encode()), 0
                n += len(lot)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(made(), columns=names)

    return streamed.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "digest string", "n bigint"]))


def budget_prefix(df: DataFrame, order: list[str], value: str, budget: float) -> DataFrame:
    """The longest prefix of a global order whose running sum stays within the budget."""
    return running_total(df, order, value).filter(F.col("upto") <= budget)


def last_before(events: DataFrame, keys: list[str], order: list[str], holds: Column, value: Column, output: str) -> DataFrame:
    """As-of backward: for each row the value of the nearest earlier row where ``holds``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn(output, F.last(F.when(holds, value), ignorenulls=True).over(w))


def first_from(events: DataFrame, keys: list[str], order: list[str], holds: Column, value: Column, output: str) -> DataFrame:
    """As-of forward: for each row the value of the first row from here on where ``holds``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return events.withColumn(output, F.first(F.when(holds, value), ignorenulls=True).over(w))


def within(points: DataFrame, spans: DataFrame, keys: list[str], x: str, low: str, high: str, width: int) -> DataFrame:
    """Points joined to the half-open spans that hold them, by equal buckets of ``width``.

    A span stands in every bucket it touches, so the join is an equi-join with a residual check.
    """
    p = points.withColumn("_b", F.floor(F.col(x) / width))
    last = F.floor((F.col(high) - 1) / width)
    s = spans.filter(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), last)))
    return p.join(s, [*keys, "_b"]).filter((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("_b")


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: str, start: Callable[[], list], step: Callable[..., tuple | None]) -> DataFrame:
    """A sequential fold within each key: ``step(state, *inputs)`` changes the state and gives the row's outputs, or None to drop it.

    ``outputs`` names and types the columns it adds. Rows of a key arrive sorted and stream through the
    task; only the state is held. Keys must be of bounded size (a run, a pool), as a fold can't be
    spread over tasks.
    """
    ship(df.sparkSession)
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [f.split()[0] for f in outputs.split(",") if f.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, start()
        for pdf in batches:
            if pdf.empty:
                continue
            fresh = pd.concat([pdf[k].ne(pdf[k].shift()) & ~(pdf[k].isna() & pdf[k].shift().isna()) for k in keys], axis=1).any(axis=1).tolist()
            first = tuple(None if pd.isna(x) else x for x in pdf[keys].iloc[0])
            fresh[0] = first != last
            kept, made = [], []
            for i, (new, *values) in enumerate(zip(fresh, *(pdf[c].tolist() for c in inputs))):
                if new:
                    state = start()
                out = step(state, *values)
                if out is not None:
                    kept.append(i), made.append(out)
            last = tuple(None if pd.isna(x) else x for x in pdf[keys].iloc[-1])
            if kept:
                out = pdf.iloc[kept].reset_index(drop=True)
                for j, name in enumerate(names):
                    out[name] = pd.Series([m[j] for m in made], dtype=object)
                yield out

    fields = [f for f in df.schema.fields if f.name not in names] + T._parse_datatype_string(outputs).fields if names else df.schema.fields
    return sorted_rows.drop(*names).mapInPandas(run, T.StructType(fields))


def thinned(df: DataFrame, keys: list[str], order: list[str], x: str, gap: float) -> DataFrame:
    """Rows at least ``gap`` after the last row that was kept; a row without ``x``, or after one kept without it, is kept."""

    def step(state: list, value) -> tuple | None:
        known = value is not None and value == value
        if known and state[0] is not None and value - state[0] < gap:
            return None
        state[0] = value if known else None
        return ()

    return fold(df, keys, order, [x], "", lambda: [None], step)


def patience(df: DataFrame, keys: list[str], order: list[str], x: str, most: int, absolute: float = 0.0, relative: float = 0.0, floor: float | None = None, least: int = 0) -> DataFrame:
    """``best, since, evals, trigger`` of a series that should fall.

    A value improves on the best so far if it is below it by more than the greater of ``absolute`` and
    ``relative`` times the best's magnitude; the first finite one always does. A missing value or one
    that isn't finite never does, and counts in ``since`` like any other. From ``least`` values on,
    ``trigger`` is ``floor`` where the value is at ``floor`` or below, else ``patience`` where ``most``
    values in a row brought no improvement.
    """
    return fold(df, keys, order, [x], "best double, since int, evals int, trigger string", lambda: [None, 0, 0], patience_step(most, absolute, relative, floor, least))


def patience_step(most: int, absolute: float, relative: float, floor: float | None, least: int) -> Callable[..., tuple]:
    def step(state: list, value: float | None) -> tuple:
        best, since, evals = state
        finite = value is not None and math.isfinite(value)
        since, evals = since + 1, evals + 1
        if finite and (best is None or best - value > max(absolute, relative * abs(best))):
            best, since = value, 0
        state[:] = best, since, evals
        trigger = None
        if evals >= least:
            trigger = "floor" if floor is not None and finite and value <= floor else "patience" if since >= most else None
        return best, since, evals, trigger

    return step


def chunked(df: DataFrame, keys: list[str], order: list[str], size: str, limit: float) -> DataFrame:
    """A chunk closes when its total reaches the limit; adds ``chunk``."""

    def step(state: list, value: float) -> tuple:
        chunk, total = state[0], state[1] + value
        state[:] = (chunk + 1, 0) if total >= limit else (chunk, total)
        return (chunk,)

    return fold(df, keys, order, [size], "chunk int", lambda: [0, 0], step)


def packed_batches(df: DataFrame, keys: list[str], order: list[str], sizes: dict[str, float]) -> DataFrame:
    """Greedy batches: a new one begins where the largest of any size, times the rows, would exceed its cap; adds ``batch``.

    A row over a cap by itself has a batch of its own.
    """
    caps = list(sizes.values())

    def step(state: list, *values: float) -> tuple:
        batch, n, largest = state
        grown = [max(a, b) for a, b in zip(largest, values)] if n else list(values)
        if n and any(g * (n + 1) > cap for g, cap in zip(grown, caps)):
            batch, n, grown = batch + 1, 0, list(values)
        state[:] = batch, n + 1, grown
        return (batch,)

    return fold(df, keys, order, list(sizes), "batch int", lambda: [0, 0, []], step)


def filled_batches(df: DataFrame, keys: list[str], order: list[str], sizes: dict[str, float]) -> DataFrame:
    """Batches of rows in order: a new one begins where the total of any size would exceed its cap; adds ``batch``."""
    caps = list(sizes.values())

    def step(state: list, *values: float) -> tuple:
        batch, n, total = state
        grown = [a + b for a, b in zip(total, values)] if n else list(values)
        if n and any(g > cap for g, cap in zip(grown, caps)):
            batch, n, grown = batch + 1, 0, list(values)
        state[:] = batch, n + 1, grown
        return (batch,)

    return fold(df, keys, order, list(sizes), "batch int", lambda: [0, 0, []], step)


def grouped_steps(df: DataFrame, keys: list[str], order: list[str], size: str, target: float) -> DataFrame:
    """Rows in order grouped into steps of about ``target``: one ends where half of the next row would overshoot; adds ``step``."""

    def step(state: list, value: float) -> tuple:
        number, n, total = state
        if n and total + value / 2 > target:
            number, n, total = number + 1, 0, 0
        state[:] = number, n + 1, total + value
        return (number,)

    return fold(df, keys, order, [size], "step int", lambda: [0, 0, 0], step)


def skip_fit(df: DataFrame, keys: list[str], order: list[str], size: str, budget: float) -> DataFrame:
    """Rows in order, each taken if it still fits the budget of its key; sizes are whole numbers of 0 or more.

    In rounds: the prefix that fits is taken at once, by a running total over range partitions, then only
    rows that fit what is left can still be taken. What is left is less than the first row passed over,
    so few rounds are needed, and no key is walked by one task.
    """
    left, taken = df.withColumn("_left", F.lit(budget)), None
    while True:
        walked = materialise(running_total(left, order, size, "_upto", keys), "walked")
        fits = walked.filter("_upto <= _left")
        taken = fits if taken is None else taken.unionByName(fits)
        used = fits.groupBy(*keys).agg(F.max("_upto").alias("_used")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_used")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
        rest = walked.filter("_upto > _left").drop("_upto").join(used, same, "left").withColumn("_left", F.col("_left") - F.coalesce("_used", F.lit(0)))
        left = materialise(rest.filter(F.col(size) <= F.col("_left")).select(*df.columns, "_left"), "left")
        if left.isEmpty():
            return taken.select(*df.columns)
