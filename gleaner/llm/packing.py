"""Filling containers of fixed capacity with items (problem 5).

Method: minimum bin slack. For the items still left, a bitset holds which sums some multiset of their
lengths reaches up to the capacity; the largest reachable sum gives the container, walking back gives
how many items of each length it takes, and that pattern is used as often as the counts allow.

An item is never cut unless it alone exceeds the capacity; such an item fills whole containers and
its remainder is packed as an item of its own. Items are spread over shards of bounded size by the
hash of their key, and each shard is packed by one task; a shard leaves at most about one container
partly empty, which is nothing beside the thousands it fills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialise, ship

SHARD = 5_000
PLACES = "container string, item {key}, part int, place int, size int"


def best_pattern(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many items of each length fill ``capacity`` best: a reachable sum closest to it.

    Lengths are taken in descending order, so that among equal sums the long ones, which are hard to
    place later, go first; binary groups of a count keep the number of bitsets low.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, group = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, group = left - take, group * 2
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    pattern: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not (before >> total) & 1:
            pattern[length] = pattern.get(length, 0) + take
            total -= length * take
    return pattern


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and place of each item; lengths are 0 to ``capacity``, zeros go into the first container."""
    order = np.argsort(lengths, kind="stable")
    values, start, number = np.unique(lengths[order], return_index=True, return_counts=True)
    at = {int(v): int(s) for v, s in zip(values, start)}
    counts = {int(v): int(n) for v, n in zip(values, number) if v > 0}
    container, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    k = 0
    while counts:
        pattern = best_pattern(counts, capacity)
        times = min(counts[v] // n for v, n in pattern.items())
        offset = 0
        for v in sorted(pattern, reverse=True):
            n = pattern[v]
            rows = order[at[v] : at[v] + n * times]
            container[rows] = k + np.arange(n * times) // n
            place[rows] = offset + np.arange(n * times) % n
            offset += n
            at[v] += n * times
            counts[v] -= n * times
            if not counts[v]:
                del counts[v]
        k += times
    if (zeros := int((lengths == 0).sum())) and k:
        taken = int((container[lengths > 0] == 0).sum())
        place[order[:zeros]] = taken + np.arange(zeros)
    elif zeros:
        place[order[:zeros]] = np.arange(zeros)
    return container, place


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "size", "copy"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(np.int64)
        whole = np.where(size > capacity, size // capacity, 0)
        rest = size - whole * capacity
        packed = np.flatnonzero((rest > 0) | (whole == 0))
        container, place = fill(rest[packed], capacity)
        row = np.repeat(np.arange(len(size)), whole)
        part = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        own = (container.max() + 1 if len(packed) else 0) + np.arange(len(row))
        shard = str(pdf["shard"].iloc[0])
        rows = np.concatenate([packed, row])
        return pd.DataFrame(
            {
                "container": [f"{shard}-{c}" for c in np.concatenate([container, own])],
                "item": pdf["item"].to_numpy()[rows],
                "part": np.concatenate([whole[packed], part]).astype(np.int32),
                "place": np.concatenate([place, np.zeros(len(row), np.int64)]).astype(np.int32),
                "size": np.concatenate([rest[packed], np.full(len(row), capacity)]).astype(np.int32),
            }
        )

    return run


def counted_items(items: DataFrame, key: str, size: str) -> DataFrame:
    """``item, size, n``: equal items with their number, written once for any number of capacities.

    A null or negative size counts as 0.
    """
    ship(items.sparkSession)
    rows = items.select(F.col(key).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("size"))
    return materialise(rows.groupBy("item", "size").agg(F.count("*").alias("n")), "sizes")


def pack(items: DataFrame, key: str, size: str, capacity: int, shard_items: int = SHARD) -> DataFrame:
    """The places of ``pack_counted`` for plain items, one row each."""
    return pack_counted(counted_items(items, key, size), capacity, shard_items)


def pack_counted(counted: DataFrame, capacity: int, shard_items: int = SHARD) -> DataFrame:
    """``container, item, part, place, size``: where each item, or part of an oversized one, lies.

    ``part`` numbers the pieces of an item from 0, each but the last as large as the capacity.
    ``counted`` is what ``counted_items`` gives. An item of size 0 takes a place but no room. Repeated keys
    are items of their own, told apart by a running copy number. Empty input gives an empty result.
    """
    if capacity < 1:
        raise ValueError("the capacity must be 1 or more")
    kind = dict(counted.dtypes)["item"]
    # Equal items are counted first and told apart by number, so a key with very many rows is spread over the shards.
    shards = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // shard_items))
    each = counted.select("item", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    sharded = each.withColumn("shard", F.pmod(F.xxhash64("item", "size", "copy"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandas(_pack_shard(capacity), PLACES.format(key=kind))


def fill_report(places: DataFrame, capacity: int) -> DataFrame:
    """Containers, items, tokens, unused room and its share."""
    each = places.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return each.agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_parts"),
        F.sum("used").alias("n_tokens"),
        F.sum(F.lit(capacity) - F.col("used")).alias("unused"),
        F.round(F.sum(F.lit(capacity) - F.col("used")) / (F.count("*") * capacity), 6).alias("unused_share"),
    )
