import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import packing as p


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=6), st.integers(40, 60))
def test_pattern_is_as_full_as_can_be(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    pattern = p.best_pattern(counts, capacity)
    assert sum(k * v for k, v in pattern.items()) == max(sums)
    assert all(0 < v <= counts[k] for k, v in pattern.items())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_fill_uses_each_once(lengths):
    lengths = np.array(lengths, np.int64)
    container, place = p.fill(lengths, 30)
    used = Counter()
    for c, n in zip(container, lengths):
        used[c] += n
    assert all(v <= 30 for v in used.values())
    assert len(set(zip(container, place))) == len(lengths)


def pack(spark, rows, capacity, **more):
    df = spark.createDataFrame(rows, "doc string, n int, item int, size string, shard int")
    return p.pack(df, "doc", "n", capacity, **more)


def test_whole_table(spark):
    rng = random.Random(1)
    sizes = [rng.choice([1, 5, 30, 60, 99, 100, 101, 250, 300]) for _ in range(600)]
    rows = [(f"d{i}", n, 0, "", 1) for i, n in enumerate(sizes)]
    places = pack(spark, rows, 100, shard_items=200)
    got = places.collect()
    used, parts = Counter(), defaultdict(list)
    for r in got:
        used[r.container] += r["size"]
        parts[r["item"]].append((r.part, r["size"]))
    assert max(used.values()) <= 100
    for i, n in enumerate(sizes):
        mine = sorted(parts[f"d{i}"])
        assert sum(s for _, s in mine) == n and [k for k, _ in mine] == list(range(len(mine)))
        assert len(mine) == max(1, -(-n // 100)) and all(s == 100 for _, s in mine[:-1])
    report = p.fill_report(places, 100).first()
    assert report.n_tokens == sum(sizes) and report.unused_share < 0.02
    assert sorted(map(tuple, got)) == sorted(map(tuple, pack(spark, rows[::-1], 100, shard_items=200).collect()))


def test_odd_rows(spark):
    rows = [("a", None, 0, "", 0), ("b", 0, 0, "", 0), (None, 7, 0, "", 0), ("c", -3, 0, "", 0)] + [("hot", 10, 0, "", 0)] * 500
    got = pack(spark, rows, 20, shard_items=100).collect()
    assert Counter(r["item"] for r in got) == {"a": 1, "b": 1, None: 1, "c": 1, "hot": 500}
    used = Counter()
    for r in got:
        used[r.container] += r["size"]
    assert max(used.values()) <= 20 and len({(r.container, r.place) for r in got}) == len(got)
    assert pack(spark, [], 20).count() == 0
