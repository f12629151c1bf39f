import hashlib
import math
from fractions import Fraction

from gleaner.llm import stable_sample as s

RATES = {"probe": Fraction(1, 10), "greedy": Fraction(1, 3)}


def snapshots(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, snap int, marked boolean")


def expected(rows):
    first = {}
    for i, kind, snap, _ in rows:
        if None not in (i, kind, snap):
            first[i, kind] = min(snap, first.get((i, kind), snap))
    out = set()
    for kind, rate in RATES.items():
        for batch in set(first.values()):
            ids = [i for (i, k), b in first.items() if k == kind and b == batch]
            ids.sort(key=lambda i: (hashlib.sha256(("frozen" + i).encode()).hexdigest(), i))
            out |= {(i, kind, batch) for i in ids[: math.ceil(rate * len(ids))]}
    return out


def sampled(spark, rows):
    got = s.frozen_sample(s.arrivals(snapshots(spark, rows)), RATES).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_bottom_k_and_growth(spark):
    one = [(f"r{i}", k, 1, False) for i in range(500) for k in RATES]
    two = one + [(f"r{i}", k, 2, None) for i in range(300, 900) for k in RATES]
    three = two + [(f"r{i}", "probe", 3, True) for i in range(7000)]
    a, b, c = (sampled(spark, x) for x in (one, two, three))
    assert a == expected(one) and b == expected(two) and c == expected(three)
    assert a <= b <= c
    assert sampled(spark, three[::-1] + three[:50]) == c


def test_odd_rows(spark):
    rows = [(None, "probe", 1, True), ("a", None, 1, True), ("b", "probe", None, True), ("c", "other", 1, True), ("d", "probe", 1, True)]
    assert sampled(spark, rows) == {("d", "probe", 1)}
    assert sampled(spark, []) == set()


def test_lost_members(spark):
    rows = [
        ("a", "probe", 1, True), ("a", "probe", 2, None), ("a", "probe", 3, False), ("a", "greedy", 3, False),
        ("b", "probe", 1, False), ("b", "probe", 2, True), ("b", "probe", 3, True),
        ("c", "probe", 1, True), ("c", "probe", 1, None), ("c", "probe", 3, None), ("c", "probe", 3, True),
        ("d", "probe", 2, True), (None, "probe", 3, False), ("e", "probe", 3, None),
    ]
    df = snapshots(spark, rows).withColumnRenamed("marked", "marked")
    assert sorted(map(tuple, s.lost_members(df).collect())) == [("a", "probe", 2), ("a", "probe", 3)]
    assert s.lost_members(snapshots(spark, [])).count() == 0
    assert {r.kind: r.n_marked for r in s.sample_drift(df, RATES).groupBy("kind").sum("n_marked").withColumnRenamed("sum(n_marked)", "n_marked").collect()} == {"probe": 4, "greedy": 0}


def test_continued(spark):
    one = [(f"r{i:03}", "probe", 1, i % 10 == 0) for i in range(100)]
    two = one + [(f"r{i:03}", "probe", 2, None) for i in range(50, 250)]
    df = snapshots(spark, two + [(f"r{i:03}", "probe", 3, True) for i in range(400)])
    got = {(r.id, r.origin) for r in s.continued_sample(df, RATES, 2).collect()}
    assert got == {(f"r{i:03}", "frozen") for i in range(50, 100, 10)} | {(i, "new") for i, _, b in expected(two) if b == 2}
    assert s.continued_sample(df.limit(0), RATES, 2).count() == 0
