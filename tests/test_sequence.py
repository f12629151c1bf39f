import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import sequence as s


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [(f"k{i % 3}", i, round(rng.uniform(0.5, 9.5), 3)) for i in range(200)]
    return rows, spark.createDataFrame(rows, "k string, i int, x double").repartition(5)


def by_key(rows):
    out = {}
    for k, i, x in sorted(rows):
        out.setdefault(k, []).append((i, x))
    return out


def test_running_total(numbers):
    rows, df = numbers
    total, want = 0.0, {}
    for _, i, x in sorted(rows, key=lambda r: r[1]):
        total += x
        want[i] = pytest.approx(total)
    assert {r.i: r.upto for r in s.running_total(df, ["i"], "x").collect()} == want


def test_thinned(numbers):
    rows, df = numbers
    want = set()
    for k, own in by_key(rows).items():
        last = None
        for i, _ in own:
            if last is None or i - last >= 7:
                want.add((k, i))
                last = i
    assert {(r.k, r.i) for r in s.thinned(df, ["k"], ["i"], "i", 7).collect()} == want


def test_skip_fit(numbers):
    rows, df = numbers
    want = set()
    for k, own in by_key(rows).items():
        used = 0.0
        for i, x in own:
            if used + x <= 40:
                used += x
                want.add((k, i))
    assert {(r.k, r.i) for r in s.skip_fit(df, ["k"], ["i"], "x", 40).collect()} == want


def test_chunks_and_batches(numbers):
    rows, df = numbers
    chunks, batches = {}, {}
    for k, own in by_key(rows).items():
        chunk = total = 0
        batch, n, longest = 0, 0, 0.0
        for i, x in own:
            chunks[k, i] = chunk
            total += x
            if total >= 20:
                chunk, total = chunk + 1, 0
            if n and max(longest, x) * (n + 1) > 30:
                batch, n, longest = batch + 1, 0, 0.0
            n, longest = n + 1, max(longest, x)
            batches[k, i] = batch
    assert {(r.k, r.i): r.chunk for r in s.chunked(df, ["k"], ["i"], "x", 20).collect()} == chunks
    assert {(r.k, r.i): r.batch for r in s.packed_batches(df, ["k"], ["i"], {"x": 30}).collect()} == batches


def test_patience(numbers):
    rows, df = numbers
    want = {}
    for k, own in by_key(rows).items():
        best, since = None, 0
        for n, (i, x) in enumerate(own):
            best, since = (x, 0) if best is None or best - x > 0.1 else (best, since + 1)
            want[k, i] = (best, since, n + 1, "patience" if n >= 2 and since >= 5 else None)
    assert {(r.k, r.i): (r.best, r.since, r.evals, r.trigger) for r in s.patience(df, ["k"], ["i"], "x", 5, 0.1, least=3).collect()} == want


def test_patience_of_odd_values(spark):
    inf = float("inf")
    rows = [("a", i, x) for i, x in enumerate([None, 5.0, float("nan"), -inf, 4.99, 4.9, inf, None, 0.4])] + [(None, 0, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {(r.k, r.i): (r.best, r.since, r.trigger) for r in s.patience(df, ["k"], ["i"], "x", 3, 0.001, 0.01, 0.5, 2).collect()}
    assert got == {
        ("a", 0): (None, 1, None), ("a", 1): (5.0, 0, None), ("a", 2): (5.0, 1, None), ("a", 3): (5.0, 2, None), ("a", 4): (5.0, 3, "patience"), ("a", 5): (4.9, 0, None),
        ("a", 6): (4.9, 1, None), ("a", 7): (4.9, 2, None), ("a", 8): (0.4, 0, "floor"), (None, 0): (None, 1, None), (None, 1): (1.0, 0, None),
    }
    assert s.patience(df.limit(0), ["k"], ["i"], "x", 3).count() == 0
    assert "best" in s.patience(df.selectExpr("*", "'x' as best"), ["k"], ["i"], "x", 3).columns


def test_thinned_keeps_rows_without_a_place(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 2.5), ("a", 4, 3.0), ("a", 5, 9.0)], "k string, i int, x double")
    assert sorted(r.i for r in s.thinned(df, ["k"], ["i"], "x", 2).collect()) == [0, 2, 3, 5]


def test_batches_under_several_caps(spark):
    df = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate([(5, 1), (4, 9), (3, 1), (30, 1), (1, 1), (1, 1)])], "k string, i int, a int, b int")
    assert [r.batch for r in s.packed_batches(df, ["k"], ["i"], {"a": 12, "b": 15}).orderBy("i").collect()] == [0, 1, 2, 3, 4, 4]
    assert [r.batch for r in s.filled_batches(df, ["k"], ["i"], {"a": 9, "b": 10}).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    assert [r.step for r in s.grouped_steps(df, ["k"], ["i"], "a", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]


def test_collapse(spark):
    cases = {"": "", "aabb": "ab", "a-a": "aa", "--": "", "-ab-": "ab", "aa-aab": "aab"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("c", F.filter(F.split("t", ""), lambda c: c != ""))
    got = df.select("t", F.array_join(s.collapsed(F.col("c"), "-"), "").alias("o"), s.frames_needed(F.col("c")).alias("n")).collect()
    assert {r.t: r.o for r in got} == cases
    assert {r.t: r.n for r in got}["aabb"] == 6


def test_within(spark):
    rng = random.Random(2)
    spans = [(i, a := rng.randrange(1000), a + rng.randrange(0, 90)) for i in range(60)]
    points = [(i, rng.randrange(1100)) for i in range(200)]
    got = s.within(spark.createDataFrame(points, "p int, x int"), spark.createDataFrame(spans, "s int, low int, high int"), [], "x", "low", "high", 16).collect()
    assert sorted((r.p, r.s) for r in got) == sorted((p, i) for p, x in points for i, a, b in spans if a <= x < b)


def test_keyed_total_and_digest(spark, numbers):
    import hashlib

    rows, df = numbers
    hot = df.unionByName(spark.range(3000).selectExpr("'hot' k", "cast(id as int) i", "1.0D x")).unionByName(spark.createDataFrame([(None, 1, 2.0)], df.schema))
    got = {(r.k, r.i): r.upto for r in s.running_total(hot, ["i"], "x", keys=["k"]).collect()}
    assert got["hot", 2999] == 3000.0
    for k, own in by_key(rows).items():
        total = 0.0
        for i, x in own:
            total += x
            assert got[k, i] == pytest.approx(total)
    text = hot.withColumn("t", F.concat("k", F.col("i").cast("string")))
    digests = {r.k: (r.digest, r.n) for r in s.ordered_digest(text, ["k"], ["i"], "t").collect()}
    assert digests["hot"] == (hashlib.sha256("\n".join(f"hot{i}" for i in range(3000)).encode()).hexdigest(), 3000)
    assert digests[None][1] == 1 and len(digests) == 5


def test_periodic_tail_has_periods_up_to_twelve(spark, tmp_path):
    from gleaner.plans.runs import w27_periodic_tail

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"p{p}", "start" + letters[:p] * (24 // p) + letters[: 24 % p]) for p in range(1, 14)] + [("short", "ab" * 11 + "a"), ("null", None)]
    spark.createDataFrame(rows, "id string, hyp string").write.parquet(f"{tmp_path}/utt_index.parquet")
    assert {r.id for r in w27_periodic_tail(spark, str(tmp_path)).collect()} == {f"p{p}" for p in range(1, 13)}
