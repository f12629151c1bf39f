import numpy as np
import pytest

from gleaner.operators import statistics as st


def scores(spark, factor=2.0, n=400):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 9, n)
    rows = [(f"s{i % 2}", f"i{i}", s, float(b * f), 10.0) for i, b in enumerate(base) for s, f in (("a", 1.0), ("b", factor))]
    return spark.createDataFrame(rows, "stratum string, id string, system string, num double, den double")


def test_multiplicities_total_the_stratum_and_are_paired(spark):
    df = scores(spark)
    draws = st.resampled_sums(df, 20, block_rows=60).collect()
    assert len(draws) == 2 * 20 * 2 and {r.den for r in draws} == {2000.0}
    by = {(r.stratum, r.replicate, r.system): r.num for r in draws}
    assert all(abs(by[s, r, "b"] - 2 * by[s, r, "a"]) < 1e-9 for s, r, x in by if x == "a")
    assert {tuple(r) for r in st.resampled_sums(df.repartition(7), 20, block_rows=60).collect()} == {tuple(r) for r in draws}
    assert len({by["s0", r, "a"] for r in range(20)}) > 10


def test_planted_ratio_has_no_spread(spark):
    df = scores(spark)
    got = st.compared(st.point_sums(df), st.resampled_sums(df, 30), "b", "a").collect()
    assert {(r.ratio, r.low, r.high, r.verdict) for r in got} == {(2.0, 2.0, 2.0, "worse")}


def test_interval_covers(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{t:02}", f"i{i}", s, float(x), 10.0) for t in range(40) for i in range(120) for s, x in (("a", rng.poisson(3)), ("b", rng.poisson(3)))]
    df = spark.createDataFrame(rows, "stratum string, id string, system string, num double, den double")
    got = st.compared(st.point_sums(df), st.resampled_sums(df, 120), "a", "b").collect()
    assert sum(r.low <= 1 <= r.high for r in got) >= 34


def test_zero_sums(spark):
    df = spark.createDataFrame([("s", "i", "a", 0.0, 0.0), ("s", "i", "b", 1.0, 1.0)], "stratum string, id string, system string, num double, den double")
    assert st.compared(st.point_sums(df), st.resampled_sums(df, 5), "a", "b").first().ratio is None


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=301).tolist(), "b": [2.0] * 50 + [3.0], "one": [7.0], None: [1.0, 2.0]}
    rows = [(k, x) for k, xs in values.items() for x in xs] + [("a", None), ("void", None)]
    got = {r.k: r for r in st.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"q1": 0.01, "q50": 0.5, "q97": 0.97}).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        assert [got[k].q1, got[k].q50, got[k].q97] == pytest.approx(np.quantile(xs, [0.01, 0.5, 0.97]).tolist(), abs=2e-6)


def test_hashed_draws_total_the_stratum(spark):
    rows = [(s, f"{s}{i}", system, float(i), 1.0) for s in "ab" for i in range(30) for system in ("x", "y")]
    got = st.hashed_draws(spark.createDataFrame(rows, "stratum string, id string, system string, num double, den double"), 5, lot=7).collect()
    assert len(got) == 20 and all(r.den == 30.0 for r in got)
    by = {(r.stratum, r.replicate, r.system): r.num for r in got}
    assert all(by[s, k, "x"] == by[s, k, "y"] for s in "ab" for k in range(5)) and len({by["a", k, "x"] for k in range(5)}) > 1
