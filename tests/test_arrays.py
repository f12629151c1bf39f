import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import arrays as a
from gleaner.session import spread


def soft(xs):
    z = sum(map(math.exp, xs))
    return [math.exp(x) / z for x in xs]


def test_divergences(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(12)], [rng.uniform(-3, 3) for _ in range(12)]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, x array<double>, y array<double>")
    p, q = a.softmax(F.col("x")), a.softmax(F.col("y"))
    got = df.select("i", a.log_sum_exp(F.col("x")).alias("l"), a.divergence(p, q).alias("d"), a.top_with_rest(p, q, 4).alias("t"), a.top_with_rest(p, q, 12).alias("w")).collect()
    for r, (_, x, y) in zip(sorted(got), rows):
        ps, qs = soft(x), soft(y)
        top = sorted(range(12), key=lambda k: -ps[k])[:4]
        rp, rq = 1 - sum(ps[k] for k in top), 1 - sum(qs[k] for k in top)
        whole = sum(u * math.log(u / v) for u, v in zip(ps, qs))
        assert r.l == pytest.approx(math.log(sum(map(math.exp, x)))) and r.d == pytest.approx(whole) and r.w == pytest.approx(whole)
        assert r.t == pytest.approx(sum(ps[k] * math.log(ps[k] / qs[k]) for k in top) + rp * math.log(rp / rq))
        assert r.t <= r.d + 1e-12


def test_zero_probability(spark):
    df = spark.createDataFrame([([0.0, 1.0], [0.5, 0.5])], "p array<double>, q array<double>")
    assert df.select(a.divergence(F.col("p"), F.col("q")).alias("d")).first().d == pytest.approx(math.log(2))


def test_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(10)
    assert spread(wide) is wide
