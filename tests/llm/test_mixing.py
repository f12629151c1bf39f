import math
from collections import Counter, defaultdict

import pytest

from gleaner.llm import mixing as m

TARGETS = [("aa", 0.5, None), ("bb", 0.3, 2.0), ("cc", 0.1, 3.0), ("none", 0.1, 4.0)]


def tables(spark, rows):
    documents = spark.createDataFrame(rows, "doc int, source string, n int, copy string, _u int")
    return documents, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats double")


def test_poisson():
    for mean in (0.0, 0.3, 1.0, 7.5, 400.0):
        low, steps = m.poisson_steps(mean)
        got = low + sum(1 - s for s in steps) if mean else 0.0
        assert got == pytest.approx(mean, rel=1e-9)
    for rate, cap in ((0.2, 1), (0.9, 1), (1.7, 2), (2.99, 3)):
        assert m.truncated_mean(m.solve_mean(rate, cap), cap) == pytest.approx(rate, rel=1e-6)
    assert math.isinf(m.solve_mean(2.0, 2)) and m.solve_mean(5.0, None) == 5.0


def test_shares_caps_and_order(spark):
    rows = [(i, ["aa", " ＡＡ", "Aa"][i % 3], 10, "x", 1) for i in range(300)] + [(1000 + i, "bb", 10, "x", 1) for i in range(2000)] + [(5000 + i, "ｃｃ", 10, "x", 1) for i in range(50)] + [(9000, "other", 99, "x", 1), (9001, None, 5, "x", 1), (None, "bb", None, "x", 1)]
    documents, targets = tables(spark, rows)
    plan = m.mixing_plan(documents, targets, "n")
    assert {r.source for r in plan.filter("short").collect()} == {"cc", "none"}
    mixed = m.replicate(documents, plan, "doc")
    assert sorted(mixed.columns) == ["copy", "doc", "n", "source"]
    got = mixed.collect()
    assert got == m.replicate(documents.repartition(5), plan, "doc").collect()
    size, most = defaultdict(int), defaultdict(Counter)
    for r in got:
        size[r.source] += r.n or 0
        most[r.source][r.doc] += 1
    total = 23500
    assert max(most["bb"].values()) <= 2 and set(most["cc"].values()) == {3}
    assert abs(size["aa"] / total - 0.5) < 0.03 and abs(size["bb"] / total - 0.3) < 0.02
    assert [r.source for r in got[:40]] != sorted(r.source for r in got[:40])
    report = {r.source: r for r in m.share_report(mixed, plan, "n").collect()}
    assert report["none"].actual_share == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-5)


def test_empty(spark):
    documents, targets = tables(spark, [])
    plan = m.mixing_plan(documents, targets, "n")
    assert plan.count() == 4 and plan.filter("short").count() == 0
    assert m.replicate(documents, plan, "doc").count() == 0
    assert m.mixing_plan(documents, targets.limit(0), "n").count() == 0


def test_documents_stay_where_they_are(spark):
    documents, targets = tables(spark, [(i, "aa", 10, "x", 1) for i in range(9)])
    mixed = m.replicate(documents, m.mixing_plan(documents, targets, "n"), "doc")
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint" not in plan
