from collections import Counter, defaultdict

from gleaner.operators import batches as b


def plan(spark, rows, **more):
    return b.epoch_plan(spark.createDataFrame(rows, "id string, size bigint, tokens bigint, weight double"), 3, 100, 300, 60, **more)


def test_plan_keeps_its_promises(spark):
    rows = [(f"u{i}", 5 + i * 7 % 40, 1 + i % 20, [0.0, 1.0, 2.5, 0.4][i % 4]) for i in range(400)] + [("long", 250, 3, 1.0), ("none", 0, 0, 1.0), (None, 10, 1, 1.0), ("void", None, 1, 1.0)]
    got = plan(spark, rows).collect()
    assert got and sorted(map(tuple, got), key=repr) == sorted(map(tuple, plan(spark, rows[::-1]).collect()), key=repr)
    weight = {r[0]: r[3] for r in rows}
    for id_, n in Counter(r.id for r in got).items():
        assert int(weight[id_]) <= n <= int(weight[id_]) + (weight[id_] % 1 > 0)
    assert {r.id for r in got} >= {r[0] for r in rows if r[3] >= 1 and r[0] not in (None, "void")} and "void" not in {r.id for r in got}
    micro = defaultdict(list)
    for r in got:
        micro[r.place, r.pool, r.batch].append(r)
    for own in micro.values():
        assert len(own) == 1 or (max(r.size for r in own) * len(own) <= 100 and max(r.tokens for r in own) * len(own) <= 60)
    steps = Counter()
    for r in got:
        steps[r.place] += r.size
    assert sorted(steps) == list(range(1, len(steps) + 1)) and all(s <= 300 + 125 for s in steps.values())


def test_readouts(spark):
    df = plan(spark, [(f"u{i}", 10 + i % 5, 2, 1.0) for i in range(60)])
    stats, micro = b.plan_stats(df).first(), b.micro_batches(df).collect()
    assert stats.n_rows == 60 and stats.n_micro == len(micro) and stats.real == sum(m.real for m in micro)
    worst = {r.criterion: r.value for r in b.extremes(df).collect()}
    assert worst == {"longest": max(m.longest for m in micro), "padded": max(m.padded for m in micro), "padded_tokens": max(m.padded_tokens for m in micro), "tokens": max(m.tokens for m in micro), "rows": max(m.n for m in micro)}


def test_empty_plan(spark):
    empty = plan(spark, [])
    assert empty.count() == 0 and b.plan_stats(empty).first().n_steps == 0


def test_skip_fit_equals_a_walk(spark):
    import random

    from gleaner.operators import sequence as s

    rng = random.Random(4)
    rows = [(k, i, rng.randrange(0, 40)) for k in ("a", "b", None) for i in range(120)] + [("over", 1, 500), ("over", 2, 100), ("over", 3, 1)]
    want = set()
    for key in {r[0] for r in rows}:
        used = 0
        for k, i, x in rows:
            if k == key and used + x <= 100:
                used += x
                want.add((k, i))
    df = spark.createDataFrame(rows, "k string, i int, x bigint")
    got = [(r.k, r.i) for r in s.skip_fit(df, ["k"], ["i"], "x", 100).collect()]
    assert set(got) == want and len(got) == len(want)
    assert s.skip_fit(df.limit(0), ["k"], ["i"], "x", 100).count() == 0
