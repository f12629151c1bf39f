from gleaner.operators import verdict as v

H = "run string, step int, epoch double, phase string, rate double, rate_full double, held double, probe double"
F = "run string, set int, student double, teacher double, n int, n_truncated int"


def history(run, rates, held=None, probe=None, phase="stable", gap=1.0):
    n = len(rates)
    held, probe = held or [1.0] * n, probe or [0.9] * n
    return [(run, 0, 0.0, "warm-up", 50.0, None, 9.0, 9.0)] + [(run, 10 * (i + 1), gap * (i + 1), phase, r, None, h, p) for i, (r, h, p) in enumerate(zip(rates, held, probe))]


def final(run, ratios, truncated=0):
    return [(run, i, float(r), 1.0, 1000, truncated) for i, r in enumerate(ratios)]


def verdicts(spark, rows, sets, **more):
    return {r.run: r for r in v.verdicts(spark.createDataFrame(rows, H), spark.createDataFrame(sets, F), **more).collect()}


FLAT, FALLING = [1.3] * 5, [1.6, 1.5, 1.4, 1.3, 1.2]


def test_every_branch(spark):
    rows = history("go", FLAT) + history("cut", FLAT) + history("near", FALLING) + history("flat", FLAT) + history("far", FALLING) + history("near flat", FLAT) + history("one", [1.3])
    rows += history("over", FLAT, held=[1.0, 1.1, 1.2, 1.3, 1.4], probe=[1.0, 0.9, 0.8, 0.7, 0.6])
    sets = final("go", [1.1, 1.2, 9]) + final("cut", [1.1, 1.1, 1.1], 9) + final("near", [1.4, 1.5, 9]) + final("flat", [1.4, 2, 2]) + final("far", [2, 2, 2]) + final("near flat", [1.4, 1.4, 2]) + final("one", [1.0, 9, 9]) + final("over", [1, 1, 1])
    got = verdicts(spark, rows, sets)
    assert {k: (r.verdict, r.reason) for k, r in got.items()} == {
        "go": ("GO", "within reach"), "cut": ("INCONCLUSIVE", "within reach but flat"), "near": ("PROMISING", "still improving"), "flat": ("NO-GO", "out of reach and flat"), "far": ("INCONCLUSIVE", "out of reach but improving"),
        "near flat": ("INCONCLUSIVE", "within reach but flat"), "one": ("INCONCLUSIVE", "trend unknown"), "over": ("NO-GO", "over-fitting"),
    }


def test_second_version_reads_before_the_cool_down(spark):
    cooled = history("cooled", [1.3, 1.3, 1.3]) + [("cooled", 100, 9.0, "cooldown", 0.9, None, 1.0, 0.9)]
    close = history("close", FALLING, gap=0.1)
    rows, sets = cooled + close, final("cooled", [1.4, 1.4, 2]) + final("close", [1.4, 1.4, 2])
    first, second = verdicts(spark, rows, sets), verdicts(spark, rows, sets, version=2)
    assert (first["cooled"].verdict, second["cooled"].verdict) == ("PROMISING", "INCONCLUSIVE")
    assert second["cooled"].rate_change == 0.0 and second["close"].rate_change is None and first["close"].verdict == "PROMISING"


def test_odd_input(spark):
    got = verdicts(spark, history("no final", FLAT), [("no history", 0, 0.0, 0.0, 1, 0), ("no history", 1, 1.0, 0.0, 1, 0)])
    assert got["no final"].n_go == 0 and got["no final"].verdict == "NO-GO" and got["no history"].n_go == 1 and got["no history"].reason == "trend unknown"
    assert verdicts(spark, [], []) == {}
