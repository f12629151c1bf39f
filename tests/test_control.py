import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import arrays, nested, ticks
from gleaner.operators import guards
from gleaner.operators import relations as rel
from gleaner.sources import files
from gleaner.sources.retry import with_retries
from gleaner.streaming import tail


def test_config_problems():
    rules = {"rate": (float, 0.0, 1.0), "name": str, "deep": {"n": (int, 1, 9), "on": bool}}
    assert guards.config_problems({"rate": 0.5, "name": "x", "deep": {"n": 3, "on": True}}, rules) == []
    found = guards.config_problems({"rate": 2.0, "deep": {"n": True, "other": 1}, "more": 1}, rules)
    assert found == ["missing name", "unknown more", "range of rate", "missing deep.on", "unknown deep.other", "type of deep.n"]
    assert guards.config_problems({"rate": 0.1, "name": "x", "deep": 3}, rules) == ["type of deep"]


def test_json_problems(spark):
    rows = ['{"k": 5}', '{"k": -1, "b": 1, "a": 2}', '{"k": "x"}', "{}", "[1]", "torn {", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, c string")
    got = {r.i: r.p for r in df.select("i", nested.json_problems(F.col("c"), {"k": (0, 9)}).alias("p")).collect()}
    assert got == {0: [], 1: ["range of k", "unknown a", "unknown b"], 2: ["type of k"], 3: ["missing k"], **{i: ["not an object"] for i in (4, 5, 6, 7)}}


def test_manifests_of_all_layouts(spark):
    import hashlib

    sha = lambda *ids: hashlib.sha256("\n".join(ids).encode()).hexdigest()
    texts = [
        {"sets": {"a": {"ids": ["x", "y"], "ids_sha256": sha("x", "y")}, "note": {"made": 1}}}, {"eval_sets": {"b": {"ids": ["x"], "sha256": sha("z")}}}, {"c": {"ids": ["x", "x"], "ids_sha256": sha("x", "x")}},
        {"d": {"ids": ["x"]}}, {"e": {"ids": [], "sha256": sha()}},
    ]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts] + [(None,), ("torn",)], "m string")
    sets = df.select(F.explode(nested.manifest_sets(F.col("m"))).alias("s")).select("s.*")
    assert {r.name: r.state for r in sets.select("name", nested.set_state(F.col("ids"), F.col("digest")).alias("state")).collect()} == {"a": "verified", "b": "other ids", "c": "duplicates", "d": "no digest", "e": "verified"}


def test_refusal(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    rows = [("good", "a"), ("good", "b"), ("less", "a"), ("more", "a"), ("more", "b"), ("more", "c"), ("twice", "a"), ("twice", "a"), ("twice", "b")]
    systems = spark.createDataFrame(rows, "system string, id string")
    got = {r.system: (r.n_missing, r.n_extra, r.n_duplicate, r.refused) for r in guards.coverage(systems, wanted).collect()}
    assert got == {"good": (0, 0, 0, False), "less": (1, 0, 0, True), "more": (0, 1, 0, True), "twice": (0, 0, 1, True)}
    assert guards.aligned_or_refused(systems.filter("system = 'good'"), wanted).count() == 2
    with pytest.raises(ValueError, match="manifest"):
        guards.aligned_or_refused(systems, wanted)


def test_plan_order(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "b"), ("x", "y")], "node string, needs string")
    wanted = spark.createDataFrame([("a",)], "node string")
    assert [(r.node, r.level) for r in rel.ordered_plan(edges, wanted).orderBy("place").collect()] == [("d", 0), ("b", 1), ("c", 2), ("a", 3)]
    assert [r.node for r in rel.ordered_plan(edges, spark.createDataFrame([("d",)], "node string")).collect()] == ["d"]


def test_merged_leaves(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "z": "4"}), ({"a": "1"}, {})], "x map<string,string>, y map<string,string>")
    got = [r.m for r in df.select(nested.merged_leaves(F.col("x"), F.col("y")).alias("m")).collect()]
    assert (got[0].leaves, got[0].unknown) == ({"a": "1", "b": "3"}, ["z"]) and (got[1].leaves, got[1].unknown) == ({"a": "1"}, [])


def test_ragged_round_trip(spark):
    df = spark.createDataFrame([([["a", "b"], [], ["c"]],), ([[]],)], "x array<array<string>>")
    back = df.select("x", arrays.ragged(F.flatten("x"), arrays.offsets(F.col("x"))).alias("y")).collect()
    assert all(r.x == r.y for r in back)


def test_ticks_in_rows_equal_ticks_on_the_driver(spark):
    spans = [(0.0, 10.0), (0.13, 0.31), (3.0, 3.0), (-5.0, 1234.0), (0.0, 0.7), (2.0, 3.0)]
    df = spark.createDataFrame(spans, "lo double, hi double")
    for r in df.select("lo", "hi", ticks.linear_ticks(F.col("lo"), F.col("hi")).alias("t")).collect():
        assert r.t == pytest.approx(ticks.linear(r.lo, r.hi))


def test_retries():
    waits, errors = [], [OSError("a"), OSError("b")]

    def read():
        if errors:
            raise errors.pop()
        return 7

    assert with_retries(read, "x", first_wait=2.0, pause=waits.append, seed=1) == (7, 3)
    assert 1.0 <= waits[0] <= 2.0 <= waits[1] <= 4.0
    with pytest.raises(FileNotFoundError):
        with_retries(lambda: open("/nowhere/at/all"), "x", pause=waits.append)
    with pytest.raises(RuntimeError, match="2 tries"):
        with_retries(lambda: 1 / 0, "x", tries=2, pause=waits.append)
    assert len(waits) == 3


def test_orphans_and_pulls(spark):
    listing = spark.createDataFrame([("s", 0), ("s", 1), ("s", 2), ("s", 4), ("s", 5), ("t", 0)], "k string, n int")
    manifest = spark.createDataFrame([("s", 0), ("s", 2), ("s", 4), ("s", 4)], "k string, n int")
    assert {(r.k, r.n): r.state for r in files.orphans(listing, manifest, ["k"], "n").collect()} == {("s", 0): "listed", ("s", 1): "refuse", ("s", 2): "listed", ("s", 4): "listed", ("s", 5): "remove", ("t", 0): "remove"}
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "path string")
    assert sorted(map(tuple, files.pull_plan(wanted, wanted.filter("path = 'a'")).collect())) == [("a", "pull"), ("b", "missing")]


def test_parts_of_several_widths(spark, tmp_path):
    spark.range(2).selectExpr("id", "cast(1 as int) as a", "cast(2 as float) as b").write.parquet(f"{tmp_path}/0")
    spark.range(2).selectExpr("id", "cast(1 as bigint) as a", "cast(2 as int) as b", "'x' as c").write.parquet(f"{tmp_path}/1")
    spark.range(1).selectExpr("'k' as c", "true as b").write.parquet(f"{tmp_path}/2")
    assert dict(files.read_parts(spark, [f"{tmp_path}/{i}" for i in (0, 1)]).dtypes) == {"id": "bigint", "a": "bigint", "b": "double", "c": "string"}
    assert dict(files.read_parts(spark, [f"{tmp_path}/{i}" for i in (0, 1, 2)]).dtypes)["b"] == "string"


def test_batches_of_rows(spark):
    assert [len(x) for x in files.iter_rows(spark.range(600), 256)] == [256, 256, 88] and list(files.iter_rows(spark.range(0))) == []


def test_content_digest(spark):
    df = spark.range(50).selectExpr("id", "if(id % 3 = 0, null, id) as x")
    assert guards.content_digest(df.repartition(5), ["id"]) == guards.content_digest(df, ["id"]) != guards.content_digest(df.limit(49), ["id"])


def test_changes_are_compacted_and_repeatable(spark, tmp_path):
    schema = "k string, at int, v int"
    last = tail.last_values(["k"], "at", ["v"])
    for i in range(5):
        spark.createDataFrame([("a", i, 10 + i), (f"k{i}", 1, i)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    compact, tail.COMPACT = tail.COMPACT, 2
    try:
        run = lambda: tail.keep_changes(tail.tail(spark, f"{tmp_path}/in", schema, "parquet", 1), last, last, f"{tmp_path}/out", f"{tmp_path}/state")
        with pytest.raises(FileNotFoundError):
            tail.changes(spark, f"{tmp_path}/out", last)
        run(), run()
    finally:
        tail.COMPACT = compact
    assert [n for n in files.listed(spark, f"{tmp_path}/out") if n.startswith("base=")] == ["base=0000000001", "base=0000000003"]
    assert {r.k: r.v for r in tail.changes(spark, f"{tmp_path}/out", last).collect()} == {"a": 14, **{f"k{i}": i for i in range(5)}}


def test_follow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p0").write_text("x")
    seen, turn = [], iter(range(9))

    def pause():
        k = next(turn)
        if k == 0:
            (tmp_path / "in" / "p1").write_text("x")
            (tmp_path / "hold").write_text("")
        elif k == 1:
            (tmp_path / "hold").unlink()
            (tmp_path / "done").write_text("")

    counts = tail.follow(spark, f"{tmp_path}/in", lambda names, n: seen.append((n, names)), f"{tmp_path}/done", f"{tmp_path}/hold", pause)
    assert seen == [(0, ["p0"]), (1, ["p1"])] and counts == {"rounds": 2, "held": 1, "idle": 1}
