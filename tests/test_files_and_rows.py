import pytest
from pyspark.sql import functions as F

from gleaner.functions import nested
from gleaner.functions.text import fold_name
from gleaner.operators import relations as rel
from gleaner.operators import rows
from gleaner.sources import files


def test_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n{"a": 3, "b"\n{"a": 4}\n{"a": 5')
    whole, torn = files.read_whole_lines(spark, str(path), "a int, b string")
    assert sorted(r.a for r in whole.collect()) == [1, 2, 4] and torn.count() == 2
    assert [r.a for r in files.read_up_to(spark, str(path), "a int, b string", 30).collect()] == [1, 2]
    assert files.read_up_to(spark, str(path), "a int, b string", 4).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_lines(spark, str(path), "a int, b string").collect()


def test_pairs_parts_and_shards(spark, tmp_path):
    members = spark.createDataFrame([("k1", "mp3", "a"), ("k1", "json", "b"), ("k2", "json", "c"), ("k3", "mp3", None), ("k3", "json", "d")], "k string, kind string, p string")
    assert [tuple(r) for r in files.paired(members, "k", "kind", "p", "mp3", "json").collect()] == [("k1", "a", "b")]
    manifest = files.write_shards(spark.range(1000).withColumn("s", F.lit("x")).coalesce(1), str(tmp_path / "shards"), ["s"], 300)
    assert sorted(r.n_rows for r in manifest.collect()) == [100, 300, 300, 300]
    spark.range(2).write.parquet(str(tmp_path / "parts/p=1"))
    spark.range(2).withColumn("extra", F.lit("y")).write.parquet(str(tmp_path / "parts/p=2"))
    assert set(files.read_parts(spark, [str(tmp_path / f"parts/p={i}") for i in (1, 2)]).columns) == {"id", "extra"}


def test_export_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "a|b\nc")], "i int, xs array<int>, t string")
    assert files.export(df, str(tmp_path / "e1"), 10) and not files.export(df, str(tmp_path / "e2"), 0)
    assert files.markdown(df.select("i", "t")) == ["| i | t |", "| --- | --- |", "| 1 | a\\|b c |"]
    with pytest.raises(ValueError):
        files.markdown(spark.range(3).toDF("i"), limit=2)


def test_cascade_order_and_float_threshold(spark):
    df = spark.createDataFrame([(1, True, 0.9), (2, False, None), (3, False, 0.2), (4, None, 0.3)], "id int, cut boolean, agree float")
    limit = rows.threshold(F.lit("s"), {}, 0.2)
    reason = rows.cascade([("cut", F.col("cut")), ("none", F.col("agree").isNull()), ("high", F.col("agree") > limit)])
    base = df.withColumn("reason", reason)
    assert [r.reason for r in base.orderBy("id").collect()] == ["cut", "none", "kept", "high"]
    assert [r.reason for r in rows.staged(base, [("late", F.lit(True)), ("later", F.lit(True))]).orderBy("id").collect()] == ["cut", "none", "late", "high"]
    assert rows.staged(base, []).columns == base.columns and rows.cascade([]) is not None


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 3, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in rows.first_rows(df, ["k"], [F.col("o")]).collect()} == {("a", "x"), (None, "y"), ("b", "z")}
    assert {(r.k, r.v) for r in rows.last_rows(df, ["k"], [F.col("o")]).collect()} == {("a", None), (None, "y"), ("b", "z")}


def test_relations(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "node string, needs string")
    assert {r.node for r in rel.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {"a", "b", "c"}
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, None), (4, 3.0)], "k int, v double")
    assert tuple(rel.differences(a, b, ["k"], ["v"]).first()) == ("v", 2, 1, 0.5)
    both = {r.k: (r.in_a, r.in_b) for r in rel.aligned(a, b, ["k"]).collect()}
    assert both == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, True)}
    assert tuple(rel.first_difference(a, b, "k", "v").first()) == (4, False, 1)


def test_nested(spark):
    df = spark.createDataFrame([(1, ((2, "x"), True), None)], "id int, m struct<a: struct<n: int, s: string>, b: boolean>, z double")
    assert {(r.path, r.value) for r in nested.flattened(df, ["id"]).collect()} == {("m.a.n", 2.0), ("z", None)}


def test_names(spark):
    cases = {" ＡＢ　ｃ ": "ab c", "ｶﾞｷﾞ": "ガギ", "　x": "x", "": "", "ﾊﾟ ": "パ"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.f for r in df.select("t", fold_name(F.col("t")).alias("f")).collect()}
    assert got == cases | {None: None}
