import pytest
from pyspark.sql import functions as F

from gleaner.operators import guards as g


def test_refusals(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    assert g.refuse(df, F.col("k") > 5, "too large") is df
    with pytest.raises(ValueError, match="no value"):
        g.refuse(df, F.col("v").isNull(), "no value")
    with pytest.raises(ValueError, match="more than once"):
        g.refuse_duplicates(df, ["k"])
    path = str(tmp_path / "meta")
    assert g.write_once(spark, path, {"a": 1, "b": [2]}) and not g.write_once(spark, path, {"b": [2], "a": 1})
    with pytest.raises(ValueError):
        g.write_once(spark, path, {"a": 2})


def test_settings():
    assert g.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    with pytest.raises(KeyError, match="a.x"):
        g.merged({"a": {"b": 1}}, {"a": {"x": 1}})
    assert g.looked_up({"a": {"b": 0}}, "a.b") == 0 and g.looked_up({"a": 1}, "a.b") is None
    assert g.digest({"b": 1, "a": "あ"}) == g.digest({"a": "あ", "b": 1})


def test_cursor():
    c = g.Cursor([1, 2])
    c.epoch, c.step = 3, 4
    assert g.Cursor([1, 2]).resume(c.state()).step == 4
    with pytest.raises(ValueError):
        g.Cursor([1]).resume(c.state())


def test_contents(spark):
    a = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1), ("w", 1)], "unit string, k int")
    b = spark.createDataFrame([("u", 2), ("u", 1), ("u", 1), ("v", 2), ("x", 1)], "unit string, k int")
    assert {r.unit: r.complete for r in g.content_matches(a, b, ["unit"], "k").collect()} == {"u": True, "v": False, "w": False, "x": False}
