from pyspark.sql import functions as F

from gleaner import session


def test_scratch_is_kept_apart_and_cleared(spark, tmp_path):
    from gleaner.sources.files import exists

    one = session.materialise(spark.range(5).withColumn("x", F.lit("a")), "step")
    assert one.count() == 5 and spark.sparkContext.applicationId in one._scratch_path
    session.discard(one)
    assert not exists(spark, one._scratch_path)
    two = session.materialise(spark.range(3), "step")
    session.clear_scratch(spark)
    assert not exists(spark, two._scratch_path)


def test_operators_hand_the_package_to_the_tasks(spark):
    from gleaner.functions import scoring

    # A frame of the caller's own, not read by ``session.table``.
    df = spark.createDataFrame([("今日", "きょう")], "ref string, hyp string")
    assert scoring.with_scores(df).first().edits == 3 and df.select(scoring.normalised("ref").alias("x")).first().x == "今日"
