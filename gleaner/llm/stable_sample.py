"""Samples that stay the same across runs and layouts and only grow (problem 3).

Method: frozen batch bottom-k. Records belong to the batch they arrived in, and a batch never changes
afterwards. Of each batch exactly ``ceil(rate * size)`` records are kept, those with the smallest
salted hashes; the sample is the union of the batches, so it is append-only.

The k-th smallest hash of a batch is found without gathering the batch: counts of hash prefixes give
the prefix in which it lies, and only the records of that prefix are ranked.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREFIX = 4  # hexadecimal digits: 65,536 prefixes for each batch
COPIES = 32  # of a batch's limit, so that a batch that holds most records is spread over tasks


def salted_hash(record: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), record.cast("string")), 256)


def arrivals(snapshots: DataFrame) -> DataFrame:
    """``id, kind, batch``: the first snapshot in which each record of each kind is a member.

    ``snapshots`` has ``id, kind, snap``; rows with a null in one of them are no members, repeated
    rows count once.
    """
    return snapshots.na.drop(subset=["id", "kind", "snap"]).groupBy("id", "kind").agg(F.min("snap").alias("batch"))


def frozen_sample(arrived: DataFrame, rate: dict[str, Fraction], salt: str = "frozen") -> DataFrame:
    """The members of the sample: ``id, kind, batch``, ``ceil(rate[kind] * size)`` of each kind and batch.

    ``arrived`` is what ``arrivals`` gives. Hash ties are broken by id. A kind without a rate has no
    sample; an empty batch has none either.
    """
    share = F.lit(None).cast("struct<num:bigint,den:bigint>")
    for kind, r in rate.items():
        share = F.when(F.col("kind") == kind, F.struct(F.lit(r.numerator).cast("bigint").alias("num"), F.lit(r.denominator).cast("bigint").alias("den"))).otherwise(share)
    hashed = arrived.select("id", "kind", "batch", salted_hash(F.col("id"), salt).alias("h")).withColumn("p", F.substring("h", 1, PREFIX))
    counts = hashed.groupBy("kind", "batch", "p").agg(F.count("*").alias("n"))
    whole = W.partitionBy("kind", "batch")
    limits = (
        counts.withColumn("upto", F.sum("n").over(whole.orderBy("p")))
        .withColumn("size", F.sum("n").over(whole))
        .withColumn("r", share)
        .filter("r is not null")
        .withColumn("k", F.expr("(size * r.num + r.den - 1) div r.den"))
        .filter("upto - n < k and k <= upto")
        .select("kind", "batch", F.col("p").alias("limit"), (F.col("k") - F.col("upto") + F.col("n")).alias("left"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    )
    placed = hashed.withColumn("copy", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(COPIES)).cast("int")).join(limits, ["kind", "batch", "copy"]).filter("p <= limit")
    sure = placed.filter("p < limit").select("id", "kind", "batch")
    edge = placed.filter("p = limit").withColumn("rank", F.row_number().over(whole.orderBy("h", "id")))
    return sure.unionByName(edge.filter(F.col("rank") <= F.col("left")).select("id", "kind", "batch"))


def frozen_union(marks: DataFrame) -> DataFrame:
    """The union of the batches before each snapshot, beside the snapshot's own marks.

    ``marks`` has ``id, kind, snap, marked``, one row or more for each membership; a record counts as
    marked in a snapshot if one of its rows says so. Adds ``frozen``: the record was marked as a
    member of an earlier snapshot, so it belongs to the append-only union. One shuffle, by id.
    """
    own = marks.na.drop(subset=["id", "kind", "snap"]).repartition("id")
    own = own.groupBy("id", "kind", "snap").agg(F.bool_or(F.coalesce("marked", F.lit(False))).alias("marked"))
    before = W.partitionBy("id", "kind").orderBy("snap").rowsBetween(W.unboundedPreceding, -1)
    return own.withColumn("frozen", F.coalesce(F.max("marked").over(before), F.lit(False)))


def lost_members(marks: DataFrame) -> DataFrame:
    """``id, kind, snap``: members of the append-only union that a later snapshot doesn't mark."""
    return frozen_union(marks).filter("frozen and not marked").select("id", "kind", "snap")


def continued_sample(marks: DataFrame, rate: dict[str, Fraction], snap: int, salt: str = "frozen") -> DataFrame:
    """The sample of snapshot ``snap``: ``id, kind, origin``.

    ``frozen`` are its members that an earlier snapshot marked, ``new`` the bottom-k of the batch that
    arrives with it. Later snapshots are left out, so the sample of a snapshot never changes.
    """
    known = marks.filter(F.col("snap") <= snap)
    frozen = frozen_union(known).filter((F.col("snap") == snap) & F.col("frozen")).select("id", "kind", F.lit("frozen").alias("origin"))
    new = frozen_sample(arrivals(known).filter(F.col("batch") == snap), rate, salt).select("id", "kind", F.lit("new").alias("origin"))
    return frozen.unionByName(new)


def sample_drift(marks: DataFrame, rate: dict[str, Fraction], salt: str = "frozen") -> DataFrame:
    """Per kind and batch: size, wanted and frozen sample, and how many of it the snapshots mark."""
    arrived = arrivals(marks)
    sample = frozen_sample(arrived, rate, salt).withColumn("in_sample", F.lit(True))
    marked = marks.filter("marked").select("id", "kind").distinct().withColumn("is_marked", F.lit(True))
    return (
        arrived.join(sample, ["id", "kind", "batch"], "left")
        .join(marked, ["id", "kind"], "left")
        .groupBy("kind", "batch")
        .agg(F.count("*").alias("n_members"), F.count("in_sample").alias("n_sample"), F.count("is_marked").alias("n_marked"), F.count_if(F.col("in_sample") & F.col("is_marked")).alias("n_both"))
    )
