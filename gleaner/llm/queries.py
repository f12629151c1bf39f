"""The training-data queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import group_split, mixing, overlap, packing, skeleton, splitting, stable_sample
from gleaner.llm.tokens import with_tokens
from gleaner.session import materialise, spread, table

RATES = {"probe": Fraction(1, 50), "greedy": Fraction(1, 10)}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, sf, "utt_index", "id", "split", "ref", "hyp"))
    return pairs.select(F.least("id_held", "id_train").alias("id_a"), F.greatest("id_held", "id_train").alias("id_b"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "utt_index", "id", "source", "split", "ref", "hyp"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, sf, "utt_index", "id", "ref", "hyp"), "id", "ref", "hyp")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "utt_index", "ref", "hyp").select(F.explode(F.array("ref", "hyp")).alias("text"))
    return skeleton.look_alike_groups(texts, "text")


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    flags = ("in_probe", "in_greedy_subset")
    earlier = table(spark, sf, "selection", "id", "snap", "split", "keep", *flags).filter("keep").drop("keep")
    now = table(spark, sf, "utt_index", "id", "split", *flags).withColumn("snap", F.lit(3))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("marked")) for k, c in zip(("probe", "greedy"), flags)))
    return earlier.unionByName(now).select("id", "snap", "split", F.explode(kinds).alias("k")).select("id", "snap", "split", "k.*")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return stable_sample.lost_members(_marks(spark, sf))


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return _marks(spark, sf).filter("(kind = 'probe' and split = 'train') or (kind = 'greedy' and split in ('dev', 'eval'))")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stable_sample.frozen_sample(stable_sample.arrivals(_sampled(spark, sf)), RATES)


def p3_continued(spark: SparkSession, sf: str) -> DataFrame:
    return stable_sample.continued_sample(_sampled(spark, sf), RATES, 3)


def p3_drift(spark: SparkSession, sf: str) -> DataFrame:
    return stable_sample.sample_drift(_sampled(spark, sf), RATES)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_split.split_leaks(table(spark, sf, "utt_index", "id", "split", "media_key"), table(spark, sf, "recording", "media_key", "channel", "reupload_of"))


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    # The table of split targets is fixed at three rows.
    targets = {r["split"]: r.target_share for r in table(spark, sf, "split_target").collect()}
    return group_split.grouped_splits(table(spark, sf, "utt_index", "id", "source", "split", "media_key"), table(spark, sf, "recording", "media_key", "channel", "reupload_of"), targets)


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _grouped(spark, sf)


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = _grouped(spark, sf)
    by = rows.groupBy(F.col("new_split").alias("split")).agg(F.count("*").alias("n"), F.countDistinct("group").alias("n_groups"))
    by = by.crossJoin(by.agg(F.sum("n").alias("n_all")))
    return by.join(table(spark, sf, "split_target"), "split").select("split", "n", "n_groups", "target_share", F.round(F.col("n") / F.col("n_all"), 6).alias("actual_share"))


def p4_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """How far each source's shares in the splits are from the targets, now and as assigned."""
    rows = _grouped(spark, sf).select("id", "new_split")
    old = table(spark, sf, "utt_index", "id", "source", "split").filter("id is not null").groupBy("id").agg(F.min("source").alias("source"), F.min("split").alias("split"))
    both = rows.join(old, "id").select("source", F.explode(F.array(F.struct(F.lit("assigned").alias("state"), F.col("new_split").alias("split")), F.struct(F.lit("present").alias("state"), F.col("split").alias("split")))).alias("x")).select("source", "x.*").filter("split is not null")
    n = both.groupBy("source", "state", "split").agg(F.count("*").alias("n"))
    whole = n.groupBy("source", "state").agg(F.sum("n").alias("n_all"))
    # Three targets beside each source and state.
    cells = whole.crossJoin(table(spark, sf, "split_target")).join(n, ["source", "state", "split"], "left")
    share = F.coalesce("n", F.lit(0)) / F.col("n_all")
    return cells.select("source", "state", "split", F.coalesce("n", F.lit(0)).alias("n"), F.round(share, 6).alias("share"), "target_share", F.round(F.abs(share - F.col("target_share")), 6).alias("deviation"))


def _limits(spark: SparkSession, sf: str, kind: str) -> list[tuple[str, int, int]]:
    # The table of limits is fixed at four rows.
    return sorted((r.limit_name, r.max_tokens, r.overlap_tokens) for r in table(spark, sf, "size_limit").collect() if r.limit_name.startswith(kind))


def _packed(spark: SparkSession, sf: str) -> list[tuple[str, int, DataFrame]]:
    sizes = with_tokens(spread(table(spark, sf, "documents", "doc_id", "text")), keep_text=False)
    counted = packing.counted_items(sizes, "doc_id", "n_tokens")
    return [(name, most, packing.pack_counted(counted, most)) for name, most, _ in _limits(spark, sf, "pack_")]


def _all(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("size_limit has no pack_ row")
    return reduce(DataFrame.unionByName, parts)


def p5_containers(spark: SparkSession, sf: str) -> DataFrame:
    out = [places.select(F.lit(name).alias("limit_name"), "container", F.col("item").alias("doc_id"), "part", "place", F.col("size").alias("n_tokens")) for name, _, places in _packed(spark, sf)]
    return _all(out)


def p5_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = [packing.fill_report(places, most).withColumn("limit_name", F.lit(name)) for name, most, places in _packed(spark, sf)]
    return _all(out)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf, "documents", "source", "n_chars"), table(spark, sf, "mix_target"), "n_chars")
    return plan.filter("short").select("source")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialise(with_tokens(spread(table(spark, sf, "documents", "doc_id", "source", "text")), keep_text=False), "tokens")
    plan = mixing.mixing_plan(sizes, table(spark, sf, "mix_target"), "n_tokens")
    return mixing.replicate(sizes, plan, "doc_id"), plan


def p6_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixed, plan = _mixed(spark, sf)
    return mixing.share_report(mixed, plan, "n_tokens")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.unbroken_texts(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", 1_200).select("doc_id").distinct()


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_texts(spread(table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text", _limits(spark, sf, "piece_"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_groups, p3_found, p3_sample, p3_continued, p3_drift, p4_found, p4_splits, p4_shares, p4_deviation, p5_containers, p5_fill, p6_found, p6_mix, p6_shares, p7_found, p7_pieces)}


def oracle_sql() -> dict[str, str]:
    from gleaner.llm.sql import SQL

    return SQL
