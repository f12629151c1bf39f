"""Splits that keep related records together (problem 4).

Method: iterative minimum-label propagation over the bipartite graph of records and entities, then a
stratified assignment of whole groups that keeps the label distribution of the splits near the target.

Each round gives an entity the least label of its records and each record, and each record's former
label, the least label of its entities, and then follows labels one step; the number of rounds grows
with the logarithm of the longest chain. Minima are combined before the shuffle, and an entity with
very many records is spread over tasks, so neither a hot entity nor a giant group lands in one task.
Rounds are cut from each other by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fold_name
from gleaner.session import discard, materialise

# What stands for an unknown channel.
NO_CHANNEL = ("", "-", "unknown", "n/a", "不明")
SPREAD = 50_000
LARGE = 2_000
BUCKETS = 512
STRATA = 512


def recording_of(record: Column, media_key: Column) -> Column:
    """The recording of an utterance: its media key, or what its name says."""
    name = F.when(F.instr(record, "/") > 0, F.regexp_extract(record, "(?s)^[^/]*/(.*)$", 1)).otherwise(record)
    named = (
        F.when(name.rlike("^JA_.*_W"), F.regexp_extract(name, "(?s)^JA_(.*)_W", 1))
        .when(F.instr(name, "/") > 0, F.regexp_extract(name, "(?s)^(.*)/", 1))
        .when(F.instr(name, "_") > 0, F.regexp_extract(name, "(?s)^(.*)_", 1))
        .otherwise(name)
    )
    return F.when(F.length(media_key) > 0, media_key).otherwise(named)


def recording_links(recordings: DataFrame) -> DataFrame:
    """``record, entity``: each recording with its own key, its parent's key and its channel as entities.

    A parent is a record with its own key too, listed or not, so that its utterances join the group.
    """
    channel = fold_name(F.col("channel"))
    known = channel.isNotNull() & ~channel.isin(*NO_CHANNEL)
    entities = F.array_compact(
        F.array(
            F.concat(F.lit("r:"), "media_key"),
            F.when(F.length("reupload_of") > 0, F.concat(F.lit("r:"), "reupload_of")),
            F.when(known, F.concat(F.lit("c:"), channel)),
        )
    )
    listed = recordings.filter("media_key is not null").select(F.col("media_key").alias("record"), F.explode(entities).alias("entity"))
    parents = recordings.filter("media_key is not null and length(reupload_of) > 0").select(F.col("reupload_of").alias("record"), F.concat(F.lit("r:"), "reupload_of").alias("entity"))
    return listed.unionByName(parents).distinct()


def connected_groups(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``record, group``: the least record of each connected group, from ``record, entity`` links.

    Rows with a null are no links. Records whose entities no other record has are their own group.
    """
    links = links.na.drop(subset=["record", "entity"]).select("record", "entity").distinct()
    links = materialise(links, "links")
    degrees = links.groupBy("entity").agg(F.count("*").alias("degree")).filter("degree > 1")
    parts = F.ceil(F.col("degree") / SPREAD).cast("int")
    edges = materialise(
        links.join(degrees, "entity").select("record", "entity", parts.alias("parts"), F.pmod(F.xxhash64("record"), parts).cast("int").alias("part")), "edges"
    )
    # Labels are written compressed, so their file size would let the planner broadcast far more than it means to.
    labels = materialise(edges.select("record", F.col("record").alias("label")).distinct(), "labels")
    for _ in range(max_rounds):
        known = edges.join(labels.select("record", "label").hint("merge"), "record")
        least = known.groupBy("entity").agg(F.min("label").alias("least"), F.max("parts").alias("parts"))
        least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        moved = known.join(least.hint("merge"), ["entity", "part"])
        # The record's own label goes along, so that a change shows without another join.
        offers = moved.select(F.explode(F.array(F.struct("record", "least", F.col("label").alias("own")), F.struct(F.col("label").alias("record"), "least", F.lit(None).cast("string").alias("own")))).alias("o")).select("o.*")
        hooked = offers.groupBy("record").agg(F.min("least").alias("label"), F.max("own").alias("own"))
        onward = hooked.select(F.col("record").alias("label"), F.col("label").alias("next"))
        stepped = hooked.join(onward.hint("merge"), "label", "left").select("record", F.least("label", "next").alias("label"), "own")
        new = materialise(stepped.withColumn("moved", F.col("label") != F.col("own")).drop("own"), "labels")
        changed = not new.filter("moved").isEmpty()
        discard(labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    alone = links.select("record").distinct().join(labels.hint("merge"), "record", "left")
    return alone.select("record", F.coalesce("label", "record").alias("group"))


def utterance_groups(utterances: DataFrame, recordings: DataFrame) -> DataFrame:
    """``id, source, split, recording, group`` of each utterance; repeated rows of an id come out once."""
    groups = connected_groups(recording_links(recordings))
    rows = utterances.filter("id is not null").select("id", "source", "split", recording_of(F.col("id"), F.col("media_key")).alias("recording")).distinct()
    return rows.join(groups.withColumnRenamed("record", "recording"), "recording", "left").withColumn("group", F.coalesce("group", "recording"))


def split_leaks(utterances: DataFrame, recordings: DataFrame) -> DataFrame:
    """``id``: utterances of held-out splits whose group has a training utterance.

    Splits are gathered for each recording before anything is joined, so a recording with most of the
    rows is one row by then.
    """
    rows = utterances.filter("id is not null and split in ('train', 'dev', 'eval')").select("id", "split", recording_of(F.col("id"), F.col("media_key")).alias("recording"))
    flags = rows.groupBy("recording").agg(F.bool_or(F.col("split") == "train").alias("trains"), F.bool_or(F.col("split") != "train").alias("held"))
    groups = connected_groups(recording_links(recordings)).withColumnRenamed("record", "recording")
    flags = flags.join(groups, "recording", "left").withColumn("group", F.coalesce("group", "recording"))
    mixed = flags.groupBy("group").agg(F.bool_or("trains").alias("trains"), F.bool_or("held").alias("held")).filter("trains and held")
    leaking = flags.filter("held").join(mixed.select("group"), "group", "left_semi").select("recording")
    return rows.filter("split != 'train'").join(leaking, "recording", "left_semi").select("id").distinct()


def assign_splits(members: DataFrame, targets: dict[str, float], salt: str = "split") -> DataFrame:
    """``group, new_split``: whole groups spread so that each split nears its share, stratum by stratum.

    ``members`` has ``group, stratum``, one row for each record. The at most 2,000 groups that hold
    1/2,000 of all records or more are placed one by one, largest first, where they leave the least
    squared deviation from the target counts of their strata. All others are placed by hash order
    within their main stratum, with the cuts where the weights gathered in 512 hash buckets meet
    what the splits still lack. Strata are folded into 512 cells, so that few share one. Depends on the members only, not on their order or layout.
    """
    cell = F.pmod(F.xxhash64(F.coalesce(F.col("stratum"), F.lit(""))), F.lit(STRATA)).cast("int")
    parts = members.filter("group is not null").groupBy("group", cell.alias("cell")).agg(F.count("*").alias("n"))
    biggest = F.max(F.struct(F.col("n"), F.col("cell")))
    groups = materialise(
        parts.groupBy("group").agg(F.sum("n").alias("size"), biggest["cell"].alias("main"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("parts")), "groups"
    )
    totals = {r.cell: r.n for r in groups.select(F.explode("parts").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    whole = sum(totals.values())
    share_sum = sum(targets.values()) or 1.0
    lack = {s: {c: n * share / share_sum for c, n in totals.items()} for s, share in targets.items()}
    names = sorted(targets)
    large = groups.filter(F.col("size") * LARGE >= whole).collect()
    placed = {}
    for g in sorted(large, key=lambda g: (-g.size, g.group)):
        # Adding n where a is lacking changes the squared deviation by n * (n - 2 * a); smaller targets count as much as larger.
        best = min(names, key=lambda s: (sum(n * (n - 2 * lack[s][c]) for c, n in g.parts.items()) / max(targets[s], 1e-9), s))
        placed[g.group] = best
        for c, n in g.parts.items():
            lack[best][c] -= n
    small = groups.filter(F.col("size") * LARGE < whole)
    h = F.pmod(F.xxhash64(F.lit(salt), "group"), F.lit(BUCKETS)).cast("int")
    weights: dict[int, dict[int, int]] = {}
    for r in small.groupBy("main", h.alias("h")).agg(F.sum("size").alias("n")).collect():
        weights.setdefault(r.main, {})[r.h] = r.n
    cuts = []
    for main, by in sorted(weights.items()):
        want = {s: max(0.0, lack[s].get(main, 0.0)) for s in names}
        total = sum(want.values())
        if total <= 0:
            want, total = {s: targets[s] for s in names}, share_sum
        scale, s, filled, start = sum(by.values()) / total, 0, 0.0, 0
        for b in sorted(by):
            while s < len(names) - 1 and filled + by[b] / 2 >= want[names[s]] * scale:
                cuts.append((main, names[s], start, b))
                filled, start, s = filled - want[names[s]] * scale, b, s + 1
            filled += by[b]
        cuts.append((main, names[s], start, BUCKETS))
    spark = members.sparkSession
    # At most one row for each of 512 strata and each split, and 2,000 groups.
    bounds = F.broadcast(spark.createDataFrame(cuts or [(-1, "", 0, 0)], "main int, new_split string, low int, high int"))
    first = F.broadcast(spark.createDataFrame(list(placed.items()) or [("", "")], "group string, new_split string"))
    rest = small.select("group", "main", h.alias("h")).join(bounds, "main").filter("h >= low and h < high").select("group", "new_split")
    return groups.filter(F.col("size") * LARGE >= whole).select("group").join(first, "group").unionByName(rest)


def grouped_splits(utterances: DataFrame, recordings: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``id, group, new_split`` of each utterance; utterances of one group share their split."""
    rows = materialise(utterance_groups(utterances, recordings), "grouped")
    ids = rows.groupBy("id").agg(F.min("group").alias("group"), F.min("source").alias("stratum"))
    assigned = assign_splits(ids.select("group", "stratum"), targets)
    return ids.join(assigned, "group").select("id", "group", "new_split")
