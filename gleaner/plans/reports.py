"""Composite reports and the operators left that they build on."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import guards, rows, sequence
from gleaner.operators import statistics as st
from gleaner.plans import selection
from gleaner.plans.registry import Registry
from gleaner.plans.runs import LOG, log
from gleaner.plans.selection import UTT, plain, utterances
from gleaner.session import table

query = Registry()


@query(
    selection.STUDY_SQL
    + """, g as (select media_key, count(*) as n, sha256('dev' || media_key) as h from study where split = 'train' and media_key is not null group by media_key), dr as (select media_key from (select *, sum(n) over (order by h, media_key rows unbounded preceding) - n as before from g) where before < 200),
 b as (select *, split = 'train' and media_key in (select media_key from dr) as moved, media_key in (select media_key from dr) as drawn from study), dev as (select distinct pr as key from b where drawn and length(pr) >= 15)
 select id, split as split0, case when moved then 'dev' else split end as split, case when reason = 'kept' and split = 'train' and not coalesce(moved, false) and (pr in (select key from dev) or ph in (select key from dev)) then 'dev_text' else reason end as reason from b"""
)
def rule05_full_cascade(spark, sf):
    """The staged cascade, then a dev slice of whole recordings taken from training.

    Masks use the split before the slice is drawn; rows that move keep their reason, and training rows
    whose text equals one of the slice are dropped.
    """
    base = selection.study_cascade(spark, sf).withColumn("split0", F.col("split"))
    groups = base.filter("split0 = 'train' and media_key is not null").groupBy("media_key").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit("dev"), "media_key"), 256))
    drawn = sequence.running_total(groups, ["h", "media_key"], "n").filter("upto - n < 200").select("media_key").withColumn("drawn", F.lit(True))
    base = base.join(drawn, "media_key", "left").withColumn("split", F.when(F.col("drawn") & (F.col("split0") == "train"), "dev").otherwise(F.col("split0")))
    dev = base.filter("drawn").select(plain(F.col("ref")).alias("key")).filter(F.length("key") >= 15).distinct()
    dup = base.filter("split = 'train'").select("id", F.explode(F.array_distinct(F.array(plain(F.col("ref")), plain(F.col("hyp"))))).alias("key"))
    dup = dup.join(dev, "key", "left_semi").select("id").distinct().withColumn("dev_dup", F.lit(True))
    return rows.staged(base.join(dup, "id", "left"), [("dev_text", (F.col("split") == "train") & F.col("dev_dup"))]).select("id", "split0", "split", "reason")


@query("""select 'unique ids' as name, case when count(*) = count(distinct id) then 'pass' else 'fail' end as state, cast(count(*) - count(distinct id) as varchar) as detail from utt_index
 union all select 'known splits', case when count(*) filter (split is null) = 0 then 'pass' else 'fail' end, cast(count(*) filter (split is null) as varchar) from utt_index
 union all select 'positive lengths', case when count(*) filter (not (duration > 0 and n_tok > 0)) = 0 then 'pass' else 'fail' end, cast(count(*) filter (not (duration > 0 and n_tok > 0)) as varchar) from utt_index
 union all select 'target shares', case when abs(sum(target_share) - 1) < 1e-9 then 'pass' else 'fail' end, '' from split_target""")
def r03_checks(spark, sf):
    """A list of checks with their state, all but one from one pass."""
    u = table(spark, sf, "utt_index", "id", "split", "duration", "n_tok")
    n = u.agg((F.count("*") - F.count_distinct("id")).alias("unique ids"), F.count_if(F.col("split").isNull()).alias("known splits"), F.count_if(~F.expr("duration > 0 and n_tok > 0")).alias("positive lengths"))
    out = n.unpivot([], ["unique ids", "known splits", "positive lengths"], "name", "bad").select("name", F.when(F.col("bad") == 0, "pass").otherwise("fail").alias("state"), F.col("bad").cast("string").alias("detail"))
    share = table(spark, sf, "split_target").agg(F.sum("target_share").alias("s"))
    return out.unionByName(share.select(F.lit("target shares").alias("name"), F.when(F.abs(F.col("s") - 1) < 1e-9, "pass").otherwise("fail").alias("state"), F.lit("").alias("detail")))


@query(f"""select run_key, step, split_part(tag, '/', -1) as series, value, case tag when 'train/loss' then 1 when 'eval/dev/kl' then 2 else 3 end as place from {LOG} where tag in ('train/loss', 'eval/dev/kl', 'eval/dev/top1') and value is not null""")
def r05_long_table(spark, sf):
    """Three tags as series of one long table."""
    df = log(spark, sf, "run_key", "step", "tag", "value").filter("tag in ('train/loss', 'eval/dev/kl', 'eval/dev/top1') and value is not null")
    place = F.when(F.col("tag") == "train/loss", 1).when(F.col("tag") == "eval/dev/kl", 2).otherwise(3)
    return df.select("run_key", "step", F.substring_index("tag", "/", -1).alias("series"), "value", place.alias("place"))


@query(f"""with s as (select in_greedy_subset as v, coalesce(length(ref), 0) as l, round(coalesce(teacher_cer, 0) * coalesce(length(ref), 0)) as e from {UTT} where split in ('dev', 'eval'))
 select round(sum(e) filter (v and l > 0) / sum(l) filter (v and l > 0), 6) as on_view, round(sum(e) filter (l > 0) / sum(l) filter (l > 0), 6) as on_all, round(100 * (sum(e) filter (v and l > 0) / sum(l) filter (v and l > 0) - sum(e) filter (l > 0) / sum(l) filter (l > 0)), 6) as gap from s""")
def r09_view_bias(spark, sf):
    """The rate on a view against the rate on all, in points."""
    u = utterances(spark, sf, "split", "in_greedy_subset", "ref", "teacher_cer").filter("split in ('dev', 'eval')")
    l = F.coalesce(F.length("ref"), F.lit(0))  # noqa: E741
    u = u.select(F.col("in_greedy_subset").alias("v"), l.alias("l"), F.round(F.coalesce(F.col("teacher_cer"), F.lit(0.0).cast("float")) * l).alias("e")).filter("l > 0")
    on = lambda c: F.sum(F.when(F.col("v"), F.col(c)))
    a, b = on("e") / on("l"), F.sum("e") / F.sum("l")
    return u.agg(F.round(a, 6).alias("on_view"), F.round(b, 6).alias("on_all"), F.round(100 * (a - b), 6).alias("gap"))


@query(f"""with s as (select source, sum(e) as e, sum(l) as l from (select source, coalesce(length(ref), 0) as l, round(coalesce(teacher_cer, 0) * coalesce(length(ref), 0)) as e from {UTT} where split = 'eval' and length(ref) > 0) group by source),
 m as (select * from (values ('macro', 'eval_crowd'), ('macro', 'eval_read'), ('macro', 'eval_tv'), ('pooled', 'eval_crowd'), ('pooled', 'eval_read'), ('pooled', 'eval_tv'), ('pooled', 'eval_web')) t(metric, source))
 select metric, case when count(s.source) < count(*) then null when metric = 'macro' then round(avg(e / l), 6) else round(sum(e) / sum(l), 6) end as value from m left join s using (source) group by metric""")
def a18_metric_families(spark, sf):
    """Macro and pooled metrics over lists of strata, from one table of definitions."""
    pairs = [("macro", s) for s in ("eval_crowd", "eval_read", "eval_tv")] + [("pooled", s) for s in ("eval_crowd", "eval_read", "eval_tv", "eval_web")]
    u = utterances(spark, sf, "source", "split", "ref", "teacher_cer").filter("split = 'eval' and length(ref) > 0")
    s = u.groupBy("source").agg(F.sum(F.round(F.coalesce(F.col("teacher_cer"), F.lit(0.0).cast("float")) * F.length("ref"))).alias("e"), F.sum(F.length("ref")).alias("l"), F.lit(True).alias("held"))
    m = spark.createDataFrame(pairs, "metric string, source string").join(s, "source", "left")
    value = F.when(F.count("held") < F.count("*"), None).when(F.col("metric") == "macro", F.round(F.avg(F.col("e") / F.col("l")), 6)).otherwise(F.round(F.sum("e") / F.sum("l"), 6))
    return m.groupBy("metric").agg(value.alias("value"))


@query(f"""with d as (select run_key, tag, value, row_number() over (partition by run_key order by step, tag) as k from {LOG} where value is not null)
 select run_key, round(sum(value) filter (tag = 'sys/io_wait' and k > 10) / nullif(sum(value) filter (tag = 'train/loss' and k > 10), 0), 6) as share from d group by run_key""")
def a25_steady_share(spark, sf):
    """A ratio of sums without the first ten rows of each run."""
    d = log(spark, sf, "run_key", "step", "tag", "value").filter("value is not null")
    d = rows.numbered(d, ["run_key"], [F.col("step"), F.col("tag")], "k").withColumn("value", F.when(F.col("k") > 10, F.col("value")))
    return d.groupBy("run_key").agg(st.ratio(F.sum(F.when(F.col("tag") == "sys/io_wait", F.col("value"))), F.sum(F.when(F.col("tag") == "train/loss", F.col("value")))).alias("share"))


@query("""with a as (select source, split, count(distinct id) as n, list_sort(list(distinct id)) as ids from selection where snap = 2 and split is not null group by 1, 2), b as (select source, split, count(distinct id) as n, list_sort(list(distinct id)) as ids from utt_index where split is not null group by 1, 2)
 select source, split, a.n as n_a, b.n as n_b, a.ids is not distinct from b.ids as complete from a full join b using (source, split)""")
def x04_content(spark, sf):
    """Whether an output holds the ids of its input, unit by unit."""
    a = table(spark, sf, "selection", "id", "source", "split", "snap").filter("snap = 2 and split is not null")
    b = table(spark, sf, "utt_index", "id", "source", "split").filter("split is not null")
    return guards.content_matches(a, b, ["source", "split"], "id")


@query("""with a as (select source, split, count(distinct id) as n from selection where snap = 1 and split is not null group by 1, 2), b as (select source, split, count(distinct id) as n from utt_index where split is not null group by 1, 2)
 select id from (select distinct id, source, split from utt_index where split is not null) semi join (select b.source, b.split from b left join a using (source, split) where a.n is null or a.n != b.n) using (source, split)""")
def x05_left_to_do(spark, sf):
    """Rows of the units whose finished output doesn't stand for them."""
    count = lambda df: df.groupBy("source", "split").agg(F.count_distinct("id").alias("n"))
    a = count(table(spark, sf, "selection", "id", "source", "split", "snap").filter("snap = 1 and split is not null")).withColumnRenamed("n", "done")
    u = table(spark, sf, "utt_index", "id", "source", "split").filter("split is not null").distinct()
    todo = count(u).join(a, ["source", "split"], "left").filter("done is null or done != n")
    return u.join(todo, ["source", "split"], "left_semi").select("id")


@query("select run_key, round((select max(wall) from run_scalar) - max(wall), 6) as age, (select max(wall) from run_scalar) - max(wall) > 600 as stalled from run_scalar where run_key is not null group by run_key")
def x11_age(spark, sf):
    """X11: seconds since the last sign of each run, and whether it has stalled."""
    df = table(spark, sf, "run_scalar", "run_key", "wall")
    age = F.col("now") - F.col("last")
    return df.filter("run_key is not null").groupBy("run_key").agg(F.max("wall").alias("last")).crossJoin(df.agg(F.max("wall").alias("now"))).select("run_key", F.round(age, 6).alias("age"), (age > 600).alias("stalled"))


@query("select user_id, arg_max(event_type, event_id) as status, count(*) as n_events from events group by user_id")
def x15_status(spark, sf):
    """The status of an item from its last event."""
    return table(spark, sf, "events", "user_id", "event_type", "event_id").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("n_events"))


@query("""with m as (select distinct source, path from shard_manifest), o as (select source, path, row_number() over (partition by source order by path) as ordinal from m)
 select source, string_agg(ordinal || ':' || path, ',' order by ordinal) as inputs from o group by source""")
def g02_extent(spark, sf):
    """The sorted inputs of each source with their ordinals, nested in one row."""
    o = rows.numbered(table(spark, sf, "shard_manifest", "source", "path").distinct(), ["source"], [F.col("path")], "ordinal")
    inputs = F.array_sort(F.collect_list(F.struct("ordinal", "path")))
    return o.groupBy("source").agg(F.array_join(F.transform(inputs, lambda x: F.concat(x.ordinal.cast("string"), F.lit(":"), x.path)), ",").alias("inputs"))


@query("select vec_id, list_concat(list_slice(embedding, 1, 8), list_slice(embedding, 57, 64)) as joined from embeddings")
def w30_cut_and_join(spark, sf):
    """Slices of a sequence cut out and joined."""
    return table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.concat(F.slice("embedding", 1, 8), F.slice("embedding", 57, 8)).alias("joined"))


@query(f"""select id, cast(pos as integer) as pos from (select id, duration, unnest(range(1, length(hyp) + 1)) as pos, hyp from {UTT} where length(hyp) > 1) where pos > 1 and pos > 0.5 * length(hyp) and not regexp_matches(substr(hyp, pos, 1), '[、。・！？「」 ]') and regexp_matches(substr(hyp, pos - 1, 1), '[、。・！？「」 ]')""")
def w06_cut_places(spark, sf):
    """Places in the second half of a text where a word begins after a mark."""
    u = utterances(spark, sf, "id", "hyp").filter("length(hyp) > 1").select("id", F.filter(F.split("hyp", ""), lambda c: c != "").alias("c"))
    u = u.select("id", F.size("c").alias("n"), F.posexplode("c").alias("p", "ch"), "c")
    marks = "[、。・！？「」 ]"
    before = F.get("c", F.col("p") - 1)
    return u.filter((F.col("p") > 0) & (F.col("p") + 1 > 0.5 * F.col("n")) & ~F.col("ch").rlike(marks) & before.rlike(marks)).select("id", (F.col("p") + 1).alias("pos"))


QUERIES, SQL = query.queries, query.sql
