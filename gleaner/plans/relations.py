"""Joins and set operations between snapshots, verdicts, manifests and recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import relations as rel
from gleaner.operators import rows, sequence
from gleaner.plans.registry import Registry
from gleaner.plans.selection import JUDGED, UTT, judged, utterances
from gleaner.session import table

query = Registry()

SNAP = "(select * exclude (rn) from (select *, row_number() over (partition by snap, id order by keep desc nulls last, reason, agree, n_tok, duration) rn from selection) where rn = 1)"


def snapshot(spark, sf, number, *columns):
    df = table(spark, sf, "selection").filter(F.col("snap") == number)
    order = [~F.coalesce("keep", F.lit(False)), F.coalesce("reason", F.lit("￿")), F.coalesce("agree", F.lit(9.0).cast("float")), F.col("n_tok"), F.col("duration")]
    return rows.first_rows(df, ["snap", "id"], order).select(*columns)


@query("select distinct media_key from recording where media_key is not null and media_key not in (select media_key from utt_index where media_key is not null)")
def j03_anti(spark, sf):
    """Recordings without utterances."""
    return table(spark, sf, "recording", "media_key").filter("media_key is not null").distinct().join(table(spark, sf, "utt_index", "media_key"), "media_key", "left_anti")


@query(f"""with a as (select id, split from {SNAP} where snap = 1), b as (select id, split from {SNAP} where snap = 2)
 select count(*) as n, count(*) filter (b.id is null) as only_a, count(*) filter (a.id is null) as only_b, count(*) filter (a.id is not null and b.id is not null and a.split is distinct from b.split) as moved from a full join b using (id)""")
def j04_alignment(spark, sf):
    """Two snapshots aligned by id, what only one holds, what changed."""
    both = rel.aligned(snapshot(spark, sf, 1, "id", "split"), snapshot(spark, sf, 2, "id", "split"), ["id"])
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"), F.count_if(F.expr("in_a and in_b and not (split <=> split_b)")).alias("moved"))


@query(f"select id, coalesce(hyp, '') as hyp, coalesce(ref, '') as ref from {UTT} where source in ('eval_tv', 'eval_web')")
def j05_text_lookup(spark, sf):
    """Texts of some sets, null as the empty text."""
    df = utterances(spark, sf, "id", "source", "hyp", "ref").filter("source in ('eval_tv', 'eval_web')")
    return df.select("id", F.coalesce("hyp", F.lit("")).alias("hyp"), F.coalesce("ref", F.lit("")).alias("ref"))


@query(f"""with u as (select id, source, split_part(id, '/', 2) as key from {UTT}) select id from u where source = 'tv_large' and key not in (select key from u where source = 'tv_small')""")
def j08_nested_tiers(spark, sf):
    """Rows of the larger tier that the smaller one doesn't hold."""
    u = utterances(spark, sf, "id", "source").withColumn("key", F.split_part("id", F.lit("/"), F.lit(2)))
    small = u.filter("source = 'tv_small'").select("key")
    return u.filter("source = 'tv_large'").join(small, "key", "left_anti").select("id")


@query(f"""select id, media_key from {UTT} where split = 'train' and media_key is not null and media_key not in (select media_key from {UTT} where split = 'eval' and media_key is not null)""")
def j09_group_disjoint(spark, sf):
    """Training rows of recordings that the evaluation doesn't use."""
    u = utterances(spark, sf, "id", "split", "media_key").filter("media_key is not null")
    return u.filter("split = 'train'").join(u.filter("split = 'eval'").select("media_key"), "media_key", "left_anti").select("id", "media_key")


@query(f"""select id, coalesce(hyp2, hyp) as text, case when hyp2 is not null then 'judge' when hyp is not null then 'first' end as origin from {UTT} left join {JUDGED} using (id)""")
def j10_fallback(spark, sf):
    """The second text, else the first, and which it was."""
    u = utterances(spark, sf, "id", "hyp").join(judged(spark, sf, "id", "hyp2"), "id", "left")
    return rel.with_fallback(u, [("judge", F.col("hyp2")), ("first", F.col("hyp"))], "text", "origin").select("id", "text", "origin")


@query(f"""select source, split, count(*) as n, count(*) filter (hyp2 is null) as n_fallback from {UTT} left join {JUDGED} using (id) where split is not null group by 1, 2 having count(*) filter (hyp2 is null) > 20 and count(*) filter (hyp2 is null) > 0.2 * count(*)""")
def j11_fallback_guard(spark, sf):
    """Shards where more than 20 rows and 20 % fall back."""
    u = utterances(spark, sf, "id", "source", "split").filter("split is not null").join(judged(spark, sf, "id", "hyp2"), "id", "left")
    return u.groupBy("source", "split").agg(F.count("*").alias("n"), F.count_if(F.col("hyp2").isNull()).alias("n_fallback")).filter("n_fallback > 20 and n_fallback > 0.2 * n")


@query("select id, count(distinct n_tok) as n_lengths from (select id, n_tok from selection union all select id, n_tok from trained_utt union all select id, n_tok from utt_index) group by id having count(distinct n_tok) > 1")
def j14_length_consistency(spark, sf):
    """Ids whose length differs between tables."""
    parts = [table(spark, sf, t, "id", "n_tok") for t in ("selection", "trained_utt", "utt_index")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("id").agg(F.count_distinct("n_tok").alias("n_lengths")).filter("n_lengths > 1")


@query(f"""with c as (select id, list(step order by step, epoch) as steps from (select distinct id, step, epoch from trained_utt where id is not null) group by id)
 select id, coalesce(cast(steps[1] as bigint), -1) as first_step, coalesce(cast(len(steps) as integer), 0) as n_steps from {UTT} left join c using (id)""")
def j15_gather_lists(spark, sf):
    """List columns gathered by id, -1 where there are none."""
    steps = table(spark, sf, "trained_utt", "id", "step", "epoch").filter("id is not null").distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "epoch"))).alias("steps"))
    u = utterances(spark, sf, "id").join(steps, "id", "left")
    return u.select("id", F.coalesce(F.get("steps", F.lit(0)).step, F.lit(-1).cast("bigint")).alias("first_step"), F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps")).withColumn("n_steps", F.greatest("n_steps", F.lit(0)))


@query("""with p as (select event_id, event_id * 7919 % (select max(audio_off + audio_len) from utt_index) as x from events)
 select event_id, row_no, x - audio_off as inside from p join utt_index on x >= audio_off and x < audio_off + audio_len""")
def j18_interval_join(spark, sf):
    """Points joined to the interval that holds them, by buckets."""
    spans = table(spark, sf, "utt_index", "row_no", "audio_off", "audio_len").withColumn("end", F.col("audio_off") + F.col("audio_len"))
    points = table(spark, sf, "events", "event_id").crossJoin(spans.agg(F.max("end").alias("most"))).select("event_id", (F.col("event_id") * 7919 % F.col("most")).alias("x"))
    return sequence.within(points, spans, [], "x", "audio_off", "end", 1 << 20).select("event_id", "row_no", (F.col("x") - F.col("audio_off")).alias("inside"))


@query("select source, cast(sum(n_tok) as bigint) as n_positions, cast(sum(case when (tok_off + n_tok - 1) // 100 >= (tok_off + 99) // 100 then (tok_off + n_tok - 1) // 100 - (tok_off + 99) // 100 + 1 else 0 end) as bigint) as n_marks from utt_index where n_tok > 0 group by source")
def j19_interval_expansion(spark, sf):
    """Intervals expanded to the blocks of 100 positions they touch, and the positions in each block counted."""
    df = table(spark, sf, "utt_index", "source", "tok_off", "n_tok").filter("n_tok > 0").withColumn("end", F.col("tok_off") + F.col("n_tok"))
    each = df.select("source", "tok_off", "end", F.explode(F.sequence(F.expr("tok_off div 100"), F.expr("(end - 1) div 100"))).alias("block"))
    low, high = F.greatest("tok_off", F.col("block") * 100), F.least("end", F.col("block") * 100 + 100)
    return each.groupBy("source").agg(F.sum(high - low).alias("n_positions"), F.sum((low == F.col("block") * 100).cast("bigint")).alias("n_marks"))


@query("""with l as (select run_key, min(wall) as began, max(wall) as ended from run_scalar where run_key is not null group by run_key), t as (select distinct cast(wall as bigint) as w from run_scalar)
 select w, max(run_key) filter (n = 1) as run_key, max(n) > 1 as ambiguous from (select w, run_key, count(*) over (partition by w) as n from t join l on w + 1 >= began and w <= ended) group by w""")
def j20_valid_time(spark, sf):
    """A time attributed to the run under way then, unless several were."""
    df = table(spark, sf, "run_scalar", "run_key", "wall")
    runs = df.filter("run_key is not null").groupBy("run_key").agg(F.min("wall").alias("began"), F.max("wall").alias("ended"))
    runs = runs.select("run_key", "began", "ended", F.floor(F.col("began") - 1).alias("low"), (F.floor("ended") + 1).alias("high"))
    times = df.select(F.col("wall").cast("decimal(20,6)").cast("double").alias("x")).select(F.round("x").cast("bigint").alias("w")).distinct()
    hit = sequence.within(times, runs, [], "w", "low", "high", 3600).filter("w + 1 >= began and w <= ended")
    out = hit.groupBy("w").agg(F.count("*").alias("n"), F.max("run_key").alias("run_key"))
    return out.select("w", F.when(F.col("n") == 1, F.col("run_key")).alias("run_key"), (F.col("n") > 1).alias("ambiguous"))


@query(f"select a.id from {SNAP} a where a.snap = 1 and a.keep and not exists (select 1 from {SNAP} b where b.snap = 2 and b.id = a.id and b.keep)")
def j21_twin(spark, sf):
    """Rows of one snapshot without their twin in the other."""
    return snapshot(spark, sf, 1, "id", "keep").filter("keep").join(snapshot(spark, sf, 2, "id", "keep").filter("keep"), "id", "left_anti").select("id")


@query("""with p as (select a.run_key, a.step, a.value as kl, b.value as top1, row_number() over (partition by a.run_key order by a.step desc, a.value desc, b.value desc) rn from run_scalar a join run_scalar b on a.run_key = b.run_key and a.step = b.step where a.tag = 'eval/dev/kl' and b.tag = 'eval/dev/top1' and a.value is not null and b.value is not null)
 select run_key, step, kl, top1 from p where rn = 1""")
def j22_pair_join(spark, sf):
    """The newest step of each run that holds both of a pair."""
    df = table(spark, sf, "run_scalar", "run_key", "step", "tag", "value").filter("value is not null")
    a = df.filter("tag = 'eval/dev/kl'").select("run_key", "step", F.col("value").alias("kl"))
    b = df.filter("tag = 'eval/dev/top1'").select("run_key", "step", F.col("value").alias("top1"))
    return rows.last_rows(a.join(b, ["run_key", "step"]).select("run_key", "step", "kl", "top1"), ["run_key"], [F.col("step"), F.col("kl"), F.col("top1")])


DIFF = "select '{c}' as column, count(*) as n, count(*) filter (a.{c} is distinct from b.{c}) as n_differ, {g} as max_gap from a join b using (id)"


@query(
    f"with a as (select * from {SNAP} where snap = 1), b as (select * from {SNAP} where snap = 2) "
    + " union all ".join(DIFF.format(c=c, g=f"round(max(abs(cast(a.{c} as double) - cast(b.{c} as double))), 6)" if c in ("agree", "n_tok") else "cast(null as double)") for c in ("agree", "n_tok", "reason", "split"))
)
def j23_diff(spark, sf):
    """Two snapshots column by column, null equal to null."""
    cols = ["agree", "n_tok", "reason", "split"]
    return rel.differences(snapshot(spark, sf, 1, "id", *cols), snapshot(spark, sf, 2, "id", *cols), ["id"], cols)


@query(f"select source, round(avg(cast(u.agree as double) - cast(j.agree as double)), 6) as gap, count(*) as n from {UTT} u join {JUDGED} j using (id) where u.agree is not null and j.agree is not null group by source")
def j24_golden(spark, sf):
    """Two judgements compared over the ids both hold."""
    u = utterances(spark, sf, "id", "source", "agree").join(judged(spark, sf, "id", F.col("agree").alias("b")), "id").filter("agree is not null and b is not null")
    return u.groupBy("source").agg(F.round(F.avg(F.col("agree").cast("double") - F.col("b").cast("double")), 6).alias("gap"), F.count("*").alias("n"))


@query("""with m as (select distinct path, source, split from shard_manifest), s as (select source, split_part(split_part(path, '/', -1), '.', 1) as stem, row_number() over (partition by source order by path) as ordinal from m where split = 'train')
 select distinct id, teacher_file from selection join s on s.source = selection.source and s.stem = split_part(teacher_file, '/', -1) where ordinal <= 2""")
def j25_stem_subset(spark, sf):
    """Rows of the first two stems of each source."""
    m = table(spark, sf, "shard_manifest", "path", "source", "split").distinct().filter("split = 'train'")
    s = rows.numbered(m, ["source"], [F.col("path")], "ordinal").filter("ordinal <= 2")
    s = s.select("source", F.split_part(F.substring_index("path", "/", -1), F.lit("."), F.lit(1)).alias("stem"))
    df = table(spark, sf, "selection", "id", "source", "teacher_file").withColumn("stem", F.substring_index("teacher_file", "/", -1))
    return df.join(s, ["source", "stem"], "left_semi").select("id", "teacher_file").distinct()


@query("select id, 'index' as origin from utt_index where split = 'dev' union all select id, 'selection' from selection where split = 'dev' and snap = 2")
def o01_union_all(spark, sf):
    """Frames one after the other, with their origin."""
    a = table(spark, sf, "utt_index", "id", "split").filter("split = 'dev'").select("id", F.lit("index").alias("origin"))
    b = table(spark, sf, "selection", "id", "split", "snap").filter("split = 'dev' and snap = 2").select("id", F.lit("selection").alias("origin"))
    return a.unionByName(b)


@query("""select id, 'withdrawn' as kind from (select id from selection except select id from utt_index) union all select id, 'new' from (select id from utt_index except select id from selection)""")
def o02_difference(spark, sf):
    """What each of two sets lacks."""
    a, b = table(spark, sf, "selection", "id").distinct(), table(spark, sf, "utt_index", "id").distinct()
    gone, new = a.join(b, "id", "left_anti"), b.join(a, "id", "left_anti")
    return gone.select("id", F.lit("withdrawn").alias("kind")).unionByName(new.select("id", F.lit("new").alias("kind")))


@query("select count(*) as n_both from (select id from utt_index where split = 'dev' intersect select id from trained_utt)")
def o03_intersection(spark, sf):
    """Held-out ids that were trained on."""
    dev = table(spark, sf, "utt_index", "id", "split").filter("split = 'dev'").select("id")
    return dev.intersect(table(spark, sf, "trained_utt", "id")).agg(F.count("*").alias("n_both"))


@query(f"""with a as (select row_number() over (order by id) as pos, id from {SNAP} where snap = 1 and split = 'eval'), b as (select row_number() over (order by id) as pos, id from {SNAP} where snap = 2 and split = 'eval')
 select count(*) as n, count(*) filter (a.id is distinct from b.id) = 0 as equal, min(pos) filter (a.id is distinct from b.id) as first_difference from a full join b using (pos)""")
def o04_list_equality(spark, sf):
    """Whether the evaluation lists of two snapshots are equal, and where they first differ."""

    def listed(n):
        ids = sequence.running_total(snapshot(spark, sf, n, "id", "split").filter("split = 'eval'").select("id", F.lit(1).alias("one")), ["id"], "one", "pos")
        return ids.select(F.col("pos").cast("bigint").alias("pos"), "id")

    return rel.first_difference(listed(1), listed(2), "pos", "id")


@query("select count(*) as n_outside from (select distinct id from utt_index where in_probe) where id not in (select id from selection where keep)")
def o05_subset(spark, sf):
    """Members of a view outside its set."""
    view = table(spark, sf, "utt_index", "id", "in_probe").filter("in_probe").select("id").distinct()
    return view.join(table(spark, sf, "selection", "id", "keep").filter("keep"), "id", "left_anti").agg(F.count("*").alias("n_outside"))


@query("select media_key, min(row_no) as first_row from utt_index where media_key is not null group by media_key")
def o06_ordered_distinct(spark, sf):
    """Distinct values by first appearance."""
    return table(spark, sf, "utt_index", "media_key", "row_no").filter("media_key is not null").groupBy("media_key").agg(F.min("row_no").alias("first_row"))


@query("""with recursive e as (select distinct media_key as node, reupload_of as needs from recording where media_key is not null and reupload_of is not null), r(node) as (select distinct reupload_of from recording where reupload_of is not null union select node from e union select e.needs from e join r on e.node = r.node) select node from r""")
def o07_closure(spark, sf):
    """Everything reached from the re-uploads along their parents."""
    edges = table(spark, sf, "recording", "media_key", "reupload_of").na.drop().select(F.col("media_key").alias("node"), F.col("reupload_of").alias("needs")).distinct()
    return rel.closure(edges, edges.select("node"))


@query("""with a as (select source, max(cast(regexp_extract(teacher_file, '([0-9]+)$', 1) as integer)) as reach from selection where snap = 1 group by source), b as (select source, max(cast(regexp_extract(teacher_file, '([0-9]+)$', 1) as integer)) as reach from selection where snap = 2 group by source)
 select source, coalesce(a.reach, -1) as inner_reach, coalesce(b.reach, -1) as outer_reach, coalesce(a.reach, -1) <= coalesce(b.reach, -1) as within from a full join b using (source)""")
def o08_containment(spark, sf):
    """Whether one extent reaches as far as another, source by source."""
    df = table(spark, sf, "selection", "snap", "source", "teacher_file")
    number = F.regexp_extract("teacher_file", "([0-9]+)$", 1).cast("int")
    reach = lambda n, name: df.filter(F.col("snap") == n).groupBy("source").agg(F.max(number).alias(name))
    both = reach(1, "inner_reach").join(reach(2, "outer_reach"), "source", "full").na.fill(-1)
    return both.withColumn("within", F.col("inner_reach") <= F.col("outer_reach"))


@query("""with m as (select path, n_rows, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest), t as (select teacher_file || '.parquet' as path, count(distinct id) as n from selection where snap = 2 group by 1)
 select path, case when t.path is null then 'missing' when m.path is null then 'unlisted' when t.n != m.n_rows then 'rows differ' else 'same' end as state from (select * from m where rn = 1) m full join t using (path)""")
def o10_reconcile(spark, sf):
    """A manifest against what is there."""
    m = rows.first_rows(table(spark, sf, "shard_manifest", "path", "n_rows", "n_hours"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")]).select("path", "n_rows")
    t = table(spark, sf, "selection", "snap", "teacher_file", "id").filter("snap = 2").groupBy(F.concat("teacher_file", F.lit(".parquet")).alias("path")).agg(F.count_distinct("id").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n_rows").isNull(), "unlisted").when(F.col("n") != F.col("n_rows"), "rows differ").otherwise("same")
    return m.join(t, "path", "full").select("path", state.alias("state"))


QUERIES, SQL = query.queries, query.sql
