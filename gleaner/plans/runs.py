"""Run logs and ordered data: windows, islands, as-of joins, restarts, draws and folds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import rows, sequence
from gleaner.plans.registry import Registry
from gleaner.plans.selection import JUDGED, STEM, UTT, judged, stem, utterances
from gleaner.session import table

query = Registry()

LOG = "(select * exclude (rn) from (select *, row_number() over (partition by run_key, tag, step order by wall desc, elapsed_s desc, coalesce(value, 0) desc, coalesce(nf, '') desc) rn from run_scalar where run_key is not null and tag is not null and step is not null) where rn = 1)"


def log(spark, sf, *columns):
    """The last write of each (run, tag, step)."""
    df = table(spark, sf, "run_scalar").na.drop(subset=["run_key", "tag", "step"])
    df = rows.last_rows(df, ["run_key", "tag", "step"], [F.col("wall"), F.col("elapsed_s"), F.coalesce("value", F.lit(0.0)), F.coalesce("nf", F.lit(""))])
    return df.select(*columns)


@query(f"select run_key, tag, step, value, nf from {LOG}")
def x01_last_value(spark, sf):
    """X01 in batch form: the last value of each step and tag wins."""
    return log(spark, sf, "run_key", "tag", "step", "value", "nf")


@query(f"select id, agree, cer2 from {JUDGED}")
def j01_last_verdict(spark, sf):
    """Later verdicts overwrite earlier ones."""
    return judged(spark, sf, "id", "agree", "cer2")


@query(f"select id, row_no, ref from {UTT}")
def j12_first_copy(spark, sf):
    """The payload of the first copy of an id."""
    return utterances(spark, sf, "id", "row_no", "ref")


# A number that doesn't fit the run key's text order isn't needed: runs sort by key.
@query(f"select run_key, tag, step, round(avg(value) over w, 6) as mean3 from {LOG} window w as (partition by run_key, tag order by step rows 2 preceding) qualify count(*) over w = 3 and count(value) over w = 3")
def w14_moving_mean(spark, sf):
    """Mean of the last three, none where one is missing."""
    w = W.partitionBy("run_key", "tag").orderBy("step").rowsBetween(-2, 0)
    df = log(spark, sf, "run_key", "tag", "step", "value").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("m", F.count("value").over(w)).withColumn("mean3", F.round(F.avg("value").over(w), 6))
    return df.filter("n = 3 and m = 3").select("run_key", "tag", "step", "mean3")


@query(f"select run_key, tag, step, value from {LOG} qualify row_number() over (partition by run_key, tag order by step desc) <= greatest(3, ceil(0.2 * count(*) over (partition by run_key, tag)))")
def w16_tail(spark, sf):
    """The last max(3, a fifth) rows."""
    w = W.partitionBy("run_key", "tag")
    df = log(spark, sf, "run_key", "tag", "step", "value").withColumn("rn", F.row_number().over(w.orderBy(F.desc("step")))).withColumn("n", F.count("*").over(w))
    return df.filter("rn <= greatest(3, ceil(n * 0.2D))").select("run_key", "tag", "step", "value")


@query(f"""with t as (select * from {LOG} where value is not null qualify row_number() over (partition by run_key, tag order by step desc) <= 20)
 select run_key, tag, case when count(distinct step) > 1 then round(regr_slope(value, step) * (max(step) - min(step)) / avg(abs(value)), 6) end as change from t group by 1, 2""")
def a21_trend(spark, sf):
    """Least-squares change over the last 20 points, relative to their mean."""
    df = log(spark, sf, "run_key", "tag", "step", "value").filter("value is not null").withColumn("rn", F.row_number().over(W.partitionBy("run_key", "tag").orderBy(F.desc("step")))).filter("rn <= 20")
    change = F.regr_slope("value", F.col("step").cast("double")) * (F.max("step") - F.min("step")) / F.avg(F.abs("value"))
    return df.groupBy("run_key", "tag").agg(F.when(F.countDistinct("step") > 1, F.round(change, 6)).alias("change"))


@query(f"""select run_key, arg_max(value, step) filter (tag = 'train/lr') as last_lr, arg_max(value, step) filter (tag = 'train/lr' and step <= 20) as early_lr from {LOG} where value is not null group by run_key""")
def w17_before_phase(spark, sf):
    """The last record against the last one of an earlier phase."""
    df = log(spark, sf, "run_key", "tag", "step", "value").filter("value is not null and tag = 'train/lr'")
    runs = table(spark, sf, "run_scalar", "run_key", "value").filter("run_key is not null and value is not null").select("run_key").distinct()
    early = F.when(F.col("step") <= 20, F.col("step"))
    got = df.groupBy("run_key").agg(F.max_by("value", "step").alias("last_lr"), F.max_by("value", early).alias("early_lr"))
    return runs.join(got, "run_key", "left")


@query(f"""with l as (select *, lag(step) over (partition by run_key order by wall, step, tag, elapsed_s) as before from run_scalar where run_key is not null),
 r as (select run_key, row_number() over (partition by run_key order by wall, step, tag) as attempt, step as restored, wall as at from l where step < before)
 select s.run_key, s.tag, s.step, s.wall, s.elapsed_s, exists (select 1 from r where r.run_key = s.run_key and s.wall < r.at and s.step >= r.restored) as superseded from run_scalar s where s.run_key is not null""")
def w20_superseded(spark, sf):
    """Rows a later resume wrote again are flagged, not dropped.

    A resume shows as a step below the one before in wall order. A row is superseded if some later
    row of its run has a step no greater, which one running minimum from the end tells.
    """
    df = table(spark, sf, "run_scalar", "run_key", "tag", "step", "wall", "elapsed_s").filter("run_key is not null")
    back = F.lag("step").over(W.partitionBy("run_key").orderBy("wall", "step", "tag", "elapsed_s"))
    df = df.withColumn("restored", F.when(F.col("step") < back, F.col("step")))
    # Descending microseconds, so that "later" is a range that ends one before the row.
    df = df.withColumn("us", -F.round(F.col("wall") * 1e6).cast("bigint"))
    least = F.min("restored").over(W.partitionBy("run_key").orderBy("us").rangeBetween(W.unboundedPreceding, -1))
    return df.withColumn("superseded", F.coalesce(F.col("step") >= least, F.lit(False))).drop("restored", "us")


@query(f"""with l as (select *, lag(step) over (partition by run_key order by wall, step, tag, elapsed_s) as before from run_scalar where run_key is not null)
 select run_key, tag, step, wall, elapsed_s, cast(1 + sum(case when step < before then 1 else 0 end) over (partition by run_key order by wall, step, tag, elapsed_s rows unbounded preceding) as bigint) as attempt from l""")
def w21_attempts(spark, sf):
    """Rows numbered by the attempt that wrote them."""
    w = W.partitionBy("run_key").orderBy("wall", "step", "tag", "elapsed_s")
    df = table(spark, sf, "run_scalar", "run_key", "tag", "step", "wall", "elapsed_s").filter("run_key is not null")
    df = df.withColumn("back", F.when(F.col("step") < F.lag("step").over(w), 1).otherwise(0))
    return df.withColumn("attempt", (1 + F.sum("back").over(w.rowsBetween(W.unboundedPreceding, 0))).cast("bigint")).drop("back")


@query(f"""with e as (select run_key, step, tag, value, last_value(case when tag = 'train/lr' then value end ignore nulls) over (partition by run_key order by step, tag rows between unbounded preceding and 1 preceding) as lr from {LOG})
 select run_key, step, tag, value, lr from e where tag like 'eval/%'""")
def j16_as_of_backward(spark, sf):
    """Each evaluation with the learning rate last logged before it."""
    df = log(spark, sf, "run_key", "step", "tag", "value")
    out = sequence.last_before(df, ["run_key"], ["step", "tag"], F.col("tag") == "train/lr", F.col("value"), "lr")
    return out.filter(F.col("tag").startswith("eval/"))


@query(f"""with e as (select run_key, step, tag, first_value(case when tag like 'eval/%' then step end ignore nulls) over (partition by run_key order by step, tag rows between current row and unbounded following) as next_eval from {LOG})
 select run_key, step, tag, next_eval from e where tag = 'train/loss'""")
def j17_as_of_forward(spark, sf):
    """Each training row with the step of the first evaluation from there on."""
    df = log(spark, sf, "run_key", "step", "tag")
    return sequence.first_from(df, ["run_key"], ["step", "tag"], F.col("tag").startswith("eval/"), F.col("step"), "next_eval").filter("tag = 'train/loss'")


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events)
 select user_id, event_type, count(*) as n, min(event_id) as first, max(event_id) as last from e group by user_id, event_type, g""")
def w04_runs(spark, sf):
    """Start, end and length of each run of equal event types."""
    return sequence.runs(table(spark, sf, "events", "user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").drop("island")


@query("""select user_id, event_id, cast(coalesce(sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as clicks_before from events""")
def w07_exclusive_count(spark, sf):
    """How many clicks a user made before each event."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    clicks = F.coalesce(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w), F.lit(0))
    return table(spark, sf, "events", "user_id", "event_id", "event_type").select("user_id", "event_id", clicks.cast("bigint").alias("clicks_before"))


@query(f"select source, id, cast(coalesce(sum(n_tok) over (partition by source order by row_no rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from {UTT}")
def w08_offsets(spark, sf):
    """Running offsets with a leading 0."""
    upto = sequence.running_total(utterances(spark, sf, "source", "id", "row_no", "n_tok"), ["row_no"], "n_tok", keys=["source"])
    return upto.select("source", "id", (F.col("upto") - F.col("n_tok")).cast("bigint").alias("offset_"))


@query("""select row_no, id from (select row_no, id, audio_off, coalesce(lag(audio_off + audio_len) over (order by row_no), 0) as want from utt_index) where audio_off != want""")
def w29_offset_identity(spark, sf):
    """Rows whose stored offset isn't the end of the row before.

    The end of the row before comes by an equi-join on the row number where rows are dense, so no
    single-task window is needed.
    """
    df = table(spark, sf, "utt_index", "row_no", "id", "audio_off", "audio_len")
    before = df.select((F.col("row_no") + 1).alias("row_no"), (F.col("audio_off") + F.col("audio_len")).alias("want"))
    return df.join(before, "row_no", "left").filter(F.col("audio_off") != F.coalesce("want", F.lit(0))).select("row_no", "id")


@query("""select id, array_to_string(list_filter(list_filter(string_split(hyp, ''), lambda x, i: i = 1 or x != string_split(hyp, '')[i - 1]), lambda x: x != 'ー'), '') as collapsed from utt_index where hyp is not null and length(hyp) > 0""")
def w01_collapse(spark, sf):
    """Repeats dropped, then blanks, over the characters of a hypothesis."""
    df = table(spark, sf, "utt_index", "id", "hyp").filter(F.length("hyp") > 0)
    return df.select("id", F.array_join(sequence.collapsed(F.filter(F.split("hyp", ""), lambda c: c != ""), "ー"), "").alias("collapsed"))


@query("""with s as (select id, n_tok, string_split(hyp, '') as c from utt_index where length(hyp) > 0) select id, cast(len(c) + len(list_filter(c, lambda x, i: i > 1 and x = c[i - 1])) as integer) as needed from s where len(c) + len(list_filter(c, lambda x, i: i > 1 and x = c[i - 1])) > n_tok""")
def w03_frames_needed(spark, sf):
    """Rows that need more frames than they have tokens."""
    df = table(spark, sf, "utt_index", "id", "hyp", "n_tok").filter(F.length("hyp") > 0)
    chars = F.filter(F.split("hyp", ""), lambda c: c != "")
    return df.select("id", "n_tok", sequence.frames_needed(chars).alias("needed")).filter("needed > n_tok").drop("n_tok")


@query("""select event_id, list_transform(range(0, 8), lambda t: case when t = event_id % 8 then cast(user_id as bigint) else cast(-1 as bigint) end) as filled from events""")
def w02_dense_fill(spark, sf):
    """A sparse entry spread over a dense row of blanks."""
    df = table(spark, sf, "events", "event_id", "user_id")
    place = F.array((F.col("event_id") % 8).cast("int"))
    return df.select("event_id", sequence.dense(F.lit(8), place, F.array("user_id"), -1).alias("filled"))


@query("""with t as (select id, list_reverse(string_split(hyp, ''))[1:12] as tail from utt_index where length(hyp) >= 12)
 select id from t where list_contains(list_transform(range(1, 5), lambda p: tail[p + 1:12] = tail[1:12 - p]), true)""")
def w27_periodic_tail(spark, sf):
    """Hypotheses whose last 24 characters repeat with a period of 12 or less."""
    df = table(spark, sf, "utt_index", "id", "hyp").filter(F.length("hyp") >= 24)
    tail = F.slice(F.reverse(F.filter(F.split("hyp", ""), lambda c: c != "")), 1, 24)
    return df.filter(F.exists(F.sequence(F.lit(1), F.lit(12)), lambda p: F.slice(tail, p + 1, 24 - p) == F.slice(tail, F.lit(1), 24 - p))).select("id")


@query("""with a as (select path, row_number() over (order by path) as pos from (select distinct path from shard_manifest)), s as (select path, source from (select distinct path, source from shard_manifest) where source != 'pod_nc'),
 j as (select s.path, a.pos, lag(a.pos) over (order by s.path) as before from s left join a using (path)) select count(*) as n, bool_and(pos is not null and (before is null or pos > before)) as is_subsequence from j""")
def w28_subsequence(spark, sf):
    """One list is another with items left out, in order; the lists are the paths of a manifest."""
    paths = table(spark, sf, "shard_manifest", "path", "source").distinct()
    count = lambda df, name: sequence.running_total(df.select("path", F.lit(1).alias("one")), ["path"], "one", name).drop("one")
    part = count(paths.filter("source != 'pod_nc'"), "k").join(count(paths.select("path").distinct(), "pos"), "path", "left")
    before = part.select((F.col("k") + 1).alias("k"), F.col("pos").alias("before"))
    part = part.join(before, "k", "left")
    return part.agg(F.count("*").alias("n"), F.bool_and(F.expr("pos is not null and (before is null or pos > before)")).alias("is_subsequence"))


@query(f"""with m as (select *, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest) select path, source, split, n_rows, n_hours from m where rn = 1""")
def s06_manifest(spark, sf):
    """One line for each path; a complete one wins over a torn one."""
    return rows.first_rows(table(spark, sf, "shard_manifest"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")]).select("path", "source", "split", "n_rows", "n_hours")


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def w18_newest(spark, sf):
    """The newest row of each key."""
    return rows.last_rows(table(spark, sf, "events", "user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])


@query("select media_key, source, channel, reupload_of from (select *, row_number() over (partition by media_key order by channel is not null desc, reupload_of is not null desc, published_at desc nulls last, length_s desc nulls last, channel, source, reupload_of) rn from recording where media_key is not null) where rn = 1")
def w32_preferred(spark, sf):
    """Of the rows of a recording the one that knows most, then the newest."""
    df = table(spark, sf, "recording").filter("media_key is not null")
    order = [F.col("channel").isNull(), F.col("reupload_of").isNull(), -F.coalesce(F.expr("timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', published_at)"), F.lit(-(1 << 62))), -F.coalesce("length_s", F.lit(-1e9)), F.coalesce("channel", F.lit("￿")), F.coalesce("source", F.lit("￿")), F.coalesce("reupload_of", F.lit("￿"))]
    return rows.first_rows(df, ["media_key"], order).select("media_key", "source", "channel", "reupload_of")


@query("select tag, run_key from (select tag, run_key, row_number() over (partition by tag order by count(*) desc, run_key) rn from run_scalar where run_key is not null group by tag, run_key) where rn = 1")
def w19_largest_group(spark, sf):
    """The group with most rows, the first name on a tie."""
    n = table(spark, sf, "run_scalar", "tag", "run_key").filter("run_key is not null").groupBy("tag", "run_key").agg(F.count("*").alias("n"))
    return n.groupBy("tag").agg(F.min_by("run_key", F.struct(-F.col("n"), F.col("run_key"))).alias("run_key"))


# --------------------------------------------------------------------------------------------- draws


def _hash(tag):
    return F.sha2(F.concat(F.lit(tag), F.col("id")), 256)


@query(f"select source, id from {UTT} qualify row_number() over (partition by source order by sha256('pick' || id), id) <= 20")
def t01_seeded_subset(spark, sf):
    """20 ids of each source, by salted hash alone; the limit is the operator."""
    df = utterances(spark, sf, "source", "id").withColumn("h", _hash("pick"))
    return rows.numbered(df, ["source"], [F.col("h"), F.col("id")]).filter("rn <= 20").select("source", "id")


@query(f"""with u as (select id, source, row_no, row_number() over (partition by source order by sha256('dev' || id), id) as k from {UTT} where split = 'train') select id, source, row_number() over (order by row_no) as place from u where k <= 10""")
def t02_pick_in_order(spark, sf):
    """Ten ids of each source, back in store order; few rows reach the last window."""
    df = utterances(spark, sf, "id", "source", "row_no", "split").filter("split = 'train'").withColumn("h", _hash("dev"))
    picked = rows.numbered(df, ["source"], [F.col("h"), F.col("id")], "k").filter("k <= 10")
    return rows.numbered(picked, [], [F.col("row_no")], "place").select("id", "source", "place")


@query(f"""with u as (select id, source, coalesce(teacher_cer, 0) as e from {UTT}), w as (select *, row_number() over (partition by source order by e desc, id) as bad, sha256('rest' || id) as h from u)
 select source, id, 'worst' as kind from w where bad <= 5 union all select source, id, 'rest' from (select *, row_number() over (partition by source order by h, id) as k from w where bad > 5) where k <= 5""")
def t04_worst_and_rest(spark, sf):
    """The worst five by error and five of the rest by hash, of each source."""
    df = utterances(spark, sf, "id", "source", "teacher_cer").withColumn("e", F.coalesce("teacher_cer", F.lit(0.0).cast("float"))).withColumn("h", _hash("rest"))
    df = rows.numbered(df, ["source"], [F.desc("e"), F.col("id")], "bad")
    worst = df.filter("bad <= 5").select("source", "id", F.lit("worst").alias("kind"))
    rest = rows.numbered(df.filter("bad > 5"), ["source"], [F.col("h"), F.col("id")], "k").filter("k <= 5").select("source", "id", F.lit("rest").alias("kind"))
    return worst.unionByName(rest)


@query(f"""with u as (select id, n_tok, sum(n_tok) over (order by sha256('budget' || id), id rows unbounded preceding) as upto from {UTT} where split = 'train') select id, cast(upto as bigint) as upto from u where upto <= 20000""")
def w09_budget_draw(spark, sf):
    """The longest hash-order prefix within a budget, with a running sum over range partitions."""
    df = utterances(spark, sf, "id", "n_tok", "split").filter("split = 'train'").select("id", "n_tok", _hash("budget").alias("h"))
    return sequence.budget_prefix(df, ["h", "id"], "n_tok", 20000).select("id", "upto")


@query(f"""with g as (select media_key, count(*) as n, sha256('group' || media_key) as h from {UTT} where media_key is not null group by media_key),
 c as (select *, coalesce(sum(n) over (order by h, media_key rows between unbounded preceding and 1 preceding), 0) as before from g) select media_key, n from c where before < 500""")
def w11_whole_groups(spark, sf):
    """Whole groups in hash order until 500 rows are reached."""
    g = utterances(spark, sf, "id", "media_key").filter("media_key is not null").groupBy("media_key").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit("group"), "media_key"), 256))
    return sequence.running_total(g, ["h", "media_key"], "n").filter("upto - n < 500").select("media_key", "n")


@query(f"""with s as (select distinct source, {STEM} as stem from {UTT} where split = 'train'), r as (select source, stem, dense_rank() over (partition by source order by stem) as k, count(*) over (partition by source) as n from s),
 p as (select source, 1 + cast(min(k) as bigint) as pick from r where n >= 4 group by source) select r.source, r.stem, case when k in (pick, pick + 1) then 'pair' else 'buffer' end as kind from r join p on r.source = p.source and r.k between pick - 1 and pick + 2""")
def w12_pair_with_buffers(spark, sf):
    """Two adjacent stems of a source and a buffer on each side."""
    s = utterances(spark, sf, "id", "source", "split", "row_no").filter("split = 'train'").select("source", stem().alias("stem")).distinct()
    s = rows.numbered(s, ["source"], [F.col("stem")], "k")
    p = s.groupBy("source").agg(F.count("*").alias("n"), (1 + F.min("k")).alias("pick")).filter("n >= 4")
    near = s.join(p, "source").filter("k between pick - 1 and pick + 2")
    return near.select("source", "stem", F.when(F.expr("k in (pick, pick + 1)"), "pair").otherwise("buffer").alias("kind"))


@query("""select id, cast(floor(w) + case when u < w - floor(w) then 1 else 0 end as bigint) as n from (select id, duration / 4.0 as w, cast(('0x' || substr(sha256('rep' || id), 1, 8)) as bigint) / 4294967296.0 as u from (select id, cast(min(duration) as double) as duration from utt_index group by id)) where floor(w) + case when u < w - floor(w) then 1 else 0 end > 0""")
def t10_stochastic_repeat(spark, sf):
    """floor(w) copies and one more with the probability of the rest, from a hash."""
    df = table(spark, sf, "utt_index", "id", "duration").groupBy("id").agg(F.min("duration").cast("double").alias("duration"))
    w = F.col("duration") / 4.0
    u = F.conv(F.substring(_hash("rep"), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    n = (F.floor(w) + F.when(u < w - F.floor(w), 1).otherwise(0)).cast("bigint")
    return df.select("id", n.alias("n")).filter("n > 0")


QUERIES, SQL = query.queries, query.sql
