"""Arrays, dates, nested values, files and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import arrays, nested
from gleaner.plans.batches import PATIENCE_SQL
from gleaner.plans.registry import Registry
from gleaner.plans.runs import log
from gleaner.plans.selection import UTT, utterances
from gleaner.session import scratch_path, table
from gleaner.sources import files
from gleaner.streaming import tail

query = Registry()

SOFT = "list_transform(embedding, lambda x: exp(cast(x as double) - m) / z)"
EMB = """with c as (select label, list_transform(range(1, 65), lambda i: avg_at[i]) as centre from (select label, list(a order by i) as avg_at from (select label, i, avg(cast(embedding[i] as double)) as a from embeddings, range(1, 65) t(i) group by label, i) group by label)),
 e as (select vec_id, label, embedding, list_max(list_transform(embedding, lambda x: cast(x as double))) as m from embeddings), z as (select e.*, list_sum(list_transform(embedding, lambda x: exp(cast(x as double) - m))) as z from e),
 cz as (select label, centre, list_max(centre) as cm, list_sum(list_transform(centre, lambda x: exp(x - list_max(centre)))) as cs from c)
"""


def _distributions(spark, sf):
    """Each vector and its label's mean as probabilities."""
    e = table(spark, sf, "embeddings", "vec_id", "label", "embedding").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("a"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s.a).alias("centre"))
    both = e.join(centres.withColumn("q", arrays.softmax(F.col("centre"))), "label")
    return both.select("vec_id", arrays.softmax(F.col("x")).alias("p"), "q")


@query(EMB + "select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: exp(cast(embedding[i] as double) - m) / z * (cast(embedding[i] as double) - m - ln(z) - (centre[i] - cm - ln(cs))))), 6) as kl from z join cz using (label)")
def m01_divergence(spark, sf):
    """Divergence of each vector's distribution from that of its label's mean."""
    return _distributions(spark, sf).select("vec_id", F.round(arrays.divergence(F.col("p"), F.col("q")), 6).alias("kl"))


@query(EMB + """, p as (select vec_id, list_transform(range(1, 65), lambda i: {'p': exp(cast(embedding[i] as double) - m) / z, 'q': exp(centre[i] - cm) / cs}) as x from z join cz using (label)),
 k as (select vec_id, list_sort(list_transform(x, lambda e: {'n': -e.p, 'q': e.q}))[1:8] as top from p), s as (select vec_id, top, greatest(0.0, 1 + list_sum(list_transform(top, lambda e: e.n))) as pr, greatest(0.0, 1 - list_sum(list_transform(top, lambda e: e.q))) as qr from k)
 select vec_id, round(list_sum(list_transform(top, lambda e: -e.n * (ln(-e.n) - ln(e.q)))) + case when pr > 0 then pr * (ln(pr) - ln(qr)) else 0 end, 6) as kl from s""")
def m01_top_k(spark, sf):
    """The same over the eight largest entries and one bin for the rest."""
    return _distributions(spark, sf).select("vec_id", F.round(arrays.top_with_rest(F.col("p"), F.col("q"), 8), 6).alias("kl"))


DENSE = """, p as (select vec_id, list_transform(range(1, 65), lambda i: {'i': i, 'p': exp(cast(embedding[i] as double) - m) / z, 'q': exp(centre[i] - cm) / cs}) as x from z join cz using (label))"""


@query(EMB + DENSE + """, k as (select vec_id, x[64].p as bp, x[64].q as bq, list_sort(list_transform(list_filter(x, lambda e: e.i != 64), lambda e: {'n': -e.p, 'q': e.q}))[1:8] as top from p),
 s as (select *, greatest(1e-12, 1 - bp + list_sum(list_transform(top, lambda e: e.n))) as pr, greatest(1e-12, 1 - bq - list_sum(list_transform(top, lambda e: e.q))) as qr from k)
 select vec_id, round(bp * (ln(bp) - ln(bq)) + list_sum(list_transform(top, lambda e: -e.n * (ln(-e.n) - ln(e.q)))) + pr * (ln(pr) - ln(qr)), 6) as kl, round(bp * (ln(bp) - ln(bq)) + (1 - bp) * (ln(1 - bp) - ln(1 - bq)), 6) as kl_two from s""")
def m02_dense(spark, sf):
    """The blank bin, the eight largest others and the rest; and the blank against all else."""
    d = _distributions(spark, sf)
    blank = lambda c: F.get(c, F.lit(63))
    return d.select("vec_id", F.round(arrays.dense_divergence(F.col("p"), F.col("q"), 8, 63), 6).alias("kl"), F.round(arrays.two_bin_divergence(blank("p"), blank("q")), 6).alias("kl_two"))


@query("select vec_id, round(m + ln(list_sum(list_transform(embedding, lambda x: exp(cast(x as double) - m)))), 6) as lse from (select *, list_max(list_transform(embedding, lambda x: cast(x as double))) as m from embeddings)")
def m01_log_sum_exp(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    return e.select("vec_id", F.round(arrays.log_sum_exp(F.col("x")), 6).alias("lse"))


@query("""select distinct step, round(case when step < 10 then 0.001 * (step + 1) / 10 when step < 100 * 0.8 then 0.001 else 0.001 * (1 - sqrt(least(1.0, (step - 80.0) / 20.0))) end, 9) as rate from run_scalar where step is not null""")
def m04_schedule(spark, sf):
    """Warm-up, flat, cool-down."""
    return table(spark, sf, "run_scalar", "step").filter("step is not null").distinct().select("step", F.round(arrays.schedule(F.col("step"), 100, 10, 0.2, 0.001), 9).alias("rate"))


@query(f"select id, cast(floor((floor((floor((floor(audio_len / 160.0) - 1) / 2) + 1 - 1) / 2) + 1 - 1) / 2) + 1 as bigint) as n_frames from {UTT}")
def m05_frames(spark, sf):
    """Frame count with floor division."""
    return utterances(spark, sf, "id", "audio_len").select("id", arrays.frames(F.col("audio_len")).cast("bigint").alias("n_frames"))


@query("""select vec_id, round(avg(v * v) filter (10 * log10(v * v) > top - 35), 6) as power from (select vec_id, cast(unnest(embedding) as double) as v, max_power as top from (select *, 10 * log10(list_max(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as max_power from embeddings)) where v != 0 group by vec_id""")
def m06_loud_part(spark, sf):
    """Mean power of the entries within 35 dB of the loudest."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("power", F.filter(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), lambda v: v > 0))
    near = F.filter("power", lambda v: 10 * F.log10(v) > 10 * F.log10(F.array_max("power")) - 35)
    return e.select("vec_id", F.round(F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near), 6).alias("power"))


@query("select doc_id, cast(epoch(created_at) as double) as seconds, strftime(created_at, '%Y%m%dT%H%M%SZ') as stamp from documents where created_at is not null")
def d01_time_parts(spark, sf):
    """Seconds since the epoch, and a stamp that is read back."""
    d = table(spark, sf, "documents", "doc_id", "created_at").filter("created_at is not null")
    # Both without a zone, so that the session's doesn't matter.
    micros = F.expr("timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', created_at)")
    return d.select("doc_id", (micros / 1e6).alias("seconds"), F.date_format("created_at", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("""select run_key, tag, step from (select *, lag(step) over (partition by run_key, tag order by step) as before, lag(wall) over (partition by run_key, tag order by step) as then_ from (select * from run_scalar qualify row_number() over (partition by run_key, tag, step order by wall desc, elapsed_s desc, coalesce(value, 0) desc, coalesce(nf, '') desc) = 1) where run_key is not null and tag is not null and step is not null) where before is null or step - before >= 5 or wall - then_ >= 60""")
def d03_due(spark, sf):
    """Rows that come five steps or a minute after the one before."""
    from pyspark.sql import Window as W

    w = W.partitionBy("run_key", "tag").orderBy("step")
    df = log(spark, sf, "run_key", "tag", "step", "wall").withColumn("before", F.lag("step").over(w)).withColumn("then_", F.lag("wall").over(w))
    return df.filter("before is null or step - before >= 5 or wall - then_ >= 60").select("run_key", "tag", "step")


@query("select event_id, 'm.k' as path, cast(json_extract(props, '$.k') as double) as value from events union all select event_id, 'm.v.value', value from events")
def n01_flatten(spark, sf):
    """Nested numbers as path and value."""
    e = table(spark, sf, "events", "event_id", "event_type", "value", "props")
    nest = F.struct(F.from_json("props", "k int").k.alias("k"), F.struct("value", "event_type").alias("v")).alias("m")
    return nested.flattened(e.select("event_id", nest), ["event_id"])


@query("select event_type, cast(json_extract(props, '$.k') as integer) % 10 as k10, count(*) as n from events group by 1, 2")
def n03_json_path(spark, sf):
    """A dotted path looked up in schema-on-read values."""
    e = table(spark, sf, "events", "event_type", "props").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.groupBy("event_type", (F.col("k") % 10).alias("k10")).agg(F.count("*").alias("n"))


@query("select tag, sha256('[' || string_agg('[\"' || run_key || '\",' || n || ']', ',' order by run_key) || ']') as digest from (select tag, run_key, count(*) as n from run_scalar where run_key is not null and tag is not null group by 1, 2) group by tag")
def n04_digest(spark, sf):
    """A digest of a canonical JSON value."""
    n = table(spark, sf, "run_scalar", "tag", "run_key").na.drop().groupBy("tag", "run_key").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("run_key", "n"))), lambda x: F.concat(F.lit('["'), x.run_key, F.lit('",'), x.n.cast("string"), F.lit("]")))
    return n.groupBy("tag").agg(F.sha2(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), 256).alias("digest"))


@query("select tag, count(*) filter (value is not null) as n_finite, count(*) filter (nf = 'nan') as n_nan, count(*) filter (nf in ('inf', '-inf')) as n_inf from run_scalar group by tag")
def n05_restored(spark, sf):
    """Values that JSON can't hold, restored and taken out again."""
    v = nested.restored(F.col("value"), F.col("nf"))
    df = table(spark, sf, "run_scalar", "tag", "value", "nf").select("tag", v.alias("v"))
    return df.groupBy("tag").agg(F.count(nested.finite(F.col("v"))).alias("n_finite"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(F.abs("v") == float("inf")).alias("n_inf"))


@query("select split_part(tag, '/', 1) as bucket, string_agg(tag, ',' order by tag) as tags from (select distinct tag from run_scalar where tag is not null) group by 1")
def n07_inverse_map(spark, sf):
    """A map turned round."""
    t = table(spark, sf, "run_scalar", "tag").filter("tag is not null").distinct()
    return t.groupBy(F.split_part("tag", F.lit("/"), F.lit(1)).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query("select run_key, split_part(run_key, '-', 1) as base, split_part(run_key, '-', -1) as number, count(*) as n from run_scalar group by run_key")
def e15_name_parts(spark, sf):
    """A name split into its parts."""
    n = table(spark, sf, "run_scalar", "run_key").groupBy("run_key").agg(F.count("*").alias("n"))
    return n.select("run_key", F.split_part("run_key", F.lit("-"), F.lit(1)).alias("base"), F.split_part("run_key", F.lit("-"), F.lit(-1)).alias("number"), "n")


@query("select doc_id, '***' as api_key, '***' as author_token, lang, channel from documents")
def e16_redacted(spark, sf):
    """Values of telling names blanked, the others kept."""
    d = table(spark, sf, "documents", "doc_id", "lang", "channel", "source")
    m = nested.redacted(F.create_map(F.lit("api_key"), F.coalesce("source", F.lit("")), F.lit("author_Token"), F.lit("x"), F.lit("lang"), F.col("lang"), F.lit("channel"), F.col("channel")))
    return d.select("doc_id", *(F.try_element_at(m, F.lit(k)).alias(k.lower()) for k in ("api_key", "author_Token", "lang", "channel")))


@query("select doc_id, replace(replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' '), chr(13), chr(13)) as cell from documents")
def e17_cells(spark, sf):
    """Texts as cells of a Markdown table."""
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", files.cell(F.col("text")).alias("cell"))


# ------------------------------------------------------------------------------------ files and streams


LINE = "run_key string, step bigint, wall double, tag string, value double, nf string"


@query("select run_key, step, wall, tag, value, nf from run_scalar")
def s03_lines(spark, sf):
    """Rows written as lines of JSON and read again, torn lines apart."""
    folder = scratch_path(spark, "lines")
    table(spark, sf, "run_scalar", "run_key", "step", "wall", "tag", "value", "nf").select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    return files.read_whole_lines(spark, folder, LINE)[0]


@query(f"select id, ref, hyp from {UTT} where ref is not null and hyp is not null")
def s09_pairs(spark, sf):
    """Members of two kinds paired by key, the unpaired left out."""
    u = utterances(spark, sf, "id", "ref", "hyp")
    members = u.select("id", F.explode(F.array(F.struct(F.lit("hyp").alias("kind"), F.col("hyp").alias("text")), F.struct(F.lit("ref").alias("kind"), F.col("ref").alias("text")))).alias("m")).select("id", "m.*")
    return files.paired(members, "id", "kind", "text", "ref", "hyp")


@query("select source, path from (select distinct source, path from shard_manifest) qualify row_number() over (partition by source order by path) <= 1")
def s10_first_inputs(spark, sf):
    """The first input of each source, which is the operator."""
    from gleaner.operators.rows import numbered

    return numbered(table(spark, sf, "shard_manifest", "source", "path").distinct(), ["source"], [F.col("path")]).filter("rn <= 1").select("source", "path")


@query("select source, split, count(*) as n_rows, cast(true as boolean) as bounded from utt_index where split is not null group by 1, 2")
def s11_shards(spark, sf):
    """Files of at most 500 rows by source and split, and their manifest."""
    df = table(spark, sf, "utt_index", "id", "source", "split", "duration").filter("split is not null")
    manifest = files.write_shards(df, scratch_path(spark, "shards"), ["source", "split"], 500)
    return manifest.groupBy("source", "split").agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 500).alias("bounded"))


@query("select vec_id, label, cast(len(embedding) as integer) as n from embeddings")
def s15_export(spark, sf):
    """Nested columns as JSON in CSV, read back."""
    folder = scratch_path(spark, "export")
    files.export(table(spark, sf, "embeddings"), folder, 10_000_000)
    back = spark.read.option("header", True).option("escape", '"').schema("vec_id bigint, embedding string, label int").csv(f"{folder}/csv")
    return back.select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).alias("n"))


@query("select run_key, tag, step, arg_max(value, wall) as value from (select * from run_scalar where value is not null) group by run_key, tag, step")
def x01_stream_last(spark, sf):
    """A stream whose last value of each step and tag wins; a batch writes only what it changes."""
    folder = scratch_path(spark, "stream")
    table(spark, sf, "run_scalar").filter("value is not null").repartition(3).write.parquet(f"{folder}/in")
    stream = tail.tail(spark, f"{folder}/in", table(spark, sf, "run_scalar").schema, "parquet", 1)
    last = tail.last_values(["run_key", "tag", "step"], "wall", ["value"])
    tail.keep_changes(stream, last, last, f"{folder}/out", f"{folder}/state")
    return tail.changes(spark, f"{folder}/out", last).select("run_key", "tag", "step", "value")


@query("select time_bucket(interval '1 hour', ts) as began, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def x02_stream_windows(spark, sf):
    """Event-time windows over files in any order of time; a row counts however late it comes."""
    folder = scratch_path(spark, "windows")
    table(spark, sf, "events", "ts", "event_type", "value").repartition(3).write.parquet(f"{folder}/in")
    stream = tail.tail(spark, f"{folder}/in", "ts timestamp_ntz, event_type string, value double", "parquet", 1)
    partial, merge = tail.window_sums("ts", "event_type", "value")
    tail.keep_changes(stream, partial, merge, f"{folder}/out", f"{folder}/state")
    done = tail.changes(spark, f"{folder}/out", merge)
    return done.select(F.col("began").cast("timestamp_ntz").alias("began"), "event_type", "n", F.round("total", 6).alias("total"))


@query("select event_id, user_id, event_type from events")
def x03_stream_resume(spark, sf):
    """Files sent twice by a resumed writer give each event once; two runs share one checkpoint."""
    folder = scratch_path(spark, "resume")
    events = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    stream = lambda: tail.distinct_stream(tail.tail(spark, f"{folder}/in", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string", "parquet"), "ts", ["event_id"], "400 days")
    events.filter("event_id % 3 != 0").write.parquet(f"{folder}/in/part=0")
    tail.run_available(stream(), f"{folder}/out", f"{folder}/state")
    events.write.parquet(f"{folder}/in/part=1")
    tail.run_available(stream(), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


@query(PATIENCE_SQL)
def x09_stream_patience(spark, sf):
    """Patience carried from one micro-batch to the next."""
    folder = scratch_path(spark, "patience")
    df = log(spark, sf, "run_key", "tag", "step", "value").filter("tag = 'train/loss'").select("run_key", "step", "value")
    schema = "run_key string, step bigint, value double"
    for part, rows in enumerate(("step < 80", "step >= 80")):
        df.filter(rows).coalesce(1).write.parquet(f"{folder}/in/part={part}")
        stream = tail.patience_stream(tail.tail(spark, f"{folder}/in", schema, "parquet"), "run_key", "step", "value", 4, 0.001, 0.01, 0.8, 5)
        tail.run_available(stream, f"{folder}/out", f"{folder}/state")
    back = spark.read.schema("run_key string, step bigint, best double, since int, evals int, trigger string").parquet(f"{folder}/out")
    return back.join(df, ["run_key", "step"]).select("run_key", "step", "value", "best", "since", "evals", "trigger")


QUERIES, SQL = query.queries, query.sql
