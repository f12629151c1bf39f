"""Selecting utterances: ingest rules, cascades, decontamination, counts by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import rows, sequence
from gleaner.operators import statistics as st
from gleaner.plans.fragments import crc32_sql, distance_sql
from gleaner.plans.registry import Registry
from gleaner.session import table

query = Registry()

LIMITS = {"tv_small": 0.2, "web_talk": 0.25}
LIMIT = 0.3
UTT = "(select * exclude (rn) from (select *, row_number() over (partition by id order by row_no) rn from utt_index) where rn = 1)"
JUDGED = "(select * exclude (rn) from (select *, row_number() over (partition by id order by judged_at desc nulls last, coalesce(agree, -1) desc, coalesce(hyp2, '') desc, coalesce(model2, '') desc, coalesce(cer2, -1) desc) rn from second_opinion) where rn = 1)"
STEM = "source || '/' || coalesce(split, 'none') || '-' || lpad(cast(row_no // 500 as varchar), 5, '0')"


def utterances(spark, sf, *columns) -> DataFrame:
    """One row for each utterance: its first in store order."""
    df = table(spark, sf, "utt_index", *dict.fromkeys(["id", "row_no", *columns]))
    return rows.first_rows(df, ["id"], [F.col("row_no")]).select(*columns)


def judged(spark, sf, *columns) -> DataFrame:
    """The last verdict on each utterance."""
    df = table(spark, sf, "second_opinion")
    order = [F.col("judged_at"), F.coalesce("agree", F.lit(-1)), F.coalesce("hyp2", F.lit("")), F.coalesce("model2", F.lit("")), F.coalesce("cer2", F.lit(-1.0))]
    return rows.last_rows(df, ["id"], order).select(*columns)


def stem():
    return F.concat("source", F.lit("/"), F.coalesce("split", F.lit("none")), F.lit("-"), F.lpad(F.expr("row_no div 500").cast("string"), 5, "0"))


INGEST_SQL = """case when coalesce(trim(ref), '') = '' then 'empty_text' when coalesce(audio_len, 0) <= 0 then 'bad_audio'
 when not (duration >= cast(0.3 as float) and duration <= cast(30 as float)) then 'bad_duration' else 'kept' end"""


def ingest_reason():
    return rows.cascade(
        [
            ("empty_text", F.coalesce(F.trim("ref"), F.lit("")) == ""),
            ("bad_audio", F.coalesce("audio_len", F.lit(0)) <= 0),
            ("bad_duration", ~F.col("duration").between(F.lit(0.3).cast("float"), F.lit(30.0).cast("float"))),
        ]
    )


@query(f"select source, {INGEST_SQL} as reason, count(*) as n from utt_index group by 1, 2")
def rule01_ingest_drops(spark, sf):
    """Rows dropped at ingest, counted by reason."""
    return table(spark, sf, "utt_index", "source", "ref", "audio_len", "duration").groupBy("source", ingest_reason().alias("reason")).agg(F.count("*").alias("n"))


@query("select doc_id, lang from documents where lower(split_part(coalesce(lang, 'ja'), '-', 1)) = 'ja' and regexp_matches(text, '[ぁ-ゖァ-ヺ一-鿿]')")
def rule02_script(spark, sf):
    """Documents tagged Japanese (the default) that hold kana or kanji."""
    df = table(spark, sf, "documents", "doc_id", "lang", "text")
    tag = F.lower(F.split_part(F.coalesce("lang", F.lit("ja")), F.lit("-"), F.lit(1)))
    return df.filter((tag == "ja") & F.col("text").rlike("[ぁ-ゖァ-ヺ一-鿿]")).select("doc_id", "lang")


def base_cascade(spark, sf, limits=LIMITS, limit=LIMIT) -> DataFrame:
    """Utterances with a split, their verdict, presence of the recording, and the first rule that drops them."""
    u = utterances(spark, sf, "id", "source", "split", "duration", "n_tok", "truncated", "media_key", "row_no", "ref", "hyp").filter("split is not null").withColumn("stem", stem())
    u = u.join(judged(spark, sf, "id", "agree"), "id", "left")
    stems = u.filter("agree is not null").select("stem").distinct().withColumn("stem_judged", F.lit(True))
    u = u.join(stems, "stem", "left")
    u = rows.present(u, table(spark, sf, "recording", "media_key"), ["media_key"], "has_audio")
    most = rows.threshold(F.col("source"), limits, limit)
    train = F.col("split") == "train"
    reason = rows.cascade(
        [
            ("truncated", train & F.col("truncated")),
            ("not_judged", train & F.col("agree").isNull() & F.col("stem_judged").isNull()),
            ("no_agree", train & F.col("agree").isNull()),
            (F.concat(F.lit("agree>"), most.cast("string")), train & (F.col("agree") > most)),
            ("no_audio", ~F.col("has_audio")),
        ]
    )
    return u.withColumn("reason", reason)


MOST_SQL = "case when source = 'tv_small' then cast(0.2 as float) when source = 'web_talk' then cast(0.25 as float) else cast(0.3 as float) end"
BASE_SQL = f"""with u as (select u.*, {STEM} as stem, j.agree as agree2 from {UTT} u left join {JUDGED} j using (id) where split is not null),
s as (select distinct stem from u where agree2 is not null), r as (select distinct media_key from recording where media_key is not null),
base as (select u.*, r.media_key is not null as has_audio, {MOST_SQL} as most,
 case when split = 'train' and truncated then 'truncated' when split = 'train' and agree2 is null and s.stem is null then 'not_judged'
 when split = 'train' and agree2 is null then 'no_agree'
 when split = 'train' and agree2 > {MOST_SQL} then 'agree>' || case when source = 'tv_small' then '0.2' when source = 'web_talk' then '0.25' else '0.3' end
 when r.media_key is null then 'no_audio' else 'kept' end as reason
 from u left join s on s.stem = u.stem left join r on r.media_key = u.media_key)
"""


@query(BASE_SQL + "select id, source, split, cast(agree2 as float) as agree, reason from base")
def rule03_cascade(spark, sf):
    """Verdicts joined last-wins, thresholds by source, first matching rule."""
    return base_cascade(spark, sf).select("id", "source", "split", F.col("agree").cast("float").alias("agree"), "reason")


def plain(text):
    """Lower case, ASCII letters and digits, kana and kanji only; the form both engines agree on."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9ぁ-ゖァ-ヺー一-鿿]", "")


def plain_sql(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9ぁ-ゖァ-ヺー一-鿿]', '', 'g')"


def held_out_texts(u: DataFrame) -> DataFrame:
    held = u.filter("split in ('dev', 'eval')").select(plain(F.col("ref")).alias("key"))
    return held.filter(F.length("key") >= 15).distinct()


@query(f"""with u as (select id, source, split, {plain_sql('ref')} as r, {plain_sql('hyp')} as h from {UTT}),
 held as (select distinct r as key from u where split in ('dev', 'eval') and length(r) >= 15)
 select id, source from u where split = 'train' and (r in (select key from held) or h in (select key from held))""")
def j06_held_out_text(spark, sf):
    """Training rows whose plain ref or hyp equals a held-out text of 15 characters or more."""
    u = utterances(spark, sf, "id", "source", "split", "ref", "hyp")
    keys = u.filter("split = 'train'").select("id", "source", F.explode(F.array_distinct(F.array(plain(F.col("ref")), plain(F.col("hyp"))))).alias("key"))
    return keys.join(held_out_texts(u), "key", "left_semi").select("id", "source").distinct()


@query(f"""with u as (select u.id, u.split, {plain_sql('ref')} as r, {plain_sql('hyp')} as h, {plain_sql('hyp2')} as h2 from {UTT} u left join {JUDGED} j using (id)),
 dev as (select r as key from u where split = 'dev' union select h from u where split = 'dev' union select h2 from u where split = 'dev'),
 k as (select key from dev where length(key) >= 15)
 select id from u where split = 'train' and (r in (select key from k) or h in (select key from k) or h2 in (select key from k))""")
def j07_three_key_dedup(spark, sf):
    """Training rows any of whose three texts equals any of the three texts of a dev row."""
    u = utterances(spark, sf, "id", "split", "ref", "hyp").join(judged(spark, sf, "id", "hyp2"), "id", "left")
    keys = u.select("id", "split", F.explode(F.array_distinct(F.array(*(plain(F.col(c)) for c in ("ref", "hyp", "hyp2"))))).alias("key")).filter(F.length("key") >= 15)
    dev = keys.filter("split = 'dev'").select("key").distinct()
    return keys.filter("split = 'train'").join(dev, "key", "left_semi").select("id").distinct()


def study_cascade(spark, sf) -> DataFrame:
    """The base reasons, then rules that only hit rows still kept."""
    base = base_cascade(spark, sf)
    dup = base.filter("split = 'train'").select("id", F.explode(F.array_distinct(F.array(plain(F.col("ref")), plain(F.col("hyp"))))).alias("key"))
    dup = dup.join(held_out_texts(base), "key", "left_semi").select("id").distinct().withColumn("dup", F.lit(True))
    base = base.join(dup, "id", "left")
    train = F.col("split") == "train"
    return rows.staged(
        base,
        [
            ("disagree", train & (F.coalesce(F.levenshtein(plain(F.col("ref")), plain(F.col("hyp"))), F.lit(0)) > F.length(plain(F.col("ref"))) * 0.2)),
            ("held_out_text", train & F.col("dup")),
            ("too_long", train & (F.col("n_tok") > F.col("duration") * 20)),
        ],
    )


STUDY_SQL = (
    BASE_SQL
    + f""", pl as (select *, {plain_sql('ref')} as pr, {plain_sql('hyp')} as ph from base), held as (select distinct pr as key from pl where split in ('dev', 'eval') and length(pr) >= 15),
 study as (select * replace (case when reason != 'kept' or split != 'train' then reason when {distance_sql('pr', 'ph')} > length(pr) * 0.2 then 'disagree' when pr in (select key from held) or ph in (select key from held) then 'held_out_text' when n_tok > duration * 20 then 'too_long' else reason end as reason) from pl)"""
)


@query(STUDY_SQL + " select id, reason from study")
def rule04_staged_cascade(spark, sf):
    """Later rules overwrite only kept rows; the expensive comparison runs on those alone."""
    return study_cascade(spark, sf).select("id", "reason")


@query("""select snap, id, case when truncated then 'truncated' when agree is null then 'no_agree' when agree > cast(0.2 as float) then 'agree>0.2' else 'kept' end as reason
 from (select distinct snap, id, truncated, agree from selection where split = 'train')""")
def rule06_derived(spark, sf):
    """Reasons computed again from stored columns for another threshold."""
    df = table(spark, sf, "selection", "snap", "id", "truncated", "agree", "split").filter("split = 'train'").drop("split").distinct()
    reason = rows.cascade([("truncated", F.col("truncated")), ("no_agree", F.col("agree").isNull()), ("agree>0.2", F.col("agree") > F.lit(0.2).cast("float"))])
    return df.select("snap", "id", reason.alias("reason"))


@query("""select id, source, split, n_tok from (select distinct id, source, split, n_tok from selection where snap = 2 and keep and source in ('pod_nc', 'tv_large', 'vn_voice') and split in ('train', 'dev'))""")
def rule09_kept_rows(spark, sf):
    """Kept rows of some sources and splits."""
    df = table(spark, sf, "selection", "snap", "id", "source", "split", "n_tok", "keep")
    df = df.filter("snap = 2 and keep and source in ('pod_nc', 'tv_large', 'vn_voice') and split in ('train', 'dev')")
    return df.select("id", "source", "split", "n_tok").distinct()


@query(f"""select id, cast(len(p) as integer) as n_problems, array_to_string(p, ',') as problems from (select id, list_filter([
 case when not coalesce(length(ref) > 0, false) then 'no_ref' end, case when not coalesce(length(hyp) > 0, false) then 'no_hyp' end,
 case when not coalesce(n_tok between 1 and 200, false) then 'n_tok' end, case when not coalesce(split in ('train', 'dev', 'eval'), false) then 'split' end,
 case when not coalesce(media_key is not null, false) then 'media_key' end], lambda x: x is not null) as p from {UTT}) where len(p) > 0""")
def rule10_problem_list(spark, sf):
    """Every failed condition of a row, not only the first."""
    u = utterances(spark, sf, "id", "ref", "hyp", "n_tok", "split", "media_key")
    checks = [("no_ref", F.length("ref") > 0), ("no_hyp", F.length("hyp") > 0), ("n_tok", F.col("n_tok").between(1, 200)), ("split", F.col("split").isin("train", "dev", "eval")), ("media_key", F.col("media_key").isNotNull())]
    u = u.select("id", rows.problems(checks).alias("p")).filter(F.size("p") > 0)
    return u.select("id", F.size("p").alias("n_problems"), F.array_join("p", ",").alias("problems"))


RENAMES = [("^train/loss$", "1_loss/train"), ("^train/(.*)$", "2_train/$1"), ("^eval/([^/]+)/kl$", "1_loss/kl_$1"), ("^eval/([^/]+)/(.*)$", "2_eval/$1_$2")]


@query("""select tag, case when regexp_matches(tag, '^train/loss$') then '1_loss/train' when regexp_matches(tag, '^train/') then regexp_replace(tag, '^train/(.*)$', '2_train/\\1')
 when regexp_matches(tag, '^eval/([^/]+)/kl$') then regexp_replace(tag, '^eval/([^/]+)/kl$', '1_loss/kl_\\1')
 when regexp_matches(tag, '^eval/([^/]+)/') then regexp_replace(tag, '^eval/([^/]+)/(.*)$', '2_eval/\\1_\\2') else '3_misc/' || tag end as target, count(*) as n
 from run_scalar where tag is not null group by 1, 2""")
def rule11_rewrite_tags(spark, sf):
    """The first matching rule renames a tag; what none matches goes to misc."""
    tag, target = F.col("tag"), None
    for pattern, to in RENAMES:
        done = F.regexp_replace(tag, pattern, to)
        target = F.when(tag.rlike(pattern), done) if target is None else target.when(tag.rlike(pattern), done)
    tags = table(spark, sf, "run_scalar", "tag").filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))
    return tags.select("tag", target.otherwise(F.concat(F.lit("3_misc/"), tag)).alias("target"), "n")


@query("""with t as (select tag, min(wall) as first_seen, split_part(tag, '/', 1) as wanted from run_scalar where tag is not null group by tag)
 select tag, case when row_number() over (partition by wanted order by first_seen, tag) = 1 then wanted else 'misc/' || tag end as target from t""")
def rule12_no_collision(spark, sf):
    """Two tags never share a target; the first seen keeps it."""
    tags = table(spark, sf, "run_scalar", "tag", "wall").filter("tag is not null").groupBy("tag").agg(F.min("wall").alias("first_seen")).withColumn("wanted", F.split_part("tag", F.lit("/"), F.lit(1)))
    first = F.row_number().over(W.partitionBy("wanted").orderBy("first_seen", "tag")) == 1
    return tags.select("tag", F.when(first, F.col("wanted")).otherwise(F.concat(F.lit("misc/"), "tag")).alias("target"))


@query("""select id, regexp_extract(id, '/JA_(.*)_W[0-9]+$', 1) as video from (select distinct id from utt_index) where regexp_matches(id, '/JA_.*_W[0-9]+$')""")
def rule13_key_from_name(spark, sf):
    """The recording part of an id, up to its last _W."""
    ids = table(spark, sf, "utt_index", "id").distinct().filter(F.col("id").rlike("/JA_.*_W[0-9]+$"))
    return ids.select("id", F.regexp_extract("id", "/JA_(.*)_W[0-9]+$", 1).alias("video"))


@query("select teacher_file, split_part(teacher_file, '/', -1) as stem, count(*) as n from selection group by 1, 2")
def rule14_stem(spark, sf):
    """What follows the last slash."""
    return table(spark, sf, "selection", "teacher_file").groupBy("teacher_file", F.substring_index("teacher_file", "/", -1).alias("stem")).agg(F.count("*").alias("n"))


@query(f"select path, cast({crc32_sql('path')} % 4 as integer) as lane from (select distinct path from shard_manifest where path is not null)")
def rule15_lanes(spark, sf):
    """A stateless lane for each path, from its checksum."""
    paths = table(spark, sf, "shard_manifest", "path").filter("path is not null").distinct()
    return paths.select("path", F.pmod(F.crc32("path"), F.lit(4)).cast("int").alias("lane"))


# ------------------------------------------------------------------------------- counts over the selection


@query(BASE_SQL + "select source, split, reason, count(*) as n, round(sum(cast(duration as decimal(12, 3))) / 3600.0, 6) as hours from base group by 1, 2, 3")
def a01_counts_hours(spark, sf):
    """Rows and hours by source, split and reason."""
    hours = F.round(F.sum(F.col("duration").cast("decimal(12,3)")).cast("double") / 3600.0, 6)
    return base_cascade(spark, sf).groupBy("source", "split", "reason").agg(F.count("*").alias("n"), hours.alias("hours"))


@query(BASE_SQL + """select coalesce(source, 'all') as source, count(*) as n_all, count(*) filter (reason not in ('truncated')) as n_whole,
 count(*) filter (reason not in ('truncated', 'not_judged', 'no_agree')) as n_judged, count(*) filter (reason = 'kept' or reason = 'no_audio') as n_agreeing, count(*) filter (reason = 'kept') as n_kept
 from base group by rollup (source)""")
def a02_funnel(spark, sf):
    """Rows that survive each stage, per source and in all."""
    alive = lambda c: F.count_if(c)
    r = F.col("reason")
    out = base_cascade(spark, sf).rollup("source").agg(
        F.count("*").alias("n_all"),
        alive(r != "truncated").alias("n_whole"),
        alive(~r.isin("truncated", "not_judged", "no_agree")).alias("n_judged"),
        alive(r.isin("kept", "no_audio")).alias("n_agreeing"),
        alive(r == "kept").alias("n_kept"),
    )
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


@query("select source, split, array_to_string(list(reason || '=' || n order by reason), ',') as reasons from (select source, split, reason, count(*) as n from selection where snap = 2 group by 1, 2, 3) group by 1, 2")
def a03_reason_histogram(spark, sf):
    """Counts by reason as one key-sorted value."""
    n = table(spark, sf, "selection", "snap", "source", "split", "reason").filter("snap = 2").groupBy("source", "split", "reason").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return n.groupBy("source", "split").agg(F.array_join(F.transform(pairs, lambda x: F.concat(x.reason, F.lit("="), x.n.cast("string"))), ",").alias("reasons"))


@query(f"""select source, split, count(*) as n, count(*) filter (j.id is null) as n_missing, round(count(*) filter (j.id is null) / count(*), 6) as share_missing
 from {UTT} u left join (select distinct id from second_opinion) j using (id) group by 1, 2 having count(*) filter (j.id is null) > 0.001 * count(*)""")
def a04_coverage_gate(spark, sf):
    """Groups whose share of rows without a verdict is over 0.1 %."""
    u = rows.present(utterances(spark, sf, "id", "source", "split"), table(spark, sf, "second_opinion", "id"), ["id"], "seen")
    out = u.groupBy("source", "split").agg(F.count("*").alias("n"), F.count_if(~F.col("seen")).alias("n_missing"))
    return out.filter("n_missing > 0.001 * n").withColumn("share_missing", F.round(F.col("n_missing") / F.col("n"), 6))


@query("""select source, round(quantile_cont(cast(agree as double), 0.5), 6) as q50, round(quantile_cont(cast(agree as double), 0.9), 6) as q90, round(quantile_cont(cast(agree as double), 0.99), 6) as q99 from utt_index where agree is not null group by source""")
def a05_exact_quantiles(spark, sf):
    """Exact quantiles with linear interpolation."""
    return st.exact_quantiles(table(spark, sf, "utt_index", "source", "agree"), ["source"], "agree", {"q50": 0.5, "q90": 0.9, "q99": 0.99})


@query("""with u as (select min(coalesce(value, 0)) as lo, max(coalesce(value, 0)) as hi from run_scalar where value is not null),
 b as (select tag, least(64, 1 + cast(floor((value - lo) / (hi - lo) * 64) as bigint)) as bin from run_scalar, u where value is not null)
 select tag, bin, count(*) as n from b group by 1, 2""")
def a06_bins(spark, sf):
    """64 equal-width bins, the upper edge in the last."""
    df = table(spark, sf, "run_scalar", "tag", "value").filter("value is not null")
    edges = df.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.least(F.lit(64).cast("bigint"), 1 + F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 64))
    return df.crossJoin(edges).groupBy("tag", place.alias("bin")).agg(F.count("*").alias("n"))


@query("""select tag, count(value) as n, count(nf) as n_nonfinite, round(min(value), 6) as lo, round(max(value), 6) as hi, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(quantile_cont(value, 0.5), 6) as median from run_scalar group by tag""")
def a06_summary(spark, sf):
    """Distribution summary; values that aren't finite are counted apart."""
    r = lambda c: F.round(c, 6)
    v = F.col("value")
    df = table(spark, sf, "run_scalar", "tag", "value", "nf")
    plain = df.groupBy("tag").agg(F.count("value").alias("n"), F.count("nf").alias("n_nonfinite"), r(F.min(v)).alias("lo"), r(F.max(v)).alias("hi"), r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("sd"))
    median = st.exact_quantiles(df, ["tag"], "value", {"median": 0.5}).withColumnRenamed("tag", "of")
    return plain.join(median, F.col("tag").eqNullSafe(F.col("of")), "left").drop("of")


@query("""select tag, round(quantile_cont(value, 0.01), 6) as p1, round(quantile_cont(value, 0.05), 6) as p5, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75,
 round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from run_scalar group by tag""")
def a06_quantiles(spark, sf):
    """The seven quantiles of the summary, exact."""
    return st.exact_quantiles(table(spark, sf, "run_scalar", "tag", "value"), ["tag"], "value", {f"p{q}": q / 100 for q in (1, 5, 25, 50, 75, 95, 99)})


@query(f"select source, sha256(array_to_string(list(id order by row_no, id), chr(10))) as digest, count(*) as n from {UTT} group by source")
def a32_id_digest(spark, sf):
    """One digest of the ids of a source in store order."""
    return sequence.ordered_digest(utterances(spark, sf, "id", "source", "row_no"), ["source"], ["row_no", "id"], "id")


@query("select coalesce(source, 'none') as source, count(*) filter (split = 'train') as train, count(*) filter (split = 'dev') as dev, count(*) filter (split = 'eval') as eval from utt_index group by 1")
def a33_pivot(spark, sf):
    """Counts pivoted, absent cells 0."""
    df = table(spark, sf, "utt_index", "source", "split").withColumn("source", F.coalesce("source", F.lit("none")))
    return df.groupBy("source").pivot("split", ["train", "dev", "eval"]).count().na.fill(0)


@query("""with m as (select *, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest), f as (select * from m where rn = 1 and split = 'train'),
 c as (select source, path, n_hours, row_number() over (partition by source order by path) as cap from f)
 select source, cap, round(sum(coalesce(n_hours, 0)) over (partition by source order by cap), 6) as hours from c""")
def a30_pool_by_cap(spark, sf):
    """Hours a source would have, had it been cut at its first n inputs."""
    m = rows.first_rows(table(spark, sf, "shard_manifest"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")]).filter("split = 'train'")
    m = m.select("source", "path", F.lit(1).cast("bigint").alias("one"), F.coalesce("n_hours", F.lit(0.0)).alias("h"))
    m = sequence.running_total(m, ["path"], "one", "cap", ["source"]).drop("one")
    m = sequence.running_total(m, ["path"], "h", "hours", ["source"])
    return m.select("source", "cap", F.round("hours", 6).alias("hours"))


@query("""select split, count(*) as n, round(avg(cast(n_tok as double)) / 20.0 - 1, 6) as drift, abs(avg(cast(n_tok as double)) / 20.0 - 1) > 0.05 as fires from utt_index where split is not null group by split""")
def a26_mean_drift(spark, sf):
    """Mean against a registered value."""
    drift = F.avg(F.col("n_tok").cast("double")) / 20.0 - 1
    return table(spark, sf, "utt_index", "split", "n_tok").filter("split is not null").groupBy("split").agg(F.count("*").alias("n"), F.round(drift, 6).alias("drift"), (F.abs(drift) > 0.05).alias("fires"))


@query("""select split, count(*) as n, count(*) filter (n_tok > duration * 20) as n_mismatched, round(count(*) filter (n_tok > duration * 20) / count(*), 6) as share from utt_index where split is not null group by split""")
def a27_mismatch_report(spark, sf):
    """Rows of each split that break a length relation."""
    bad = F.count_if(F.col("n_tok") > F.col("duration") * 20)
    return table(spark, sf, "utt_index", "split", "n_tok", "duration").filter("split is not null").groupBy("split").agg(F.count("*").alias("n"), bad.alias("n_mismatched"), F.round(bad / F.count("*"), 6).alias("share"))


QUERIES, SQL = query.queries, query.sql
