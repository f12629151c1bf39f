"""Scoring queries: error rates, their breakdown, pooled and resampled summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import scoring
from gleaner.operators import statistics as st
from gleaner.plans.registry import Registry
from gleaner.plans.selection import JUDGED, UTT, judged, plain, plain_sql, utterances
from gleaner.session import table

query = Registry()


@query("""with a as (select id, regexp_replace(lower(coalesce(ref, '')), '[^a-z0-9]', '', 'g') as r, regexp_replace(lower(coalesce(hyp, '')), '[^a-z0-9]', '', 'g') as h from utt_index)
 select distinct id, cast(levenshtein(h, r) as integer) as edits, round(case when length(r) = 0 then case when length(h) = 0 then 0.0 else 1.0 end when length(h) = 0 then 1.0 else levenshtein(h, r) / length(r) end, 6) as rate from a""")
def e02_ascii_rate(spark, sf):
    """E02 on the ASCII letters and digits, where both engines count the same."""
    ascii_only = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    df = table(spark, sf, "utt_index", "id", "ref", "hyp").select("id", ascii_only("ref").alias("r"), ascii_only("hyp").alias("h"))
    edits = F.levenshtein("h", "r")
    return df.select("id", edits.alias("edits"), F.round(scoring.error_rate(edits, F.length("r"), F.length("h")), 6).alias("rate")).distinct()


CLASS_SQL = "case when regexp_matches(c, '^[ぁ-ゟ]$') then 'H' when regexp_matches(c, '^[゠-ヿㇰ-ㇿ]$') then 'K' when regexp_matches(c, '^[0-9]$') then 'D' when regexp_matches(c, '^[a-z]$') then 'L' when regexp_matches(c, '^[一-鿿㐀-䶿々〆〇豈-﫿𠀀-􏿿]$') then 'J' else 'O' end"


@query(f"select source, {CLASS_SQL} as kind, count(*) as n from (select source, unnest(string_split(lower(ref), '')) as c from utt_index where length(ref) > 0) group by 1, 2")
def e06_char_classes(spark, sf):
    """Characters of the references by class."""
    chars = table(spark, sf, "utt_index", "source", "ref").select("source", F.explode(F.split(F.lower("ref"), "")).alias("c")).filter("c != ''")
    return chars.groupBy("source", "c").agg(F.count("*").alias("m")).groupBy("source", scoring.char_class(F.col("c")).alias("kind")).agg(F.sum("m").alias("n"))


KATA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRA = "".join(map(chr, range(0x3041, 0x3097)))


@query(f"select id, translate(ref, '{KATA}', '{HIRA}') as folded from {UTT} where ref is not null")
def e07_kana_folding(spark, sf):
    """Katakana as hiragana."""
    return utterances(spark, sf, "id", "ref").filter("ref is not null").select("id", scoring.hiragana(F.col("ref")).alias("folded"))


@query(f"select id, cast(len(regexp_extract_all(ref, '[一-鿿㐀-䶿々〆]')) as integer) as n_kanji, regexp_matches(ref, '（[^）]*）|\\([^)]*\\)|\\[[^\\]]*\\]|【[^】]*】') as bracketed from {UTT} where ref is not null")
def e09_kanji_brackets(spark, sf):
    """Kanji count and bracketed spans."""
    df = utterances(spark, sf, "id", "ref").filter("ref is not null")
    return df.select("id", F.regexp_count("ref", F.lit(scoring.KANJI)).alias("n_kanji"), F.col("ref").rlike(scoring.BRACKETED).alias("bracketed"))


@query(f"""with u as (select id, {plain_sql('ref')} as r, {plain_sql('hyp')} as h from {UTT}), p as (select unnest(['もちろん', 'ありがとう', 'そうです']) as phrase)
 select phrase, count(*) as n from u, p where contains(h, phrase) and not contains(r, phrase) group by phrase""")
def e10_phrases(spark, sf):
    """Phrases in the output that the reference doesn't hold."""
    df = utterances(spark, sf, "id", "ref", "hyp").select(plain(F.col("ref")).alias("r"), plain(F.col("hyp")).alias("h"))
    found = [F.count_if(F.contains("h", F.lit(p)) & ~F.contains("r", F.lit(p))).alias(p) for p in ("もちろん", "ありがとう", "そうです")]
    n = df.agg(*found).unpivot([], ["もちろん", "ありがとう", "そうです"], "phrase", "n")
    return n.filter("n > 0")


@query(f"""with s as (select source, coalesce(length(ref), 0) as l, round(coalesce(teacher_cer, 0) * coalesce(length(ref), 0)) as e from {UTT})
 select coalesce(source, 'all') as source, count(*) as n, count(*) filter (l = 0) as n_empty, round(sum(e) filter (l > 0) / sum(l) filter (l > 0), 6) as rate from s group by rollup (source)""")
def a09_stored_rate(spark, sf):
    """A07, A09 from stored rates: the corpus rate isn't the mean of the rates."""
    df = utterances(spark, sf, "source", "ref", "teacher_cer").select("source", F.coalesce(F.length("ref"), F.lit(0)).alias("l"), F.round(F.coalesce(F.col("teacher_cer"), F.lit(0.0).cast("float")) * F.coalesce(F.length("ref"), F.lit(0))).alias("e"))
    out = df.rollup("source").agg(F.count("*").alias("n"), F.count_if(F.col("l") == 0).alias("n_empty"), st.ratio(F.sum(F.when(F.col("l") > 0, F.col("e"))), F.sum(F.when(F.col("l") > 0, F.col("l")))).alias("rate"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


@query(f"""with v as (select id from {UTT} where in_greedy_subset), s as (select source, coalesce(length(ref), 0) as l, round(coalesce(teacher_cer, 0) * coalesce(length(ref), 0)) as e from {UTT} semi join v using (id))
 select source, count(*) as n, round(sum(e) filter (l > 0) / sum(l) filter (l > 0), 6) as rate from s group by source""")
def a08_view_rate(spark, sf):
    """The rate over the ids of a view."""
    u = utterances(spark, sf, "id", "source", "ref", "teacher_cer", "in_greedy_subset")
    view = u.filter("in_greedy_subset").select("id")
    s = u.join(view, "id", "left_semi").withColumn("l", F.coalesce(F.length("ref"), F.lit(0))).withColumn("e", F.round(F.coalesce(F.col("teacher_cer"), F.lit(0.0).cast("float")) * F.col("l")))
    return s.groupBy("source").agg(F.count("*").alias("n"), st.ratio(F.sum(F.when(F.col("l") > 0, F.col("e"))), F.sum(F.when(F.col("l") > 0, F.col("l")))).alias("rate"))


@query("""select source, sum(cast(n_tok as bigint))::bigint as n_tok, round(sum(cast(kl as double) * n_tok) / sum(n_tok) filter (kl is not null), 6) as kl, round(sum(cast(ce as double) * n_tok) / sum(n_tok) filter (ce is not null), 6) as ce, round(avg(cast(top1_acc as double)), 6) as top1 from trained_utt group by source""")
def a10_weighted_ratios(spark, sf):
    """Token-weighted sums over tokens beside plain means."""
    df = table(spark, sf, "trained_utt", "source", "n_tok", "kl", "ce", "top1_acc")
    weighted = lambda c: st.ratio(F.sum(F.col(c).cast("double") * F.col("n_tok")), F.sum(F.when(F.col(c).isNotNull(), F.col("n_tok"))))
    return df.groupBy("source").agg(F.sum("n_tok").alias("n_tok"), weighted("kl").alias("kl"), weighted("ce").alias("ce"), F.round(F.avg(F.col("top1_acc").cast("double")), 6).alias("top1"))


@query("""select epoch, round(sum(cast(masked_frac as double) * n_tok) / sum(n_tok), 6) as masked, round(sum(cast(kl as double)) / nullif(sum(case when masked_frac > 0.2 then n_tok end), 0), 6) as kl_per_masked, round(count(agree) / count(*), 6) as judged from trained_utt group by epoch""")
def a11_other_denominators(spark, sf):
    """Ratios with denominators of their own, null where one is 0."""
    df = table(spark, sf, "trained_utt", "epoch", "masked_frac", "n_tok", "kl", "agree")
    n = F.col("n_tok")
    return df.groupBy("epoch").agg(
        st.ratio(F.sum(F.col("masked_frac").cast("double") * n), F.sum(n)).alias("masked"),
        st.ratio(F.sum(F.col("kl").cast("double")), F.sum(F.when(F.col("masked_frac") > 0.2, n))).alias("kl_per_masked"),
        st.ratio(F.count("agree"), F.count("*")).alias("judged"),
    )


@query("""with s as (select source, sum(cast(kl as double) * n_tok) as k, sum(cast(ce as double) * n_tok) as c, sum(n_tok) as n from trained_utt where kl is not null and ce is not null group by source),
 g as (select *, source like 'eval_%' as gate from s), p as (select * from g where gate or not (select bool_or(gate) from g))
 select count(*) as n_sets, round((0.7 * sum(k) + 0.3 * sum(c)) / greatest(sum(n), 1), 6) as objective from p""")
def a13_objective(spark, sf):
    """A weighted objective over the gate sets, over all sets if none is one."""
    df = table(spark, sf, "trained_utt", "source", "kl", "ce", "n_tok").filter("kl is not null and ce is not null")
    s = df.groupBy("source").agg(F.sum(F.col("kl").cast("double") * F.col("n_tok")).alias("k"), F.sum(F.col("ce").cast("double") * F.col("n_tok")).alias("c"), F.sum("n_tok").alias("n"))
    s = s.withColumn("gate", F.col("source").startswith("eval_"))
    s = s.crossJoin(s.agg(F.bool_or("gate").alias("any_gate"))).filter("gate or not any_gate")
    return s.agg(F.count("*").alias("n_sets"), F.round((0.7 * F.sum("k") + 0.3 * F.sum("c")) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("objective"))


@query(f"""with s as (select source, avg(cast(teacher_cer as double)) as r from {UTT} where split = 'eval' group by source)
 select case when count(r) = 6 then round(avg(r), 6) end as macro from s where source in ('eval_crowd', 'eval_read', 'eval_tv', 'eval_web', 'pod_nc', 'vn_voice')""")
def a14_macro_mean(spark, sf):
    """Unweighted mean over named strata, none if one is missing."""
    names = ("eval_crowd", "eval_read", "eval_tv", "eval_web", "pod_nc", "vn_voice")
    s = utterances(spark, sf, "source", "split", "teacher_cer").filter("split = 'eval'").filter(F.col("source").isin(*names)).groupBy("source").agg(F.avg(F.col("teacher_cer").cast("double")).alias("r"))
    return s.agg(F.when(F.count("r") == len(names), F.round(F.avg("r"), 6)).alias("macro"))


@query(f"""with u as (select source, duration, truncated, coalesce(ref, '') as r, coalesce(hyp, '') as h from {UTT})
 select source, count(*) filter (length(r) > 0) as n, count(*) filter (length(r) > 0 and length(h) = 0) as n_empty, count(*) filter (length(r) > 0 and length(h) > 2 * length(r)) as n_runaway,
 count(*) filter (length(r) > 0 and truncated) as n_truncated, count(*) filter (length(r) > 0 and duration < cast(2 as float)) as n_short, count(*) filter (length(r) = 0 and length(h) > 0) as n_on_empty from u group by source""")
def a19_event_counts(spark, sf):
    """Rows of each set with an odd output."""
    u = utterances(spark, sf, "source", "duration", "truncated", "ref", "hyp")
    r, h = F.length(F.coalesce("ref", F.lit(""))), F.length(F.coalesce("hyp", F.lit("")))
    held = r > 0
    return u.groupBy("source").agg(
        F.count_if(held).alias("n"),
        F.count_if(held & (h == 0)).alias("n_empty"),
        F.count_if(held & (h > 2 * r)).alias("n_runaway"),
        F.count_if(held & F.col("truncated")).alias("n_truncated"),
        F.count_if(held & (F.col("duration") < F.lit(2).cast("float"))).alias("n_short"),
        F.count_if((r == 0) & (h > 0)).alias("n_on_empty"),
    )


@query(f"""with k as (select source, len(regexp_extract_all(coalesce(ref, ''), '[一-鿿㐀-䶿々〆]')) as nr, len(regexp_extract_all(coalesce(hyp, ''), '[一-鿿㐀-䶿々〆]')) as nh, length(coalesce(hyp, '')) as l from {UTT})
 select source, count(*) filter (nr >= 3) as eligible, count(*) filter (nr >= 3 and l > 0 and nh = 0) as n, round(count(*) filter (nr >= 3 and l > 0 and nh = 0) / nullif(count(*) filter (nr >= 3), 0), 6) as rate from k group by source""")
def a20_rate_over_eligible(spark, sf):
    """Outputs without kanji among references with three or more."""
    kanji = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(scoring.KANJI))
    u = utterances(spark, sf, "source", "ref", "hyp").select("source", kanji("ref").alias("nr"), kanji("hyp").alias("nh"), F.length(F.coalesce("hyp", F.lit(""))).alias("l"))
    n, eligible = F.count_if(F.expr("nr >= 3 and l > 0 and nh = 0")), F.count_if(F.col("nr") >= 3)
    return u.groupBy("source").agg(eligible.alias("eligible"), n.alias("n"), st.ratio(n, eligible).alias("rate"))


@query("""select run_key, round(quantile_cont(d, 0.5), 6) as p50, round(quantile_cont(d, 0.95), 6) as p95, round(avg(d), 6) as mean from (select run_key, elapsed_s - lag(elapsed_s) over (partition by run_key order by wall, step, tag, elapsed_s) as d from run_scalar where run_key is not null) where d is not null group by run_key""")
def a23_latency(spark, sf):
    """Percentiles of the seconds between log rows."""
    from pyspark.sql import Window as W

    w = W.partitionBy("run_key").orderBy("wall", "step", "tag", "elapsed_s")
    df = table(spark, sf, "run_scalar", "run_key", "wall", "step", "tag", "elapsed_s").filter("run_key is not null").withColumn("d", F.col("elapsed_s") - F.lag("elapsed_s").over(w)).filter("d is not null")
    mean = df.groupBy("run_key").agg(F.round(F.avg("d"), 6).alias("mean"))
    return st.exact_quantiles(df, ["run_key"], "d", {"p50": 0.5, "p95": 0.95}).join(mean, "run_key")


@query("""with t as (select tag, run_key, sum(value) as total, count(*) as n from run_scalar where value is not null group by 1, 2), s as (select *, round(total / sum(total) over (partition by run_key), 6) as share, row_number() over (partition by run_key order by total desc, tag) as rank from t)
 select run_key, tag, n, share, rank from s where rank <= 3""")
def a24_roll_up(spark, sf):
    """Totals by name, their shares, the top three of each run."""
    from pyspark.sql import Window as W

    t = table(spark, sf, "run_scalar", "tag", "run_key", "value").filter("value is not null").groupBy("tag", "run_key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    w = W.partitionBy("run_key")
    t = t.withColumn("share", F.round(F.col("total") / F.sum("total").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), "tag")).cast("bigint"))
    return t.filter("rank <= 3").select("run_key", "tag", "n", "share", "rank")


@query(f"""with s as (select split, avg(agree) as a, count(*) as n from (select split, cast(j.agree as double) as agree from {UTT} u join {JUDGED} j using (id) where split is not null) group by split),
 base as (select * from (values ('train', 0.1), ('dev', 0.1), ('eval', 0.1)) t(split, want)) select split, n, round(a, 6) as got, abs(a - want) <= 0.05 as passes from s join base using (split)""")
def a34_drift_gate(spark, sf):
    """Recomputed values against registered ones."""
    want = spark.createDataFrame([("train", 0.1), ("dev", 0.1), ("eval", 0.1)], "split string, want double")
    s = utterances(spark, sf, "id", "split").filter("split is not null").join(judged(spark, sf, "id", "agree"), "id").groupBy("split").agg(F.avg(F.col("agree").cast("double")).alias("a"), F.count("*").alias("n"))
    return s.join(want, "split").select("split", "n", F.round("a", 6).alias("got"), (F.abs(F.col("a") - F.col("want")) <= 0.05).alias("passes"))


QUERIES, SQL = query.queries, query.sql
