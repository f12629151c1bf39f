"""Verdicts on runs, the table of systems on offer, and a run's tables for export."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import verdict
from gleaner.operators import statistics as st
from gleaner.plans.fragments import distance_sql
from gleaner.plans.ingest import folder
from gleaner.plans.registry import Registry
from gleaner.plans.reports import r05_long_table
from gleaner.plans.runs import LOG, log, w20_superseded
from gleaner.plans.selection import RENAMES, UTT
from gleaner.plans.texts import TWO, normal_sql, two_systems
from gleaner.session import table
from gleaner.sources import files

query = Registry()

VARIANTS = 12
HISTORY_SQL = f"""b as (select run_key, step // 8 as b, avg(value) filter (tag = 'eval/dev/kl') as held, avg(value) filter (tag = 'train/loss') as probe, avg(value) filter (tag = 'eval/dev/top1') as rate, avg(value) filter (tag = 'train/lr') as rate_full from {LOG} group by 1, 2),
 history as (select run_key || '/' || v as run, b * 8 as step, b / 6.0 as epoch, case when b < 2 then 'warm-up' when b < 26 then 'stable' else 'cooldown' end as phase, rate * (1 + (v % 3 - 1) * b / 40.0) as rate, case when v % 2 = 0 then rate_full * (1 - (v % 4) * b / 99.0) end as rate_full, held * (1 + (v % 4) * b / 200.0) as held, probe * (1 - (v % 5) * b / 99.0) as probe
 from b, range(0, {VARIANTS}) t(v) where v < {VARIANTS - 1} or b < 2),
 final as (select run_key || '/' || v as run, s as set, 1 + ((v + s) % 5) * 0.12 as student, case when v = 7 then 0.0 else 1.0 end as teacher, 1000 as n, case when v % 6 = 5 then 9 else 2 end as n_truncated from (select distinct run_key from {LOG}), range(0, {VARIANTS}) t(v), range(0, 3) u(s))"""


def _history(spark, sf):
    """Evaluations of runs with several trends, and final rates at several distances from the teacher's."""
    of = lambda t: F.avg(F.when(F.col("tag") == t, F.col("value")))
    df = log(spark, sf, "run_key", "tag", "step", "value")
    b = df.groupBy("run_key", F.expr("step div 8").alias("b")).agg(of("eval/dev/kl").alias("held"), of("train/loss").alias("probe"), of("eval/dev/top1").alias("rate"), of("train/lr").alias("rate_full"))
    v, k = F.col("v"), F.col("b")
    variants = spark.range(VARIANTS).select(F.col("id").alias("v"))
    h = b.crossJoin(variants).filter(f"v < {VARIANTS - 1} or b < 2")
    run = F.concat("run_key", F.lit("/"), F.col("v").cast("string")).alias("run")
    phase = F.when(k < 2, "warm-up").when(k < 26, "stable").otherwise("cooldown")
    history = h.select(
        run, (k * 8).alias("step"), (k / 6.0).alias("epoch"), phase.alias("phase"), (F.col("rate") * (1 + (v % 3 - 1) * k / 40.0)).alias("rate"), F.when(v % 2 == 0, F.col("rate_full") * (1 - (v % 4) * k / 99.0)).alias("rate_full"),
        (F.col("held") * (1 + (v % 4) * k / 200.0)).alias("held"), (F.col("probe") * (1 - (v % 5) * k / 99.0)).alias("probe"),
    )
    final = df.select("run_key").distinct().crossJoin(variants).crossJoin(spark.range(3).select(F.col("id").alias("s")))
    final = final.select(run, F.col("s").alias("set"), (1 + ((v + F.col("s")) % 5) * 0.12).alias("student"), F.when(v == 7, 0.0).otherwise(1.0).alias("teacher"), F.lit(1000).alias("n"), F.when(v % 6 == 5, 9).otherwise(2).alias("n_truncated"))
    return history, final


def _change_sql(y: str, within: str, scale: str | None = None, least: int = 2) -> str:
    held = f"({within}) and {y} is not null"
    size = f"avg(abs({y})) filter ({held})" if scale is None else f"avg(abs({scale})) filter ({within})"
    return f"case when count(distinct step) filter ({held}) >= 2 and count(*) filter ({held}) >= {least} then regr_slope({y}, step) filter ({held}) * (max(step) filter ({held}) - min(step) filter ({held})) / nullif({size}, 0) end"


def _verdict_sql(version: int) -> str:
    rank = "row_number() over (partition by run order by step desc)"
    if version == 1:
        windows = f"w as (select *, {rank} <= greatest(3, ceil(0.2 * count(*) over (partition by run))) as in_window, {rank} <= greatest(3, ceil(0.2 * count(*) over (partition by run))) as of_rate, rate as r from history where step > 0)"
    else:
        windows = f"""hk as (select *, row_number() over (partition by run order by step) as k from history where step > 0),
 th as (select *, true as kept, epoch as last from hk where k = 1 union all select hk.*, hk.epoch - th.last >= 0.25, case when hk.epoch - th.last >= 0.25 then hk.epoch else th.last end from th join hk on hk.run = th.run and hk.k = th.k + 1),
 kp as (select *, {rank} <= greatest(3, ceil(0.2 * count(*) over (partition by run))) as in_window from th where kept),
 sb as (select run, step, {rank} <= greatest(3, ceil(0.2 * count(*) over (partition by run))) as in_tail, count(*) over (partition by run) as m from kp where phase = 'stable'),
 wr as (select kp.*, coalesce(in_tail and m >= 3, false) as of_rate from kp left join sb using (run, step)), cp as (select run, bool_and(rate_full is not null) filter (of_rate) as complete from wr group by run),
 w as (select wr.*, case when complete then rate_full else rate end as r from wr join cp using (run))"""
    return f"""with recursive {HISTORY_SQL}, {windows},
 tr as (select run, {_change_sql('r', 'of_rate', least=3 if version == 2 else 2)} as rate_change, {_change_sql('held', 'in_window')} as held_change, {_change_sql('probe', 'in_window')} as probe_change, {_change_sql('(held - probe)', 'in_window', 'held')} as gap_change from w group by run),
 fs as (select run, count(*) filter (q <= 1.2) as n_go, count(*) filter (q <= 1.5) as n_promising, sum(n_truncated) / sum(n) as truncated from (select *, case when teacher > 0 then student / teacher when student = 0 then 0 else 'inf'::double end as q from final) group by run),
 a as (select run, coalesce(n_go, 0) as n_go, coalesce(n_promising, 0) as n_promising, rate_change, held_change, probe_change, gap_change, truncated, coalesce(rate_change <= -0.01, false) as better, coalesce(probe_change < -0.01 and held_change > 0.01, false) as over, coalesce(truncated <= 0.005, false) and coalesce(gap_change <= 0.02, false) as passes from tr full join fs using (run)),
 d as (select *, case when over then 'NO-GO' when n_go >= 2 and passes then 'GO' when n_promising >= 2 and better then 'PROMISING' when n_promising < 2 and rate_change is not null and not better then 'NO-GO' else 'INCONCLUSIVE' end as verdict from a)
 select run, n_go, n_promising, round(rate_change, 6) as rate_change, round(held_change, 6) as held_change, round(probe_change, 6) as probe_change, round(gap_change, 6) as gap_change, round(truncated, 6) as truncated, verdict,
 case when over then 'over-fitting' when verdict = 'GO' then 'within reach' when verdict = 'PROMISING' then 'still improving' when verdict = 'NO-GO' then 'out of reach and flat' when rate_change is null then 'trend unknown' when n_promising >= 2 then 'within reach but flat' else 'out of reach but improving' end as reason from d"""


@query(_verdict_sql(1))
def r02_verdict(spark, sf):
    """The verdict of each run, first version: the trends of its last evaluations."""
    return verdict.verdicts(*_history(spark, sf), version=1)


@query(_verdict_sql(2))
def r02_verdict_stable(spark, sf):
    """Second version: near-repeated evaluations left out, the rate's trend from before the cool-down."""
    return verdict.verdicts(*_history(spark, sf), version=2)


BLOCKS = 10


@query(f"""with {normal_sql(TWO)}, w as (select split_part(key, chr(1), 1) as id, split_part(key, chr(1), 2) as system, text from nf), p as (select a.id, a.system, b.text as r, a.text as h from w a join w b on a.id = b.id and b.system = 'r' where a.system != 'r'),
 s as (select u.source, p.id, system, {distance_sql('r', 'h')} as num, length(r) as den, cast(('0x' || substr(sha256('block' || p.id), 1, 8)) as bigint) % {BLOCKS} as block from p join {UTT} u using (id)),
 pooled as (select system, sum(num) / sum(den) as pooled, count(*) as n from s group by system), macro as (select system, avg(r) as macro, max_by(source, r) as worst from (select system, source, sum(num) / sum(den) as r from s where source like 'eval_%' group by 1, 2) group by system),
 lo as (select k as replicate, system, sum(num) / sum(den) as r from s, range(0, {BLOCKS}) t(k) where block != k group by 1, 2), d as (select ln(a.r) - ln(b.r) as d from lo a join lo b using (replicate) where a.system = 'first' and b.system = 'second'), v as (select sqrt(var_samp(d) * {(BLOCKS - 1) ** 2 / BLOCKS} + 0.0001) as se from d),
 q as (select (select pooled from pooled where system = 'first') / (select pooled from pooled where system = 'second') as ratio)
 select system, case system when 'second' then 1 else 2 end as place, n, round(pooled, 6) as pooled, round(macro, 6) as macro, worst, case when system = 'first' then round(ratio, 6) end as vs_second, case when system = 'first' then round(exp(ln(ratio) - 1.9599640 * se), 6) end as low, case when system = 'first' then round(exp(ln(ratio) + 1.9599640 * se), 6) end as high,
 case when system = 'first' then case when exp(ln(ratio) + 1.9599640 * se) < 1 then 'better' when exp(ln(ratio) - 1.9599640 * se) > 1 then 'worse' else 'within' end end as verdict from pooled join macro using (system), v, q""")
def r01_systems(spark, sf):
    """One row for each system: pooled and macro rate, the worst set, and the ratio to the other with its interval.

    The interval comes from leaving out one of ten hash blocks of rows at a time, and the noise of a run.
    """
    block = F.conv(F.substring(F.sha2(F.concat(F.lit("block"), "id"), 256), 1, 8), 16, 10).cast("bigint") % BLOCKS
    s = two_systems(spark, sf).groupBy("stratum", "system", block.alias("block")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.count("*").alias("n"))
    pooled = s.groupBy("system").agg((F.sum("num") / F.sum("den")).alias("pooled"), F.sum("n").alias("n"))
    by_set = s.filter("stratum like 'eval_%'").groupBy("system", "stratum").agg((F.sum("num") / F.sum("den")).alias("r"))
    macro = by_set.groupBy("system").agg(F.avg("r").alias("macro"), F.max_by("stratum", "r").alias("worst"))
    left_out = s.select(F.lit("all").alias("stratum"), "system", "num", "den", F.explode(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: k != F.col("block"))).alias("replicate"))
    ratio = st.compared(st.point_sums(s.withColumn("stratum", F.lit("all"))), left_out, "first", "second", noise=0.01, n_noisy=1, inflate=(BLOCKS - 1) ** 2 / BLOCKS)
    ratio = ratio.select(F.lit("first").alias("system"), F.col("ratio").alias("vs_second"), "low", "high", "verdict")
    return pooled.join(macro, "system").join(ratio, "system", "left").select("system", F.when(F.col("system") == "second", 1).otherwise(2).alias("place"), "n", F.round("pooled", 6).alias("pooled"), F.round("macro", 6).alias("macro"), "worst", "vs_second", "low", "high", "verdict")


@query(f"pivot (select run_key, step, tag, value from {LOG}) on tag using max(value) group by run_key, step")
def r04_wide_steps(spark, sf):
    """One row for each step with a column for each tag there is."""
    return log(spark, sf, "run_key", "step", "tag", "value").groupBy("run_key", "step").pivot("tag").agg(F.max("value"))


def run_tables(spark, sf) -> dict:
    """The tables of the runs, by name."""
    scalars = table(spark, sf, "run_scalar")
    flagged = w20_superseded(spark, sf).select("run_key", "tag", "step", "wall", "elapsed_s", "superseded").distinct()
    good = log(spark, sf, "run_key", "tag", "step", "value", "nf")
    target = None
    for pattern, to in RENAMES:
        done = F.regexp_replace("tag", pattern, to)
        target = F.when(F.col("tag").rlike(pattern), done) if target is None else target.when(F.col("tag").rlike(pattern), done)
    tags = scalars.filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n"), F.min("step").alias("first_step"))
    trained = table(spark, sf, "trained_utt", "id", "epoch", "step", "source", "n_tok", "kl")
    evals = good.filter("tag like 'eval/%'")
    return {
        "scalars": flagged,
        "steps": r04_wide_steps(spark, sf),
        "combined_loss": r05_long_table(spark, sf),
        "evals": evals,
        "eval_summaries": evals.groupBy("run_key", "tag").agg(F.count("value").alias("n"), F.min("value").alias("lowest"), F.max_by("value", "step").alias("last")),
        "train_utts": trained.distinct(),
        "train_steps": trained.groupBy("epoch", "step").agg(F.count("*").alias("n"), F.sum("n_tok").alias("n_tok")),
        "hist": good.filter("value is not null").groupBy("tag", F.floor(F.col("value") * 8).alias("bin")).agg(F.count("*").alias("n")),
        "nonfinite": scalars.filter("nf is not null").select("run_key", "tag", "step", "nf").distinct(),
        "tag_map": tags.withColumn("target", target.otherwise(F.concat(F.lit("3_misc/"), "tag"))),
        "runs": scalars.filter("run_key is not null").groupBy("run_key").agg(F.min("wall").alias("began"), F.max("wall").alias("ended"), F.max("step").alias("reach")),
    }


@query(f"""select 'scalars' as name, (select count(*) from (select distinct run_key, tag, step, wall, elapsed_s from run_scalar where run_key is not null)) as n_rows, cast(6 as integer) as n_columns union all select 'steps', (select count(*) from (select distinct run_key, step from {LOG})), cast(2 + (select count(distinct tag) from {LOG}) as integer)
 union all select 'combined_loss', (select count(*) from {LOG} where tag in ('train/loss', 'eval/dev/kl', 'eval/dev/top1') and value is not null), 5 union all select 'evals', (select count(*) from {LOG} where tag like 'eval/%'), 5
 union all select 'eval_summaries', (select count(*) from (select distinct run_key, tag from {LOG} where tag like 'eval/%')), 5 union all select 'train_utts', (select count(*) from (select distinct id, epoch, step, source, n_tok, kl from trained_utt)), 6
 union all select 'train_steps', (select count(*) from (select distinct epoch, step from trained_utt)), 4 union all select 'hist', (select count(*) from (select distinct tag, floor(value * 8) from {LOG} where value is not null)), 3
 union all select 'nonfinite', (select count(*) from (select distinct run_key, tag, step, nf from run_scalar where nf is not null)), 4 union all select 'tag_map', (select count(distinct tag) from run_scalar where tag is not null), 4 union all select 'runs', (select count(distinct run_key) from run_scalar where run_key is not null), 4""")
def r04_export(spark, sf):
    """All tables of the runs written as Parquet, and as CSV where they aren't too long, and what was written."""
    where, out = folder(spark, "export"), []
    for name, df in run_tables(spark, sf).items():
        files.export(df, f"{where}/{name}", 1_000_000)
        back = spark.read.parquet(f"{where}/{name}/parquet")
        out.append((name, back.count(), len(back.columns)))
    return spark.createDataFrame(out, "name string, n_rows bigint, n_columns int")


QUERIES, SQL = query.queries, query.sql
