"""Draws and batches that carry state from row to row, plans of epochs, early stopping.

In the SQL each fold is a recursive query over the row number within its key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import batches, rows, sequence
from gleaner.plans.registry import Registry
from gleaner.plans.runs import LOG, log
from gleaner.plans.selection import UTT, utterances

query = Registry()

MS_SQL = "cast(round(cast(duration as double) * 1000) as bigint)"


def milliseconds():
    """Whole numbers, so that sums don't depend on their order."""
    return F.round(F.col("duration").cast("double") * 1000).cast("bigint")


def hashed(tag: str):
    return F.sha2(F.concat(F.lit(tag), F.col("id")), 256)


@query(f"""with recursive u as (select source, id, {MS_SQL} as ms, row_number() over (partition by source order by sha256('fit' || id), id) as k from {UTT}),
 f as (select source, id, ms, k, ms <= 600000 as taken, case when ms <= 600000 then ms else 0 end as used from u where k = 1
 union all select u.source, u.id, u.ms, u.k, f.used + u.ms <= 600000, case when f.used + u.ms <= 600000 then f.used + u.ms else f.used end from f join u on u.source = f.source and u.k = f.k + 1)
 select source, id, ms from f where taken""")
def w10_skip_fit(spark, sf):
    """In hash order within each source, every row that still fits 600 seconds."""
    df = utterances(spark, sf, "id", "source", "duration").select("id", "source", milliseconds().alias("ms"), hashed("fit").alias("h"))
    return sequence.skip_fit(df, ["source"], ["h", "id"], "ms", 600_000).select("source", "id", "ms")


@query(f"""with u as (select source, id, {MS_SQL} as ms, sum({MS_SQL}) over (partition by source order by sha256('cap' || id), id rows unbounded preceding) as upto from {UTT})
 select source, id, row_number() over (partition by source order by id) as place from u where upto - ms < 300000""")
def t05_hash_cap(spark, sf):
    """Ids of each source in hash order until 300 seconds are reached, back in the order of ids."""
    df = utterances(spark, sf, "id", "source", "duration").select("id", "source", milliseconds().alias("ms"), hashed("cap").alias("h"))
    drawn = sequence.running_total(df, ["h", "id"], "ms", "upto", ["source"]).filter("upto - ms < 300000")
    return rows.numbered(drawn, ["source"], [F.col("id")], "place").select("source", "id", "place")


PATIENCE_SQL = f"""with recursive t as (select run_key, step, value, row_number() over (partition by run_key order by step) as k from {LOG} where tag = 'train/loss'),
 f as (select run_key, step, value, k, value as best, case when value is null then 1 else 0 end as since from t where k = 1
 union all select t.run_key, t.step, t.value, t.k, case when t.value is not null and (f.best is null or f.best - t.value > greatest(0.001, 0.01 * abs(f.best))) then t.value else f.best end,
 case when t.value is not null and (f.best is null or f.best - t.value > greatest(0.001, 0.01 * abs(f.best))) then 0 else f.since + 1 end from f join t on t.run_key = f.run_key and t.k = f.k + 1)
 select run_key, step, value, best, cast(since as integer) as since, cast(k as integer) as evals, case when k < 5 then null when value <= 0.8 then 'floor' when since >= 4 then 'patience' end as trigger from f"""


@query(PATIENCE_SQL)
def w13_patience(spark, sf):
    """Best so far, values since and the trigger to stop, run by run; missing values count against patience."""
    df = log(spark, sf, "run_key", "tag", "step", "value").filter("tag = 'train/loss'").select("run_key", "step", "value")
    return sequence.patience(df, ["run_key"], ["step"], "value", 4, 0.001, 0.01, 0.8, 5)


@query(f"""with recursive t as (select run_key, tag, step, value, row_number() over (partition by run_key, tag order by step) as k from {LOG}),
 f as (select run_key, tag, step, value, k, true as kept, step as last from t where k = 1
 union all select t.run_key, t.tag, t.step, t.value, t.k, t.step - f.last >= 5, case when t.step - f.last >= 5 then t.step else f.last end from f join t on t.run_key = f.run_key and t.tag = f.tag and t.k = f.k + 1)
 select run_key, tag, step, value from f where kept""")
def w15_thinned(spark, sf):
    """Records at least five steps after the last one kept."""
    return sequence.thinned(log(spark, sf, "run_key", "tag", "step", "value"), ["run_key", "tag"], ["step"], "step", 5)


POOLED_SQL = f"""u as (select id, {MS_SQL} as ms, n_tok, sha256('epoch' || id) as h from {UTT}), p as (select *, (sum(ms) over (order by h, id rows unbounded preceding) - ms) // 3600000 as pool from u)"""


def _pooled(spark, sf):
    """Utterances in hash order cut into pools of an hour, each of bounded size."""
    df = utterances(spark, sf, "id", "duration", "n_tok").select("id", milliseconds().alias("ms"), "n_tok", hashed("epoch").alias("h"))
    return batches.pools(df, ["h", "id"], "ms", 3_600_000)


@query(f"""with recursive {POOLED_SQL}, t as (select *, row_number() over (partition by pool order by h, id) as k from p),
 f as (select pool, id, k, 0 as chunk, case when ms >= 100000 then 0 else ms end as total, case when ms >= 100000 then 1 else 0 end as next from t where k = 1
 union all select t.pool, t.id, t.k, f.next, case when f.total + t.ms >= 100000 then 0 else f.total + t.ms end, case when f.total + t.ms >= 100000 then f.next + 1 else f.next end from f join t on t.pool = f.pool and t.k = f.k + 1)
 select cast(pool as bigint) as pool, id, chunk from f""")
def w22_chunks(spark, sf):
    """Chunks that close when their seconds reach a limit, within pools."""
    return sequence.chunked(_pooled(spark, sf), ["pool"], ["h", "id"], "ms", 100_000).select("pool", "id", "chunk")


def packed_sql(rows_: str, key: str, order: str, cap: int, tokens: int, name: str) -> str:
    """The greedy batches of ``rows_`` within ``key`` as two common table expressions."""
    full = f"greatest(f.ms_max, t.ms) * (f.n + 1) > {cap} or greatest(f.tok_max, t.n_tok) * (f.n + 1) > {tokens}"
    return f"""{name}_k as (select *, row_number() over (partition by {key} order by {order}) as k from {rows_}),
 {name} as (select *, 0 as batch, 1 as n, ms as ms_max, n_tok as tok_max from {name}_k where k = 1
 union all select t.*, case when {full} then f.batch + 1 else f.batch end, case when {full} then 1 else f.n + 1 end, case when {full} then t.ms else greatest(f.ms_max, t.ms) end, case when {full} then t.n_tok else greatest(f.tok_max, t.n_tok) end
 from {name} f join {name}_k t on t.{key} = f.{key} and t.k = f.k + 1)"""


@query(f"""with recursive {POOLED_SQL}, {packed_sql("p", "pool", "ms desc, id", 100000, 400, "b")} select cast(pool as bigint) as pool, batch, id, ms, n_tok from b""")
def w23_micro_batches(spark, sf):
    """Pools by running seconds, longest first, packed by padded seconds and padded tokens."""
    df = _pooled(spark, sf).withColumn("longest_first", -F.col("ms"))
    return sequence.packed_batches(df, ["pool"], ["longest_first", "id"], {"ms": 100_000, "n_tok": 400}).select("pool", "batch", "id", "ms", "n_tok")


@query(f"""with recursive u as (select id, {MS_SQL} as ms, n_tok, row_no, row_number() over (order by {MS_SQL} desc, row_no) as place from {UTT} where split in ('dev', 'eval')), p as (select *, (place - 1) // 2000 as pool from u),
 {packed_sql("p", "pool", "place", 400000, 1 << 40, "b")} select cast(pool as bigint) as pool, batch, id, ms from b""")
def w25_eval_batches(spark, sf):
    """Held-out rows by length and store order, the same in every run, in pools of 2,000 rows packed by padded seconds."""
    df = utterances(spark, sf, "id", "duration", "row_no", "split").filter("split in ('dev', 'eval')").select("id", milliseconds().alias("ms"), "row_no", F.lit(1).cast("bigint").alias("one"))
    df = batches.pools(df.withColumn("longest_first", -F.col("ms")), ["longest_first", "row_no"], "one", 2000)
    return sequence.packed_batches(df, ["pool"], ["longest_first", "row_no"], {"ms": 400_000}).select("pool", "batch", "id", "ms")


EPOCH_SQL = f"""with recursive w as (select id, {MS_SQL} as ms, cast(n_tok as bigint) as n_tok, case when source like 'eval_%' then 0.0 when source = 'tv_small' then 2.5 when source = 'web_talk' then 0.4 else 1.0 end as w from {UTT} where split = 'train'),
 c as (select *, cast(floor(w) + case when cast(('0x' || substr(sha256('rep1' || id), 1, 8)) as bigint) / 4294967296.0 < w - floor(w) then 1 else 0 end as bigint) as copies from w where w > 0),
 d as (select id, ms, n_tok, copy, sha256('order1|' || id || '|' || copy) as h from (select *, unnest(range(1, copies + 1)) as copy from c where copies > 0)),
 p as (select *, cast((sum(ms) over (order by h rows unbounded preceding) - ms) // 2000000 as bigint) as pool from d),
 {packed_sql("p", "pool", "ms desc, h", 100000, 400, "b")},
 m as (select pool, batch, sum(ms) as ms, sha256('micro1|' || pool || '|' || batch) as h from b group by pool, batch),
 l as (select *, cast((sum(ms) over (order by h rows unbounded preceding) - ms) // {400000 * 64} as bigint) as lane from m), lk as (select *, row_number() over (partition by lane order by h) as k from l),
 s as (select lane, k, pool, batch, 0 as step, ms as total from lk where k = 1
 union all select t.lane, t.k, t.pool, t.batch, case when s.total + t.ms / 2 > 400000 then s.step + 1 else s.step end, case when s.total + t.ms / 2 > 400000 then t.ms else s.total + t.ms end from s join lk t on t.lane = s.lane and t.k = s.k + 1),
 o as (select *, dense_rank() over (order by sha256('step1|' || lane || '|' || step)) as place from s),
 plan as (select o.place, b.pool, b.batch, b.id, b.copy, b.ms as size, b.n_tok as tokens from b join o on o.pool = b.pool and o.batch = b.batch),
 micro as (select place, pool, batch, count(*) as n, sum(size) as real, max(size) * count(*) as padded, sum(tokens) as tokens, max(tokens) * count(*) as padded_tokens, max(size) as longest from plan group by place, pool, batch)
 """


def _epoch(spark, sf):
    weight = F.when(F.col("source").startswith("eval_"), 0.0).when(F.col("source") == "tv_small", 2.5).when(F.col("source") == "web_talk", 0.4).otherwise(1.0)
    df = utterances(spark, sf, "id", "source", "duration", "n_tok", "split").filter("split = 'train'")
    return batches.epoch_plan(df.select("id", milliseconds().alias("size"), F.col("n_tok").cast("bigint").alias("tokens"), weight.alias("weight")), 1, 100_000, 400_000, 400)


@query(EPOCH_SQL + "select * from plan")
def w24_epoch_plan(spark, sf):
    """Repeats by weight, shuffled pools, micro-batches by padded seconds and tokens, steps by real seconds."""
    return _epoch(spark, sf)


@query(EPOCH_SQL + """select place, count(*) as n_micro, cast(sum(n) as bigint) as n, cast(sum(real) as bigint) as real, cast(sum(padded) as bigint) as padded, round(sum(real) / sum(padded), 6) as real_share, cast(max(padded) as bigint) as most_padded from micro group by place""")
def a28_padding(spark, sf):
    """Real and padded seconds of each step, micro-batch by micro-batch."""
    micro = batches.micro_batches(_epoch(spark, sf))
    return micro.groupBy("place").agg(F.count("*").alias("n_micro"), F.sum("n").alias("n"), F.sum("real").alias("real"), F.sum("padded").alias("padded"), F.round(F.sum("real") / F.sum("padded"), 6).alias("real_share"), F.max("padded").alias("most_padded"))


@query(EPOCH_SQL + """, e as (select unnest([{'criterion': 'longest', 'value': longest}, {'criterion': 'padded', 'value': padded}, {'criterion': 'padded_tokens', 'value': padded_tokens}, {'criterion': 'tokens', 'value': tokens}, {'criterion': 'rows', 'value': n}]) as x, pool, batch from micro)
 select x.criterion as criterion, pool, batch, cast(x.value as bigint) as value from e qualify row_number() over (partition by x.criterion order by x.value desc, pool, batch) = 1""")
def a29_extremes(spark, sf):
    """The micro-batch that is worst by each of five criteria."""
    return batches.extremes(_epoch(spark, sf))


@query(EPOCH_SQL + """, st as (select place, count(*) as n_micro, sum(n) as n, sum(real) as real, sum(padded) as padded, sum(tokens) as tokens, sum(padded_tokens) as padded_tokens, max(padded) as most_padded, max(n) as most_rows, max(tokens) as most_tokens from micro group by place)
 select count(*) as n_steps, cast(sum(n_micro) as bigint) as n_micro, cast(sum(n) as bigint) as n_rows, cast(sum(real) as bigint) as real, round(sum(real) / sum(padded), 6) as real_share, round(sum(tokens) / sum(padded_tokens), 6) as token_share,
 cast(min(real) as bigint) as least_step, cast(max(real) as bigint) as most_step, cast(max(most_padded) as bigint) as most_padded, max(most_rows) as most_rows, cast(max(most_tokens) as bigint) as most_tokens from st""")
def r07_plan_readout(spark, sf):
    """Steps of an epoch, how much of the padded room is real, the extremes."""
    return batches.plan_stats(_epoch(spark, sf))


@query(f"""with recursive u as (select id, row_no // 1000 as pool, 1 + case when hyp is null then 0 else 1 end as files, coalesce(strlen(ref), 0) as size, row_number() over (partition by row_no // 1000 order by id) as k from {UTT}),
 f as (select *, 0 as batch, files as n, size as total from u where k = 1
 union all select u.*, case when f.n + u.files > 20 or f.total + u.size > 1000 then f.batch + 1 else f.batch end, case when f.n + u.files > 20 or f.total + u.size > 1000 then u.files else f.n + u.files end,
 case when f.n + u.files > 20 or f.total + u.size > 1000 then u.size else f.total + u.size end from f join u on u.pool = f.pool and u.k = f.k + 1)
 select cast(pool as bigint) as pool, id, cast(files as integer) as files, cast(size as bigint) as size, batch from f""")
def w26_commit_batches(spark, sf):
    """Pairs of files, never split, packed in order under a number of files and bytes of text, within pools of 1,000 rows."""
    files = (1 + F.when(F.col("hyp").isNull(), 0).otherwise(1)).cast("int")
    df = utterances(spark, sf, "id", "row_no", "ref", "hyp").select(F.expr("row_no div 1000").alias("pool"), "id", files.alias("files"), F.coalesce(F.octet_length("ref"), F.lit(0)).cast("bigint").alias("size"))
    return sequence.filled_batches(df, ["pool"], ["id"], {"files": 20, "size": 1000}).select("pool", "id", "files", "size", "batch")


QUERIES, SQL = query.queries, query.sql
