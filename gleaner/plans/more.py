"""Further operators: islands of a least length, weighted draws, spans, sizes, resolution of failures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators import rows, sequence
from gleaner.operators import statistics as st
from gleaner.plans.registry import Registry
from gleaner.plans.relations import SNAP, snapshot
from gleaner.plans.runs import LOG, log
from gleaner.plans.selection import UTT, utterances
from gleaner.session import materialise, table

query = Registry()


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events),
 n as (select *, count(*) over (partition by user_id, event_type, g) as n from e) select user_id, event_id, event_type from n where n >= 3""")
def w05_long_islands(spark, sf):
    """Rows inside runs of three or more equal values."""
    df = sequence.islands(table(spark, sf, "events", "user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")
    n = F.count("*").over(W.partitionBy("user_id", "island"))
    return df.withColumn("n", n).filter("n >= 3").select("user_id", "event_id", "event_type")


DRAWS = 1000


@query(f"""with c as (select id, n_tok, sum(n_tok) over (order by id rows unbounded preceding) as upto from {UTT} where n_tok > 0), t as (select max(upto) as total from c),
 d as (select i, cast(('0x' || substr(sha256('draw' || i), 1, 12)) as bigint) % cast((select total from t) as bigint) as x from range(0, {DRAWS}) r(i)) select d.i as draw, c.id from d join c on d.x >= c.upto - c.n_tok and d.x < c.upto""")
def t08_weighted_draws(spark, sf):
    """Rows drawn with the probability of their length, by a running sum and a bucketed range join."""
    c = sequence.running_total(utterances(spark, sf, "id", "n_tok").filter("n_tok > 0"), ["id"], "n_tok")
    c = materialise(c.select("id", (F.col("upto") - F.col("n_tok")).cast("bigint").alias("low"), F.col("upto").cast("bigint").alias("high")), "lengths")
    total = c.agg(F.max("high").alias("total"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("draw"), F.col("id").cast("string")), 256), 1, 12), 16, 10).cast("bigint")
    d = spark.range(DRAWS).select(F.col("id").alias("draw"), h.alias("h")).crossJoin(total).select("draw", (F.col("h") % F.col("total")).alias("x"))
    return sequence.within(d, c, [], "x", "low", "high", 4096).select("draw", "id")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from (select doc_id, text from documents where text is not null)),
 s as (select doc_id, k, length(line) as n, sum(length(line) + 1) over (partition by doc_id order by k rows unbounded preceding) as upto from l)
 select doc_id, k, cast(upto - n - 1 as bigint) as start, cast(upto - 1 as bigint) as end_ from s""")
def e12_line_spans(spark, sf):
    """Where each line of a text begins and ends, from running lengths within the row."""
    lines = F.split("text", "\n")
    df = table(spark, sf, "documents", "doc_id", "text").filter("text is not null").select("doc_id", lines.alias("lines"))
    ends = F.aggregate("lines", F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(-1).cast("bigint")) + F.length(x) + 1))
    df = df.select("doc_id", F.posexplode(F.arrays_zip("lines", ends.alias("ends"))).alias("k", "s"))
    return df.select("doc_id", (F.col("k") + 1).cast("bigint").alias("k"), (F.col("s.ends") - F.length("s.lines")).alias("start"), F.col("s.ends").alias("end_"))


@query("""with m as (select * from (select *, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest) where rn = 1), a as (select sum(n_hours) / sum(n_rows) filter (n_hours is not null) as per from m)
 select source, cast(sum(n_rows) as bigint) as n_rows, cast(ceil(round(sum(coalesce(n_hours, n_rows * per)) * 3600, 6) / 50) * 50 as bigint) as seconds from m, a group by source""")
def a31_sizing(spark, sf):
    """Totals with a default for unknown sizes, rounded up to 50."""
    m = rows.first_rows(table(spark, sf, "shard_manifest", "path", "source", "n_rows", "n_hours"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")])
    per = m.agg((F.sum("n_hours") / F.sum(F.when(F.col("n_hours").isNotNull(), F.col("n_rows")))).alias("per"))
    hours = F.sum(F.coalesce(F.col("n_hours"), F.col("n_rows") * F.col("per")))
    return m.crossJoin(per).groupBy("source").agg(F.sum("n_rows").alias("n_rows"), (F.ceil(F.round(hours * 3600, 6) / 50) * 50).cast("bigint").alias("seconds"))


@query(f"""with s as (select run_key, max(step) - min(step) as steps, max(elapsed_s) - min(elapsed_s) as seconds from {LOG} group by run_key) select run_key, round(steps / nullif(seconds, 0), 6) as per_second, round(seconds * 1000 / nullif(steps, 0), 6) as ms_each from s""")
def m08_rates(spark, sf):
    """Rates both ways, null where the other is 0."""
    s = log(spark, sf, "run_key", "step", "elapsed_s").groupBy("run_key").agg((F.max("step") - F.min("step")).alias("steps"), (F.max("elapsed_s") - F.min("elapsed_s")).alias("seconds"))
    return s.select("run_key", st.ratio(F.col("steps"), F.col("seconds")).alias("per_second"), st.ratio(F.col("seconds") * 1000, F.col("steps")).alias("ms_each"))


@query("""with f as (select run_key, tag, step, wall, nf from run_scalar where value is null), g as (select run_key, tag, max(wall) as last_good from run_scalar where value is not null group by 1, 2)
 select run_key, tag, step, nf, case when last_good > wall then 'resolved' else 'open' end as state from f left join g using (run_key, tag)""")
def r06_failures(spark, sf):
    """Rows without a usable value, and whether a later one of their series has it."""
    df = table(spark, sf, "run_scalar", "run_key", "tag", "step", "wall", "value", "nf")
    good = df.filter("value is not null").groupBy("run_key", "tag").agg(F.max("wall").alias("last_good"))
    state = F.when(F.col("last_good") > F.col("wall"), "resolved").otherwise("open")
    return df.filter("value is null").join(good, ["run_key", "tag"], "left").select("run_key", "tag", "step", "nf", state.alias("state"))


@query(f"""select a.id, case when b.id is not null and b.keep then 'hidden: twin' when not coalesce(a.keep, false) then 'hidden: ' || a.reason else 'drawn' end as state from (select * from {SNAP} where snap = 1) a left join (select * from {SNAP} where snap = 2) b on b.id = a.id""")
def r10_points(spark, sf):
    """Rows drawn or not, with the first reason not to."""
    a = snapshot(spark, sf, 1, "id", "keep", "reason")
    b = snapshot(spark, sf, 2, "id", F.col("keep").alias("twin"))
    state = rows.cascade([("hidden: twin", F.col("twin")), (F.concat(F.lit("hidden: "), "reason"), ~F.coalesce("keep", F.lit(False)))], "drawn")
    return a.join(b, "id", "left").select("id", state.alias("state"))


@query("""with t as (select epoch, step, id, n_tok, row_number() over (partition by epoch, id order by step, n_tok) as seen from trained_utt where id is not null) select epoch, count(*) filter (seen = 1) as n_ids, count(*) filter (seen > 1) as n_again, cast(sum(n_tok) filter (seen = 1) as bigint) as n_tok from t group by epoch""")
def s14_trained_log(spark, sf):
    """A log with repeated rows counted once for each epoch and id."""
    t = table(spark, sf, "trained_utt", "epoch", "step", "id", "n_tok").filter("id is not null")
    first = t.groupBy("epoch", "id").agg(F.count("*").alias("times"), F.min_by("n_tok", F.struct("step", "n_tok")).alias("n_tok"))
    return first.groupBy("epoch").agg(F.count("*").alias("n_ids"), F.sum(F.col("times") - 1).alias("n_again"), F.sum("n_tok").alias("n_tok"))


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net, round(avg(l_discount), 6) as avg_discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def star_totals(spark, sf):
    """Grouped totals over the star schema."""
    df = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("""select n_name, r_name, count(distinct o_orderkey) as n_orders, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def star_joins(spark, sf):
    """Joins along the star schema, orders by nation."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("price"))
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey").join(lines, "o_orderkey")
    customers = table(spark, sf, "customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    places = table(spark, sf, "nation", F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey").join(table(spark, sf, "region", F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    both = orders.join(customers, "o_custkey").join(places, "c_nationkey")
    return both.groupBy("n_name", "r_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("price"), 2).alias("total"))


QUERIES, SQL = query.queries, query.sql
