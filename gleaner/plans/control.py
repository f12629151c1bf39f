"""Records about data: exclusions, roles, problem lists, manifests, plans, rankings, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import nested, ticks
from gleaner.operators import guards, rows, sequence
from gleaner.operators import relations as rel
from gleaner.plans.registry import Registry
from gleaner.plans.runs import LOG, log
from gleaner.plans.selection import JUDGED, STEM, UTT, judged, stem, utterances
from gleaner.session import table

query = Registry()


@query(f"""select id, case when model2 is null then 'no model' when judged_at is null then 'no time' when judged_at < timestamp '2031-01-07' then 'old: ' || model2 when agree is null then 'no verdict' when not (cer2 between 0 and 1) or cer2 is null then 'sanity: rate' end as excluded from {JUDGED}""")
def rule16_excluded(spark, sf):
    """Records of an old version or that fail a check are left out, each with its reason."""
    reason = rows.cascade(
        [
            ("no model", F.col("model2").isNull()),
            ("no time", F.col("judged_at").isNull()),
            (F.concat(F.lit("old: "), "model2"), F.col("judged_at") < F.lit("2031-01-07").cast("timestamp_ntz")),
            ("no verdict", F.col("agree").isNull()),
            ("sanity: rate", ~F.coalesce(F.col("cer2").between(0, 1), F.lit(False))),
        ]
    )
    return judged(spark, sf, "id", "model2", "judged_at", "agree", "cer2").select("id", F.nullif(reason, F.lit("kept")).alias("excluded"))


@query(f"""with l as (select run_key, tag, case when nf is not null then 'torn ' || nf else cast(wall as varchar) end as beat, step % 7 = 0 as released, (select max(wall) from run_scalar) as now from {LOG} qualify row_number() over (partition by run_key, tag order by step desc) = 1)
 select run_key, tag, not released and tag != 'sys/io_wait' and (try_cast(beat as double) is null or now - try_cast(beat as double) < 2700) as live from l""")
def rule17_lease(spark, sf):
    """A lease is live if it isn't released, is another's and its last sign is young; one that can't be read counts as young."""
    last = rows.last_rows(log(spark, sf, "run_key", "tag", "step", "wall", "nf"), ["run_key", "tag"], [F.col("step")])
    beat = F.when(F.col("nf").isNotNull(), F.concat(F.lit("torn "), "nf")).otherwise(F.col("wall").cast("string")).try_cast("double")
    now = table(spark, sf, "run_scalar", "wall").agg(F.max("wall").alias("now"))
    live = (F.col("step") % 7 != 0) & (F.col("tag") != "sys/io_wait") & (beat.isNull() | (F.col("now") - beat < 2700))
    return last.crossJoin(now).select("run_key", "tag", live.alias("live"))


@query("""select source, case when source like 'eval\\_%' escape '\\' then 'gate' when regexp_matches(source, '_(small|large)$') then 'broadcast' when source like 'pod%' then 'talk' when source like 'vn%' then 'script' else 'other' end as role, count(*) as n from utt_index group by 1, 2""")
def rule18_roles(spark, sf):
    """The role of each source, first rule that holds."""
    s = F.col("source")
    role = rows.cascade([("gate", s.startswith("eval_")), ("broadcast", s.rlike("_(small|large)$")), ("talk", s.startswith("pod")), ("script", s.startswith("vn"))], "other")
    return table(spark, sf, "utt_index", "source").groupBy("source", role.alias("role")).agg(F.count("*").alias("n"))


CONFIG = """case event_id % 6 when 0 then props when 1 then '{"k":"much","rate":0.5}' when 2 then '{}' when 3 then '{"k":-5,"rate":0.5,"z":1,"a":2}' when 4 then '[1]' else '{"k":' || event_id || ',"rate":0.25}' end"""


@query(f"""with c as (select event_id, {CONFIG} as c from events), k as (select event_id, c, case when json_type(c) = 'OBJECT' then json_keys(c) end as keys, try_cast(json_extract_string(c, '$.k') as double) as k, try_cast(json_extract_string(c, '$.rate') as double) as rate from c)
 select event_id, array_to_string(list_filter([case when keys is null then 'not an object' end, case when keys is not null and not list_contains(keys, 'k') then 'missing k' end, case when list_contains(keys, 'k') and k is null then 'type of k' end, case when k is not null and not (k between 0 and 100) then 'range of k' end,
 case when keys is not null and not list_contains(keys, 'rate') then 'missing rate' end, case when list_contains(keys, 'rate') and rate is null then 'type of rate' end, case when rate is not null and not (rate between 0 and 1) then 'range of rate' end]
 || coalesce(list_transform(list_sort(list_filter(keys, lambda x: x not in ('k', 'rate'))), lambda x: 'unknown ' || x), []), lambda x: x is not null), '; ') as problems from k""")
def rule19_config_problems(spark, sf):
    """Every problem of a setting, not only the first."""
    c = table(spark, sf, "events", "event_id", "props").select("event_id", F.expr(CONFIG.replace("event_id || ','", "cast(event_id as string) || ','")).alias("c"))
    return c.select("event_id", F.array_join(nested.json_problems(F.col("c"), {"k": (0, 100), "rate": (0, 1)}), "; ").alias("problems"))


@query(f"""with w as (select id from {UTT} where split in ('dev', 'eval')), s as (select 'first' as system, id from {UTT} where split in ('dev', 'eval') union all select 'judge', j.id from {JUDGED} j join {UTT} u using (id) where split in ('dev', 'eval')
 union all select 'snapshot', id from selection where snap = 2 and split in ('dev', 'eval')), h as (select system, id, count(*) as times from s group by 1, 2),
 c as (select system, cast(sum(times) as bigint) as n, (select count(*) from w) - count(w.id) as n_missing, count(*) filter (w.id is null) as n_extra, cast(sum(times - 1) as bigint) as n_duplicate from h left join w on w.id = h.id group by system)
 select *, n_missing > 0 or n_extra > 0 or n_duplicate > 0 as refused from c""")
def j13_refusal(spark, sf):
    """Systems held against a list of ids; one with missing, further or repeated ids is refused."""
    u = utterances(spark, sf, "id", "split").filter("split in ('dev', 'eval')").select("id")
    judge = judged(spark, sf, "id").join(u, "id", "left_semi")
    snap = table(spark, sf, "selection", "snap", "split", "id").filter("snap = 2 and split in ('dev', 'eval')").select("id")
    named = lambda df, name: df.select(F.lit(name).alias("system"), "id")
    return guards.coverage(named(u, "first").unionByName(named(judge, "judge")).unionByName(named(snap, "snapshot")), u)


@query("""with s as (select s_suppkey, s_nationkey, round(s_acctbal * 1.1 + 3 * s_nationkey, 6) as total from supplier where s_acctbal > 0 and s_nationkey not in (3, 7)) select s_suppkey, total, row_number() over (order by total, s_suppkey) as rank from s qualify rank <= 20""")
def t06_cheapest(spark, sf):
    """The 20 cheapest that pass, by an estimated total; the limit is the operator."""
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").filter("s_acctbal > 0 and s_nationkey not in (3, 7)")
    s = s.select("s_suppkey", F.round(F.col("s_acctbal") * 1.1 + 3 * F.col("s_nationkey"), 6).alias("total")).orderBy("total", "s_suppkey").limit(20)
    return rows.numbered(s, [], [F.col("total"), F.col("s_suppkey")], "rank")


@query("""with t as (select s_nationkey, s_suppkey, case when s_acctbal > 9000 then 1 when s_acctbal > 5000 then 2 when s_acctbal > 0 then 3 end as tier from supplier), m as (select s_nationkey, min(tier) as tier from t where tier is not null group by s_nationkey) select s_nationkey, s_suppkey, cast(tier as integer) as tier from t join m using (s_nationkey, tier)""")
def t07_first_tier(spark, sf):
    """Tiers tried in order for each nation; only the first that isn't empty counts."""
    s = table(spark, sf, "supplier", "s_nationkey", "s_suppkey", "s_acctbal")
    tier = F.when(F.col("s_acctbal") > 9000, 1).when(F.col("s_acctbal") > 5000, 2).when(F.col("s_acctbal") > 0, 3)
    s = s.select("s_nationkey", "s_suppkey", tier.alias("tier")).filter("tier is not null")
    return s.join(s.groupBy("s_nationkey").agg(F.min("tier").alias("tier")), ["s_nationkey", "tier"], "left_semi").select("s_nationkey", "s_suppkey", "tier")


@query("""with n as (select distinct 'step_' || step || case when tag like 'eval/%' then '_mini' else '' end as name from run_scalar where step is not null and tag is not null) select name, row_number() over (order by cast(split_part(name, '_', 2) as integer), name) as place from n""")
def t09_natural_order(spark, sf):
    """Names by the number in them, then as text."""
    n = table(spark, sf, "run_scalar", "step", "tag").na.drop().select(F.concat(F.lit("step_"), F.col("step").cast("string"), F.when(F.col("tag").startswith("eval/"), "_mini").otherwise("")).alias("name")).distinct()
    n = n.withColumn("number", F.split_part("name", F.lit("_"), F.lit(2)).cast("int")).withColumn("one", F.lit(1).cast("bigint"))
    return sequence.running_total(n, ["number", "name"], "one", "place").select("name", "place")


@query("""with m as (select path, n_rows, n_hours from (select *, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest) where rn = 1)
 select path, round(n_rows / nullif(n_hours * 3600, 0), 6) as rate, round(1000000 / nullif(n_rows / nullif(n_hours * 3600, 0), 0) / 3600, 6) as hours, case when n_hours is null then 'error' when 1000000 / (n_rows / (n_hours * 3600)) / 3600 <= 1100 then 'pass' else 'slow' end as verdict from m""")
def a35_transfer(spark, sf):
    """Rate of each transfer, hours a million rows would take, and whether that is fast enough."""
    m = rows.first_rows(table(spark, sf, "shard_manifest", "path", "n_rows", "n_hours"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")])
    rate = F.try_divide(F.col("n_rows").cast("double"), F.col("n_hours") * 3600)
    hours = F.try_divide(F.lit(1_000_000.0), rate) / 3600
    return m.select("path", F.round(rate, 6).alias("rate"), F.round(hours, 6).alias("hours"), F.when(F.col("n_hours").isNull(), "error").when(hours <= 1100, "pass").otherwise("slow").alias("verdict"))


@query("""select distinct media_key, round(coalesce(cast(length_s as double), epoch(timestamp '2031-01-01' - published_at)), 3) as seconds from recording where media_key is not null""")
def d04_remaining(spark, sf):
    """The duration where it is known, else what is left until a given end."""
    left = F.expr("timestampdiff(microsecond, published_at, timestamp_ntz '2031-01-01 00:00:00')") / 1e6
    r = table(spark, sf, "recording", "media_key", "length_s", "published_at").filter("media_key is not null")
    return r.select("media_key", F.round(F.coalesce(F.col("length_s").cast("double"), left), 3).alias("seconds")).distinct()


EDGES = """e as (select 's' || s_suppkey as node, 'n' || s_nationkey as needs from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 's' || s_suppkey, 's' || (s_suppkey // 2) from supplier where s_suppkey > 0)"""


@query(f"""with recursive {EDGES}, w as (select 's' || s_suppkey as node from supplier where s_acctbal > 9000), c(node) as (select node from w union select needs from e join c using (node)),
 l(node, level) as (select node, 0 from c where node not in (select node from e) union select e.node, l.level + 1 from e join l on e.needs = l.node where e.node in (select node from c)), m as (select node, max(level) as level from l group by node)
 select node, level, row_number() over (order by level, node) as place from m""")
def g01_plan(spark, sf):
    """The steps that some need, each after its own needs."""
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = s.select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("needs")).unionByName(s.filter("s_suppkey > 0").select(name("s", "s_suppkey").alias("node"), F.concat(F.lit("s"), F.expr("s_suppkey div 2").cast("string")).alias("needs")))
    edges = edges.unionByName(table(spark, sf, "nation", "n_nationkey", "n_regionkey").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("needs"))).distinct()
    return rel.ordered_plan(edges, s.filter("s_acctbal > 9000").select(name("s", "s_suppkey").alias("node")))


@query("""with s as (select run_key, count(*) as n, count(distinct (step, tag)) as n_keys, count(*) filter (value is null and nf is null) as n_void, max(step) as reach, bool_or(wall < 0 or elapsed_s < 0) as negative, count(distinct tag) as n_tags from run_scalar where run_key is not null group by run_key)
 select run_key, array_to_string(list_filter([case when n != n_keys then 'rows stand more than once' end, case when n_void > 0 then 'rows without a value' end, case when reach < 250 then 'ends before step 250' end, case when negative then 'negative times' end, case when n_tags < 5 then 'series are missing' end], lambda x: x is not null), '; ') as problems from s""")
def g03_record_problems(spark, sf):
    """Every respect in which a run's record doesn't fit what is asked of it."""
    s = table(spark, sf, "run_scalar").filter("run_key is not null").groupBy("run_key").agg(
        F.count("*").alias("n"), F.count_distinct(F.struct("step", "tag")).alias("n_keys"), F.count_if(F.col("value").isNull() & F.col("nf").isNull()).alias("n_void"),
        F.max("step").alias("reach"), F.bool_or((F.col("wall") < 0) | (F.col("elapsed_s") < 0)).alias("negative"), F.count_distinct("tag").alias("n_tags"),
    )
    checks = [("rows stand more than once", F.expr("n = n_keys")), ("rows without a value", F.col("n_void") == 0), ("ends before step 250", F.col("reach") >= 250), ("negative times", ~F.col("negative")), ("series are missing", F.col("n_tags") >= 5)]
    return s.select("run_key", F.array_join(rows.problems(checks), "; ").alias("problems"))


@query(f"""with a as (select source, list_sort(list(distinct id)) as ids, count(distinct id) as n from selection where snap = 2 and split is not null group by source), b as (select source, list_sort(list(distinct id)) as ids, count(distinct id) as n from utt_index where split is not null group by source),
 m as (select source, sum(n_rows) as listed from (select *, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest) where rn = 1 group by source), d as (select source, count(*) filter (split = 'dev') as n_dev from {UTT} group by source)
 select coalesce(a.source, b.source) as source, array_to_string(list_filter([case when a.ids is distinct from b.ids then 'other ids' end, case when coalesce(listed != a.n, true) then 'manifest has other rows' end, case when coalesce(n_dev = 0, true) then 'no dev rows' end], lambda x: x is not null), '; ') as problems
 from a full join b on a.source = b.source left join m on m.source = coalesce(a.source, b.source) left join d on d.source = coalesce(a.source, b.source)""")
def g04_sidecar(spark, sf):
    """What a selection's companion records don't bear out: its ids, its manifest, its dev rows."""
    a = table(spark, sf, "selection", "id", "source", "split", "snap").filter("snap = 2 and split is not null")
    b = table(spark, sf, "utt_index", "id", "source", "split").filter("split is not null")
    ids = guards.content_matches(a, b, ["source"], "id").select("source", "n_a", "complete")
    m = rows.first_rows(table(spark, sf, "shard_manifest", "path", "source", "n_rows", "n_hours"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")]).groupBy("source").agg(F.sum("n_rows").alias("listed"))
    dev = utterances(spark, sf, "id", "source", "split").groupBy("source").agg(F.count_if(F.col("split") == "dev").alias("n_dev"))
    checks = [("other ids", F.col("complete")), ("manifest has other rows", F.col("listed") == F.col("n_a")), ("no dev rows", F.col("n_dev") > 0)]
    return ids.join(m, "source", "left").join(dev, "source", "left").select("source", F.array_join(rows.problems(checks), "; ").alias("problems"))


@query("""select snap, 'reason not allowed' as problem, count(*) as n from selection where coalesce(reason, '') not in ('kept', 'truncated', 'no_agree', 'no_audio', 'not_judged') and reason not like 'agree>%' group by snap
 union all select snap, 'kept with a reason', count(*) from selection where keep and reason != 'kept' group by snap union all select snap, 'rows stand more than once', count(*) - count(distinct id) from selection group by snap having count(*) > count(distinct id)
 union all select snap, 'file not listed', count(distinct teacher_file) from selection where teacher_file || '.parquet' not in (select path from shard_manifest where path is not null) group by snap
 union all select snap, 'over the limit', count(*) from selection where keep and split = 'train' and agree > cast(0.3 as float) group by snap""")
def g05_audit(spark, sf):
    """A selection held against what it should be, problem by problem."""
    s = table(spark, sf, "selection", "snap", "id", "reason", "keep", "teacher_file", "split", "agree")
    listed = table(spark, sf, "shard_manifest", "path").filter("path is not null").distinct()
    odd = ~F.coalesce("reason", F.lit("")).isin("kept", "truncated", "no_agree", "no_audio", "not_judged") & ~F.col("reason").startswith("agree>")
    counts = s.groupBy("snap").agg(
        F.count_if(odd).alias("reason not allowed"), F.count_if(F.col("keep") & (F.col("reason") != "kept")).alias("kept with a reason"), (F.count("*") - F.count_distinct("id")).alias("rows stand more than once"),
        F.count_if(F.col("keep") & (F.col("split") == "train") & (F.col("agree") > F.lit(0.3).cast("float"))).alias("over the limit"),
    )
    names = counts.columns[1:]
    files = s.select("snap", F.concat("teacher_file", F.lit(".parquet")).alias("path")).na.drop().distinct().join(listed, "path", "left_anti").groupBy("snap").agg(F.lit("file not listed").alias("problem"), F.count("*").alias("n"))
    return counts.unpivot("snap", names, "problem", "n").filter("n > 0").unionByName(files)


@query(f"""with r as (select id, '{{"id":"' || id || '","n_tok":' || n_tok || ',"source":"' || source || '"}}' as j from {UTT} where split = 'dev') select sha256(string_agg(j, chr(10) order by id)) as digest, true as equal from r""")
def g07_determinism(spark, sf):
    """The content of an output has one digest, however it is laid out."""
    u = utterances(spark, sf, "id", "source", "n_tok", "split").filter("split = 'dev'").drop("split")
    one, two = (guards.content_digest(df, ["id"]) for df in (u.repartition(7), u.repartition(3, "source")))
    return spark.createDataFrame([(one, one == two)], "digest string, equal boolean")


@query("""with s as (select source, sum(cast(duration as decimal(12, 3))) as seconds, count(*) as n from utt_index group by source) select source, cast(ceil(seconds / 400) as bigint) as steps, round(ceil(seconds / 400) * 0.2814 / 3600 * 1.05 + n * 0.0001 / 3600 + 0.25, 6) as hours from s""")
def g08_hours(spark, sf):
    """Hours of a job from its steps, the seconds of one, and what comes on top."""
    s = table(spark, sf, "utt_index", "source", "duration").groupBy("source").agg(F.sum(F.col("duration").cast("decimal(12,3)")).alias("seconds"), F.count("*").alias("n"))
    steps = F.ceil(F.col("seconds") / 400).cast("bigint")
    return s.select("source", steps.alias("steps"), F.round(steps * 0.2814 / 3600 * 1.05 + F.col("n") * 0.0001 / 3600 + 0.25, 6).alias("hours"))


@query("""select event_id, case when event_type = 'click' then 'fast' else 'a' end as mode, cast(case when event_type in ('click', 'error') then event_id % 7 else 1 end as varchar) as size, case when event_type = 'error' then 'seed' end as unknown from events""")
def n02_merged(spark, sf):
    """Settings by path with others laid on top; paths that the base doesn't have are named."""
    e = table(spark, sf, "events", "event_id", "event_type")
    size = (F.col("event_id") % 7).cast("string")
    base = F.create_map(F.lit("run.mode"), F.lit("a"), F.lit("run.size"), F.lit("1"))
    over = F.when(F.col("event_type") == "click", F.create_map(F.lit("run.mode"), F.lit("fast"), F.lit("run.size"), size)).when(F.col("event_type") == "error", F.create_map(F.lit("run.size"), size, F.lit("seed"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    m = e.select("event_id", nested.merged_leaves(base, over).alias("m"))
    return m.select("event_id", F.col("m.leaves")["run.mode"].alias("mode"), F.col("m.leaves")["run.size"].alias("size"), F.nullif(F.array_join("m.unknown", ","), F.lit("")).alias("unknown"))


@query(f"""with s as (select {STEM} as name, id, row_no from {UTT} where split in ('dev', 'eval')), g as (select name, count(*) as n from s group by name) select name, cast(n + case when right(name, 1) = '2' then 1 else 0 end as integer) as n_ids, case when right(name, 1) = '1' then 'other ids' when right(name, 1) = '2' then 'duplicates' when right(name, 1) = '5' then 'no digest' else 'verified' end as state from g""")
def n06_manifests(spark, sf):
    """Manifests of three layouts read alike, and each id list verified against its digest."""
    s = utterances(spark, sf, "id", "source", "split", "row_no").filter("split in ('dev', 'eval')").select(stem().alias("name"), "id", "row_no")
    g = s.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "id"))), lambda x: x.id).alias("ids"))
    last = F.right("name", F.lit(1))
    ids = F.when(last == "2", F.concat("ids", F.slice("ids", 1, 1))).otherwise(F.col("ids"))
    digest = F.when(last == "5", None).when(last == "1", F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.array_join(ids, "\n"), 256))
    layout = F.length("name") % 3
    entry = F.when(layout == 1, F.to_json(F.create_map("name", F.struct(ids.alias("ids"), digest.alias("sha256"))))).otherwise(F.to_json(F.create_map("name", F.struct(ids.alias("ids"), digest.alias("ids_sha256")))))
    text = F.when(layout == 0, F.concat(F.lit('{"made":3,"sets":'), entry, F.lit("}"))).when(layout == 1, F.concat(F.lit('{"eval_sets":'), entry, F.lit("}"))).otherwise(entry)
    sets = g.select(text.alias("manifest")).select(F.explode(nested.manifest_sets(F.col("manifest"))).alias("s")).select("s.*")
    return sets.select("name", F.size("ids").alias("n_ids"), nested.set_state(F.col("ids"), F.col("digest")).alias("state"))


COUNTED = "select teacher_file as path, count(distinct id) as n, count(distinct id) filter (keep) as n_kept from selection where snap = {} and teacher_file is not null group by 1"


@query(f"select path, n, n_kept from ({COUNTED.format(2)}) except select path, n, n_kept from ({COUNTED.format(1)})")
def x07_verified(spark, sf):
    """Files that weren't checked as they are now; checks of the earlier snapshot are remembered."""
    s = table(spark, sf, "selection", "snap", "teacher_file", "id", "keep").filter("teacher_file is not null")
    of = lambda n: s.filter(F.col("snap") == n).groupBy(F.col("teacher_file").alias("path")).agg(F.count_distinct("id").alias("n"), F.count_distinct(F.when(F.col("keep"), F.col("id"))).alias("n_kept"))
    return guards.unverified(of(2), of(1), ["path", "n", "n_kept"])


@query("with p as (select run_key, max(step) as step, max(step) // 100 as epoch from run_scalar where run_key is not null group by run_key) select run_key, case when row_number() over (order by run_key) % 2 = 1 then 'resumed' else 'refused' end as outcome, case when row_number() over (order by run_key) % 2 = 1 then step end as step, case when row_number() over (order by run_key) % 2 = 1 then epoch end as epoch from p")
def x10_cursor(spark, sf):
    """Positions saved with the fingerprint of their plan; one of another plan is refused."""
    # One row for each run.
    last = table(spark, sf, "run_scalar", "run_key", "step").filter("run_key is not null").groupBy("run_key").agg(F.max("step").alias("step")).orderBy("run_key").collect()
    out = []
    for k, r in enumerate(last):
        saved = guards.Cursor({"run": r.run_key, "steps": 100 + k % 2}).state() | {"epoch": r.step // 100, "step": r.step}
        try:
            at = guards.Cursor({"run": r.run_key, "steps": 100}).resume(saved)
            out.append((r.run_key, "resumed", at.step, at.epoch))
        except ValueError:
            out.append((r.run_key, "refused", None, None))
    return spark.createDataFrame(out, "run_key string, outcome string, step bigint, epoch bigint")


@query("""with a as (select tag, min(value) as lo, max(value) as hi from run_scalar where value is not null and tag is not null group by tag), u as (select *, pow(10.0, floor(round(log10((hi - lo) / 8), 9))) as unit from a where hi > lo),
 s as (select *, unit * list_filter([1, 2, 5, 10, 20], lambda k: (hi - lo) / (unit * k) <= 7)[1] as step from u) select tag, cast(k as integer) as k, round(k * step, 9) as tick from (select tag, step, unnest(range(cast(ceil(lo / step - 1e-9) as bigint), cast(floor(hi / step + 1e-9) as bigint) + 1)) as k from s)""")
def m07_ticks(spark, sf):
    """Round values for the axis of each series."""
    a = table(spark, sf, "run_scalar", "tag", "value").na.drop().groupBy("tag").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("hi > lo")
    t = a.select("tag", ticks.linear_ticks(F.col("lo"), F.col("hi")).alias("t"))
    step = t.select("tag", F.posexplode("t").alias("i", "tick"), (F.get("t", F.lit(1)) - F.get("t", F.lit(0))).alias("step"))
    return step.select("tag", F.round(F.col("tick") / F.col("step")).cast("int").alias("k"), "tick")


SPEED = """with m as (select path, source, split, n_rows, n_hours from (select *, row_number() over (partition by path order by n_hours desc nulls last, n_rows desc) rn from shard_manifest) where rn = 1), o as (select *, case when path like '%0.parquet' then null else n_rows / n_hours end as own from m)"""


@query(SPEED + """, g as (select source, split, min(own) as v from o where own is not null group by 1, 2), s as (select source, min(own) as v from o where own is not null group by 1), a as (select min(own) as v from o)
 select path, round(coalesce(own, g.v, s.v * 0.9, a.v * 0.5), 6) as speed, case when own is not null then 'own' when g.v is not null then 'sibling' when s.v is not null then 'source' when a.v is not null then 'any' end as origin,
 array_to_string(list_filter([case when own is null then 'borrowed' end, case when own is null and g.v is null and coalesce(s.v, a.v) is not null then 'scaled' end, case when coalesce(own, g.v, s.v, a.v) is null then 'unknown' end], lambda x: x is not null), ',') as flags
 from o left join g using (source, split) left join s using (source), a""")
def m09_speed(spark, sf):
    """The speed of each file: its own, else a sibling's, its source's or any, with flags that say so."""
    m = rows.first_rows(table(spark, sf, "shard_manifest", "path", "source", "split", "n_rows", "n_hours"), ["path"], [F.col("n_hours").isNull(), -F.col("n_hours"), -F.col("n_rows")])
    o = m.withColumn("own", F.when(~F.col("path").endswith("0.parquet"), F.try_divide(F.col("n_rows"), F.col("n_hours"))))
    known = o.filter("own is not null")
    o = o.join(known.groupBy("source", "split").agg(F.min("own").alias("g")), ["source", "split"], "left").join(known.groupBy("source").agg(F.min("own").alias("s")), "source", "left").crossJoin(known.agg(F.min("own").alias("a")))
    out = rel.with_fallback(o, [("own", F.col("own")), ("sibling", F.col("g")), ("source", F.col("s") * 0.9), ("any", F.col("a") * 0.5)], "speed", "origin")
    flags = F.array_compact(F.array(F.when(F.col("own").isNull(), "borrowed"), F.when(F.col("origin").isin("source", "any"), "scaled"), F.when(F.col("origin").isNull(), "unknown")))
    return out.select("path", F.round("speed", 6).alias("speed"), "origin", F.array_join(flags, ",").alias("flags"))


QUERIES, SQL = query.queries, query.sql
