"""Scans and sinks: narrow and batched reads, growing files, parts, ragged lists, pairs, selections, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import arrays, nested
from gleaner.operators import batches, guards
from gleaner.plans.registry import Registry
from gleaner.plans.selection import STEM, UTT, stem, utterances
from gleaner.session import scratch_path, table
from gleaner.sources import files
from gleaner.sources.retry import with_retries
from gleaner.streaming import tail

query = Registry()


def folder(spark, name: str) -> str:
    return scratch_path(spark, name)


@query("select id, n_tok from utt_index where split = 'eval' and n_tok > 20")
def s01_scan(spark, sf):
    """Two columns of the rows that pass; both reach the scan."""
    return table(spark, sf, "utt_index", "id", "n_tok", "split").filter("split = 'eval' and n_tok > 20").select("id", "n_tok")


@query("with k as (select id, row_no, (row_number() over (order by row_no) - 1) // 256 as batch from utt_index) select cast(batch as bigint) as batch, count(*) as n, min(row_no) as first_row, max(row_no) as last_row from k group by batch")
def s02_batches(spark, sf):
    """Rows in store order in batches of 256."""
    rows = table(spark, sf, "utt_index", "row_no").withColumn("one", F.lit(1).cast("bigint"))
    return batches.pools(rows, ["row_no"], "one", 256).groupBy(F.col("pool").alias("batch")).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


LINE_SQL = "'{\"path\":\"' || path || '\",\"n_rows\":' || n_rows || '}'"


@query(f"with l as (select path, n_rows, sum(strlen({LINE_SQL}) + 1) over (order by path, n_rows rows unbounded preceding) as upto from (select distinct path, n_rows from shard_manifest where path is not null and n_rows is not null)) select path, n_rows from l where upto <= 500")
def s05_prefix(spark, sf):
    """The whole lines within the first 500 bytes of a file of lines."""
    lines = table(spark, sf, "shard_manifest", "path", "n_rows").na.drop().distinct().coalesce(1).sortWithinPartitions("path", "n_rows")
    line = F.concat(F.lit('{"path":"'), "path", F.lit('","n_rows":'), F.col("n_rows").cast("string"), F.lit("}"))
    where = folder(spark, "growing")
    lines.select(line.alias("value")).write.text(where)
    return files.read_up_to(spark, where, "path string, n_rows int", 500)


@query("select id, case when row_no % 2 = 0 then source end as source, case when row_no % 2 = 1 then split end as split, cast(n_tok as bigint) as n_tok, cast(duration as double) as seconds from utt_index")
def s07_parts(spark, sf):
    """Parts with different columns and widths read as one table."""
    where = folder(spark, "parts")
    df = table(spark, sf, "utt_index", "id", "source", "split", "n_tok", "duration", "row_no")
    df.filter("row_no % 2 = 0").select("id", "source", F.col("n_tok").cast("bigint").alias("n_tok"), F.col("duration").alias("seconds")).write.parquet(f"{where}/part-0")
    df.filter("row_no % 2 = 1").select("id", "split", "n_tok", F.col("duration").cast("double").alias("seconds")).write.parquet(f"{where}/part-1")
    return files.read_parts(spark, [f"{where}/part-0", f"{where}/part-1"])


@query(f"select id, {STEM} as stem, ref as text, cast(length(ref) as integer) as n from {UTT} where length(ref) > 0")
def s08_ragged(spark, sf):
    """One flat array and its offsets for each shard of at most 500 rows, read back as a list for each row."""
    u = utterances(spark, sf, "id", "source", "split", "row_no", "ref").filter("length(ref) > 0").select(stem().alias("stem"), "row_no", "id", F.filter(F.split("ref", ""), lambda c: c != "").alias("units"))
    shard = u.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("row_no", "id", "units"))).alias("r"))
    stored = shard.select("stem", F.col("r.id").alias("ids"), F.flatten("r.units").alias("flat"), arrays.offsets(F.col("r.units")).alias("offsets"))
    where = folder(spark, "ragged")
    stored.write.parquet(where)
    back = spark.read.parquet(where).select("stem", F.explode(F.arrays_zip("ids", arrays.ragged(F.col("flat"), F.col("offsets")).alias("units"))).alias("x"))
    return back.select(F.col("x.ids").alias("id"), "stem", F.array_join("x.units", "").alias("text"), F.size("x.units").alias("n"))


@query(f"select id, source, split from {UTT} where split in ('dev', 'eval') and n_tok is not null")
def s12_pairs(spark, sf):
    """Lines and arrays written as pairs; one whose second member is missing isn't read."""
    where = folder(spark, "pairs")
    u = utterances(spark, sf, "id", "source", "split", "n_tok").filter("n_tok is not null")
    for split in ("dev", "eval"):
        part = u.filter(F.col("split") == split)
        files.write_pair(part.select("id", "source", "split"), part.select("id", F.array("n_tok").alias("sizes")), f"{where}/{split}")
    u.filter("split = 'train'").select("id", "source", "split").write.json(f"{where}/train/rows")
    return spark.read.schema("id string, source string, split string").json([f"{where}/{name}/rows" for name in files.complete_pairs(spark, where)])


@query("""select distinct id, source, n_tok, sha256('{"keep":true,"snap":2}') as digest from selection where snap = 2 and keep""")
def s13_selection(spark, sf):
    """A selection with the digest of the settings it was made with."""
    where = folder(spark, "selection")
    kept = table(spark, sf, "selection", "snap", "keep", "id", "source", "n_tok").filter("snap = 2 and keep").select("id", "source", "n_tok").distinct()
    files.write_selection(kept, where, {"snap": 2, "keep": True})
    return files.read_selection(spark, where)


@query("select run_key, step, tag, coalesce(cast(value as varchar), nf) is not null as known, value, nf from run_scalar")
def s14_mirror(spark, sf):
    """A log of lines mirrored to Parquet as it grows; the second run adds only what is new."""
    where = folder(spark, "mirror")
    df = table(spark, sf, "run_scalar", "run_key", "step", "tag", "value", "nf").withColumn("part", F.pmod(F.xxhash64("run_key", "step", "tag"), F.lit(2)))
    schema = "run_key string, step bigint, tag string, value double, nf string"
    for part in (0, 1):
        df.filter(F.col("part") == part).drop("part").write.json(f"{where}/lines/part={part}")
        tail.run_available(tail.tail(spark, f"{where}/lines", schema), f"{where}/mirror", f"{where}/state")
    back = spark.read.schema(schema).parquet(f"{where}/mirror")
    return back.select("run_key", "step", "tag", nested.restored(F.col("value"), F.col("nf")).isNotNull().alias("known"), "value", "nf")


@query("""with n as (select source, count(*) as n, cast(sum(n_tok) as bigint) as tokens from utt_index group by source), l as (select 2 + row_number() over (order by source) as k, '| ' || source || ' | ' || n || ' | ' || tokens || ' |' as line from n)
 select cast(1 as bigint) as k, '| source | n | tokens |' as line union all select cast(2 as bigint), '| --- | --- | --- |' union all select k, line from l""")
def s16_report(spark, sf):
    """A small report as lines of Markdown."""
    n = table(spark, sf, "utt_index", "source", "n_tok").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tok").alias("tokens")).orderBy("source")
    return spark.createDataFrame(list(enumerate(files.markdown(n), 1)), "k bigint, line string")


@query("""with w as (select distinct unnest([teacher_file || '.parquet', teacher_file || '.jsonl']) as path from selection where snap = 2 and teacher_file is not null) select path, case when path in (select path from shard_manifest where n_hours is not null) then 'pull' else 'missing' end as state from w""")
def s17_pull(spark, sf):
    """The files a selection needs, those not listed as missing."""
    names = table(spark, sf, "selection", "snap", "teacher_file").filter("snap = 2 and teacher_file is not null").select("teacher_file").distinct()
    wanted = names.select(F.explode(F.array(*(F.concat("teacher_file", F.lit(x)) for x in (".parquet", ".jsonl")))).alias("path"))
    return files.pull_plan(wanted, table(spark, sf, "shard_manifest", "path", "n_hours").filter("n_hours is not null"))


@query("select r_regionkey, r_name, cast(3 as integer) as tries from region")
def s18_retried(spark, sf):
    """A source that fails twice before it can be read."""
    failures = iter([ConnectionError("reset"), TimeoutError("slow")])

    def read():
        error = next(failures, None)
        if error:
            raise error
        return table(spark, sf, "region", "r_regionkey", "r_name")

    df, tries = with_retries(read, "region", first_wait=0.01)
    return df.withColumn("tries", F.lit(tries))


@query("""with l as (select distinct source, split_part(teacher_file, '/', -1) as name, cast(regexp_extract(teacher_file, '([0-9]+)$', 1) as integer) as number from selection where teacher_file is not null), f as (select source, split_part(name, '-', 1) as split, number from l),
 m as (select distinct source, split, cast(regexp_extract(path, '([0-9]+)\\.parquet$', 1) as integer) as number from shard_manifest where n_hours is not null and regexp_extract(path, '([0-9]+)\\.parquet$', 1) != '00000'), x as (select source, split, max(number) as last from m group by 1, 2)
 select f.source, f.split, f.number, case when m.number is not null then 'listed' when last is null or f.number > last then 'remove' else 'refuse' end as state from f left join m on m.source = f.source and m.split = f.split and m.number = f.number left join x on x.source = f.source and x.split = f.split""")
def x08_orphans(spark, sf):
    """Files that the manifest doesn't list: above its last they are remains of a crash, below they are refused."""
    name = F.substring_index("teacher_file", "/", -1)
    f = table(spark, sf, "selection", "source", "teacher_file").filter("teacher_file is not null").distinct().select("source", F.split_part(name, F.lit("-"), F.lit(1)).alias("split"), F.regexp_extract("teacher_file", "([0-9]+)$", 1).cast("int").alias("number"))
    number = F.regexp_extract("path", "([0-9]+)\\.parquet$", 1)
    m = table(spark, sf, "shard_manifest", "path", "source", "split", "n_hours").filter("n_hours is not null").select("source", "split", number.alias("number")).filter("number != '00000'").withColumn("number", F.col("number").cast("int"))
    return files.orphans(f, m, ["source", "split"], "number")


@query("""select 'first' as attempt, 'written' as outcome union all select 'again', 'same' union all select 'other', 'refused'""")
def x06_write_once(spark, sf):
    """Settings recorded once; the same pass again, others are refused."""
    where, out = folder(spark, "settings"), []
    for attempt, settings in (("first", {"rate": 0.1, "seed": 3}), ("again", {"seed": 3, "rate": 0.1}), ("other", {"rate": 0.2, "seed": 3})):
        try:
            out.append((attempt, "written" if guards.write_once(spark, where, settings) else "same"))
        except ValueError:
            out.append((attempt, "refused"))
    return spark.createDataFrame(out, "attempt string, outcome string")


@query("""select event_id, cast(event_id % 3 as integer) as round from events""")
def x02_follow(spark, sf):
    """Parts taken up as they appear, held back while a marker stands, until another says that no more come."""
    where = folder(spark, "follow")
    events, turns = table(spark, sf, "events", "event_id"), iter(range(1, 99))

    def writer() -> None:
        """What happens elsewhere while the loop waits: parts, a hold that comes and goes, the end."""
        turn = next(turns)
        if turn in (1, 4):
            part = 1 if turn == 1 else 2
            events.filter(f"event_id % 3 = {part}").write.parquet(f"{where}/in/part={part}")
        if turn == 1:
            tail.touch(spark, f"{where}/hold")
        if turn == 3:
            tail.remove(spark, f"{where}/hold")
        if turn == 4:
            tail.touch(spark, f"{where}/done")

    def take(names: list[str], round_: int) -> None:
        spark.read.parquet(*(f"{where}/in/{n}" for n in names)).select("event_id", F.lit(round_).alias("round")).write.mode("append").parquet(f"{where}/out")

    events.filter("event_id % 3 = 0").write.parquet(f"{where}/in/part=0")
    seen = tail.follow(spark, f"{where}/in", take, f"{where}/done", f"{where}/hold", writer)
    if seen["held"] != 2:
        raise RuntimeError("the hold was not kept")
    return spark.read.parquet(f"{where}/out")


QUERIES, SQL = query.queries, query.sql
