"""Readers and writers of line files, part files, paired files and exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import sequence


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object for each line that isn't blank; a torn line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_whole_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of whole lines, and the torn lines beside them."""
    # The raw line is read too, as a scan of the corrupt column alone isn't allowed.
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    kind = T._parse_datatype_string(schema)
    kind = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    torn = F.col("r._corrupt").isNotNull()
    return rows.filter(~torn).select("r.*").drop("_corrupt"), rows.filter(torn).select("value")


def iter_rows(df: DataFrame, batch_rows: int = 256) -> Iterator[list[Row]]:
    """The rows in lists of ``batch_rows``, one partition at a time on the driver."""
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == batch_rows:
            yield held
            held = []
    if held:
        yield held


def read_up_to(spark: SparkSession, path: str, schema: str, limit: int) -> DataFrame:
    """Whole lines that end within the first ``limit`` bytes of one growing file; a torn line is left out.

    Blocks that begin beyond the limit aren't kept; where a line ends is a running total of line lengths
    over the file's order, so no task holds more than its lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.filter(F.col("block") < limit).withColumn("bytes", F.octet_length("value").cast("bigint") + 1)
    kept = sequence.running_total(lines, ["block", "seq"], "bytes", "upto").filter((F.col("upto") <= limit) & (F.length(F.trim("value")) > 0))
    return kept.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def widest(kinds: list[str]) -> str:
    """The type that holds values of all of ``kinds``: the widest number, a double where whole numbers meet floats, else text."""
    if len(set(kinds)) == 1:
        return kinds[0]
    if set(kinds) <= set(NUMBERS) and "float" in kinds and {"int", "bigint"} & set(kinds):
        return "double"
    return NUMBERS[max(map(NUMBERS.index, kinds))] if all(k in NUMBERS for k in kinds) else "string"


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parts with different columns as one table: every column any of them has, of the widest type.

    Parts of one schema are one scan.
    """
    alike: dict[str, list[str]] = {}
    for path in paths:
        alike.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    frames = [spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*group) for schema, group in alike.items()]
    kinds: dict[str, list[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name, []).append(kind)
    wide = {name: widest(k) for name, k in kinds.items()}
    cast = [df.select(*(F.col(c).cast(wide[c]).alias(c) for c in df.columns)) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def write_pair(rows: DataFrame, arrays: DataFrame, path: str) -> None:
    """Lines first, then arrays; the committed arrays mark the pair as complete, so a crash between them leaves none."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    arrays.write.mode("overwrite").parquet(f"{path}/arrays")


def complete_pairs(spark: SparkSession, folder: str) -> list[str]:
    """The pairs of a folder whose second member was committed."""
    return [name for name in listed(spark, folder) if exists(spark, f"{folder}/{name}/arrays/_SUCCESS")]


def write_selection(df: DataFrame, path: str, settings: dict) -> None:
    """Typed rows, and beside them what they were made with: settings as canonical JSON and their digest."""
    df.write.parquet(f"{path}/rows")
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    meta = df.sparkSession.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "settings string, digest string")
    meta.coalesce(1).write.json(f"{path}/meta")


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """The rows with the digest of the settings they were made with."""
    return spark.read.parquet(f"{path}/rows").crossJoin(spark.read.schema("digest string").json(f"{path}/meta"))


def pull_plan(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, state``: each wanted path once, ``pull`` where it is listed, else ``missing``."""
    there = listing.select("path").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("there"), "pull").otherwise("missing")
    return wanted.select("path").filter("path is not null").distinct().join(there, "path", "left").select("path", state.alias("state"))


def orphans(listing: DataFrame, manifest: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, number, state`` of listed files: ``listed`` in the manifest, ``remove`` above its last number, else ``refuse``.

    A file above the last number was being written when its writer died; one below was lost from the
    manifest and needs a look.
    """
    known = manifest.select(*keys, number).distinct()
    last = known.groupBy(*keys).agg(F.max(number).alias("_last"))
    held = listing.select(*keys, number).distinct().join(known.withColumn("_known", F.lit(True)), [*keys, number], "left").join(last, keys, "left")
    state = F.when(F.col("_known"), "listed").when(F.col("_last").isNull() | (F.col(number) > F.col("_last")), "remove").otherwise("refuse")
    return held.select(*keys, number, state.alias("state"))


def paired(files: DataFrame, key: str, kind: str, payload: str, first: str, second: str) -> DataFrame:
    """``key, first, second`` for keys that have both kinds of member, whichever came first."""
    pick = lambda k: F.max(F.when(F.col(kind) == k, F.col(payload)))
    return files.groupBy(key).agg(pick(first).alias(first), pick(second).alias(second)).filter(F.col(first).isNotNull() & F.col(second).isNotNull())


def write_shards(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 2048) -> DataFrame:
    """Files of bounded length in a folder for each key, and the manifest of what was written."""
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.withColumn("path", F.input_file_name()).groupBy("path", *keys).agg(F.count("*").alias("n_rows"))


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, so that every column fits a CSV cell."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def export(df: DataFrame, path: str, csv_rows: int) -> bool:
    """Parquet, and CSV beside it unless there are more rows than ``csv_rows``; says whether CSV was written."""
    df.write.parquet(f"{path}/parquet")
    if df.sparkSession.read.parquet(f"{path}/parquet").count() > csv_rows:
        return False
    flat_for_csv(df).write.option("header", True).csv(f"{path}/csv")
    return True


def cell(value: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown(df: DataFrame, limit: int = 1000) -> list[str]:
    """A report table as Markdown lines; a report longer than ``limit`` rows is refused."""
    names = df.columns
    rows = df.select(*(cell(F.col(c)).alias(c) for c in names)).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(r) + " |" for r in rows)]
