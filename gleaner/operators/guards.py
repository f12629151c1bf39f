"""Guards: settings written once, plans that must match, uncovered or unexpected rows that refuse a result."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import sequence


def digest(value: object) -> str:
    """SHA-256 of a value as canonical JSON: keys sorted, no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def refuse(df: DataFrame, bad: Column, what: str, examples: int = 5) -> DataFrame:
    """``df`` unchanged, or an error that names some rows where ``bad`` holds."""
    held = df.filter(bad).limit(examples + 1).collect()
    if held:
        raise ValueError(f"{what}: {'more than ' if len(held) > examples else ''}{min(len(held), examples)} rows, as {[r.asDict() for r in held[:examples]]}")
    return df


def refuse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` unchanged, or an error if a key stands more than once."""
    refuse(df.groupBy(*keys).agg(F.count("*").alias("n")), F.col("n") > 1, "keys stand more than once")
    return df


def write_once(spark: SparkSession, path: str, settings: dict) -> bool:
    """Record the settings of an output; True if they are new, an error if others are recorded there."""
    want = digest(settings)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        there = spark.read.json(path).first()
        if there.digest != want:
            raise ValueError(f"{path} holds other settings")
        return False
    spark.createDataFrame([(want, json.dumps(settings, sort_keys=True))], "digest string, settings string").coalesce(1).write.json(path)
    return True


def merged(base: dict, over: dict, where: str = "") -> dict:
    """``base`` with the leaves of ``over``; a key that ``base`` doesn't have is an error."""
    out = dict(base)
    for key, value in over.items():
        if key not in base:
            raise KeyError(f"unknown setting: {where}{key}")
        out[key] = merged(base[key], value, f"{where}{key}.") if isinstance(base[key], dict) and isinstance(value, dict) else value
    return out


def looked_up(value: object, path: str) -> object:
    """What a dotted path leads to in nested dicts, or None."""
    for key in path.split("."):
        if not isinstance(value, dict) or key not in value:
            return None
        value = value[key]
    return value


class Cursor:
    """A position within a plan; a position of another plan is refused."""

    def __init__(self, plan: object):
        self.fingerprint, self.epoch, self.step = digest(plan), 0, 0

    def state(self) -> dict:
        return {"fingerprint": self.fingerprint, "epoch": self.epoch, "step": self.step}

    def resume(self, state: dict) -> "Cursor":
        if state["fingerprint"] != self.fingerprint:
            raise ValueError("the state belongs to another plan")
        self.epoch, self.step = state["epoch"], state["step"]
        return self


def config_problems(config: dict, rules: dict[str, tuple], where: str = "") -> list[str]:
    """Every problem of a nested setting: missing and unknown keys, wrong types, numbers out of range.

    A rule is a type, ``(type, least, most)`` for a number, or a nested dict of rules.
    """
    out = [f"missing {where}{k}" for k in rules if k not in config]
    out += [f"unknown {where}{k}" for k in config if k not in rules]
    for key in (k for k in rules if k in config):
        rule, value = rules[key], config[key]
        if isinstance(rule, dict):
            out += config_problems(value, rule, f"{where}{key}.") if isinstance(value, dict) else [f"type of {where}{key}"]
            continue
        kind, *bounds = rule if isinstance(rule, tuple) else (rule,)
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            out.append(f"type of {where}{key}")
        elif bounds and not bounds[0] <= value <= bounds[1]:
            out.append(f"range of {where}{key}")
    return out


def unverified(listing: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    """What of a listing isn't in the cache of checks as it stands now; a changed size or digest is checked again."""
    return listing.select(*columns).distinct().join(cache.select(*columns).distinct(), [listing[c].eqNullSafe(cache[c]) for c in columns], "left_anti")


def content_digest(df: DataFrame, order: list[str]) -> str:
    """SHA-256 of all rows as canonical JSON, in the order given; layout, file names and times don't enter it."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    one = sequence.ordered_digest(df.select(F.lit(0).alias("_one"), *order, row.alias("_json")), ["_one"], order, "_json")
    found = one.first()
    return found.digest if found else hashlib.sha256(b"").hexdigest()


def coverage(systems: DataFrame, wanted: DataFrame) -> DataFrame:
    """``system, n, n_missing, n_extra, n_duplicate, refused``: whether each system holds exactly the wanted ids, once each."""
    held = systems.groupBy("system", "id").agg(F.count("*").alias("times"))
    ids = wanted.select("id").distinct().withColumn("wanted", F.lit(True))
    found = held.join(ids, "id", "left")
    n_wanted = ids.agg(F.count("*").alias("n_wanted"))
    by = found.groupBy("system").agg(F.sum("times").alias("n"), F.count("wanted").alias("n_met"), F.count_if(F.col("wanted").isNull()).alias("n_extra"), F.sum(F.col("times") - 1).alias("n_duplicate"))
    out = by.crossJoin(n_wanted).select("system", "n", (F.col("n_wanted") - F.col("n_met")).alias("n_missing"), "n_extra", "n_duplicate")
    return out.withColumn("refused", F.expr("n_missing > 0 or n_extra > 0 or n_duplicate > 0"))


def aligned_or_refused(systems: DataFrame, wanted: DataFrame) -> DataFrame:
    """``systems`` unchanged, or an error that names a system which doesn't hold exactly the wanted ids."""
    refuse(coverage(systems, wanted), F.col("refused"), "systems that don't match the manifest")
    return systems


def content_matches(a: DataFrame, b: DataFrame, unit: list[str], key: str) -> DataFrame:
    """Units with whether both sides hold the same set of keys, by counts and order-free digests.

    The digest of a unit is the sum of its keys' hashes beside their number, so units of any size are
    combined before the shuffle.
    """

    def of(df: DataFrame, side: str) -> DataFrame:
        h = F.xxhash64(key).cast("decimal(38,0)")
        return df.select(*unit, key).distinct().groupBy(*unit).agg(F.count("*").alias(f"n_{side}"), F.sum(h).alias(f"h_{side}"))

    both = of(a, "a").join(of(b, "b"), unit, "full")
    return both.select(*unit, "n_a", "n_b", (F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("h_a").eqNullSafe(F.col("h_b"))).alias("complete"))
