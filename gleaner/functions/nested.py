"""Nested and schema-on-read values: flattening, look-up, finite values, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def number_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of the numeric leaves of nested structs, in schema order."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += number_paths(f.dataType, name + ".")
        elif isinstance(f.dataType, NUMBERS):
            out.append(name)
    return out


def flattened(df: DataFrame, keys: list[str]) -> DataFrame:
    """``path, value`` for every number in the nested columns; strings and booleans are left out, null is kept."""
    paths = [p for p in number_paths(df.schema) if p not in keys]
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).cast("double").alias("value")) for p in paths))
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.path", "_p.value")


def finite(value: Column) -> Column:
    """Null in place of what JSON can't hold."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def restored(value: Column, name: Column) -> Column:
    """The value, or the one that isn't finite which the side column names."""
    return F.coalesce(value, F.when(name == "nan", float("nan")).when(name == "inf", float("inf")).when(name == "-inf", float("-inf")))


def redacted(pairs: Column, pattern: str = "(?i)(token|secret|password|key)") -> Column:
    """A map with the values of telling keys blanked."""
    return F.transform_values(pairs, lambda k, v: F.when(k.rlike(pattern), F.lit("***")).otherwise(v))


def merged_leaves(base: Column, over: Column) -> Column:
    """``leaves, unknown``: a map of dotted paths with those of ``over`` laid on top, and paths that ``base`` doesn't have."""
    leaves = F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))
    known = F.map_keys(base)
    kept = F.map_filter(leaves, lambda k, v: F.array_contains(known, k))
    return F.struct(kept.alias("leaves"), F.array_sort(F.array_except(F.map_keys(over), known)).alias("unknown"))


SETS = "map<string, struct<ids: array<string>, ids_sha256: string, sha256: string>>"


def manifest_sets(manifest: Column) -> Column:
    """The id lists of a manifest: ``name, ids, digest``, whichever of its layouts it has.

    The sets stand under ``sets``, under ``eval_sets`` or at the top, their digest as ``ids_sha256`` or
    ``sha256``; entries without ids are no sets.
    """
    body = F.coalesce(F.get_json_object(manifest, "$.sets"), F.get_json_object(manifest, "$.eval_sets"), manifest)
    entries = F.map_entries(F.from_json(body, SETS))
    sets = F.transform(entries, lambda e: F.struct(e.key.alias("name"), e.value.ids.alias("ids"), F.coalesce(e.value.ids_sha256, e.value.sha256).alias("digest")))
    return F.filter(sets, lambda s: s.ids.isNotNull())


def set_state(ids: Column, digest: Column) -> Column:
    """Whether an id list is what its digest says, and holds each id once."""
    own = F.sha2(F.array_join(ids, "\n"), 256)
    return F.when(digest.isNull(), "no digest").when(own != digest, "other ids").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicates").otherwise("verified")


def json_problems(config: Column, rules: dict[str, tuple[float, float]]) -> Column:
    """Every problem of a flat JSON object of numbers, as an array: not an object, missing, unknown, type, range."""
    keys = F.json_object_keys(config)
    out = [F.when(keys.isNull(), F.lit("not an object"))]
    for key, (least, most) in rules.items():
        raw = F.get_json_object(config, f"$.{key}")
        number = raw.try_cast("double")
        has = F.array_contains(keys, key)
        out += [F.when(keys.isNotNull() & ~has, F.lit(f"missing {key}")), F.when(has & number.isNull(), F.lit(f"type of {key}")), F.when(number.isNotNull() & ~number.between(least, most), F.lit(f"range of {key}"))]
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, rules)))), lambda k: F.concat(F.lit("unknown "), k))
    return F.concat(F.array_compact(F.array(*out)), F.coalesce(unknown, F.array().cast("array<string>")))
