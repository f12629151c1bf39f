"""Relations between two tables: alignment, differences both ways, ranges, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import sequence
from gleaner.session import discard, materialise


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with flags ``in_a`` and ``in_b``; other columns of ``b`` get a ``_b`` behind."""
    right = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys)).withColumn("in_b", F.lit(True))
    both = a.withColumn("in_a", F.lit(True)).join(right, keys, "full")
    return both.withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn("in_b", F.coalesce("in_b", F.lit(False)))


def differences(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column: rows that differ (null equals null) and the largest absolute difference of numbers."""
    kinds = dict(a.dtypes)
    both = a.select(*keys, *columns).join(b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in columns)), keys)
    cells = []
    for c in columns:
        numeric = kinds[c] in ("int", "bigint", "float", "double")
        gap = F.abs(F.col(c).cast("double") - F.col(f"{c}_b").cast("double")) if numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), (~F.col(c).eqNullSafe(F.col(f"{c}_b"))).alias("differs"), gap.alias("gap")))
    return both.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.column").agg(F.count("*").alias("n"), F.count_if(F.col("c.differs")).alias("n_differ"), F.round(F.max("c.gap"), 6).alias("max_gap"))


def with_fallback(df: DataFrame, choices: list[tuple[str, Column]], output: str, origin: str) -> DataFrame:
    """The first choice that isn't null, and the name of what gave it."""
    source = None
    for name, value in choices:
        source = F.when(value.isNotNull(), name) if source is None else source.when(value.isNotNull(), name)
    return df.withColumn(output, F.coalesce(*(v for _, v in choices))).withColumn(origin, source)


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 100) -> DataFrame:
    """All nodes reached from ``seeds`` (``node``) along ``edges`` (``node, needs``), seeds included."""
    reached = materialise(seeds.select("node").distinct(), "reached")
    front = reached
    for _ in range(max_rounds):
        fresh = edges.join(front, "node").select(F.col("needs").alias("node")).distinct().join(reached, "node", "left_anti")
        front = materialise(fresh, "front")
        if front.isEmpty():
            return reached
        grown = materialise(reached.unionByName(front), "reached")
        discard(reached)
        reached = grown
    raise RuntimeError(f"the closure still grows after {max_rounds} rounds")


def ordered_plan(edges: DataFrame, wanted: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, level, place``: every node that ``wanted`` needs, each after all it needs itself.

    ``level`` is the longest way from a node down to one that needs nothing; nodes of a level come by
    name. A circle of needs is an error.
    """
    nodes = closure(edges, wanted)
    own = edges.join(nodes, "node", "left_semi").select("node", "needs").distinct()
    levels = materialise(nodes.join(own.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0)), "levels")
    for level in range(1, max_rounds):
        # What needs a node of the level below is at least one above it; a later round lifts it further.
        below = levels.filter(F.col("level") == level - 1).select(F.col("node").alias("needs"))
        fresh = own.join(below, "needs", "left_semi").select("node").distinct().withColumn("level", F.lit(level))
        grown = materialise(levels.unionByName(fresh).groupBy("node").agg(F.max("level").alias("level")), "levels")
        more = not grown.filter(F.col("level") == level).isEmpty()
        discard(levels)
        levels = grown
        if not more:
            one = sequence.running_total(levels.withColumn("one", F.lit(1).cast("bigint")), ["level", "node"], "one", "place")
            return one.select("node", "level", "place")
    raise ValueError("the needs go in a circle")


def first_difference(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """Whether two ordered lists are equal, and the first position where they aren't."""
    both = a.select(position, value).join(b.select(position, F.col(value).alias("other")), position, "full")
    differs = ~F.col(value).eqNullSafe(F.col("other"))
    return both.agg(F.count("*").alias("n"), (F.count_if(differs) == 0).alias("equal"), F.min(F.when(differs, F.col(position))).alias("first_difference"))
