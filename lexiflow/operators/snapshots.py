"""Snapshot diffs: keyed changes, churn with its interval, causes, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.sources.shared import checkpointed

# fixed value: the normal quantile of a 95 % interval
Z = 1.959963984540054


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, operation, changed): added, removed, modified or stable, and the names of the fields that differ."""
    a, b = (df.select(F.col(key), F.struct(*fields).alias(n)) for df, n in ((before, "a"), (after, "b")))
    rows = a.join(b, key, "full_outer")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])), ",")
    operation = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(changed != "", "modified").otherwise("stable")
    return rows.select(key, operation.alias("operation"), F.when(operation == "modified", changed).otherwise("").alias("changed"))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, rounded to 8 digits; 0 and 0 without rows."""
    n = F.nullif(n, F.lit(0.0))
    p = hits / n
    middle, spread = p + F.lit(Z * Z) / (2 * n), Z * F.sqrt(p * (1 - p) / n + F.lit(Z * Z) / (4 * n * n))
    low, high = ((middle + s * spread) / (1 + Z * Z / n) for s in (-1, 1))
    none = F.when(n.isNull(), 0.0)
    return none.otherwise(F.round(F.greatest(low, F.lit(0.0)), 8)), none.otherwise(F.round(F.least(high, F.lit(1.0)), 8))


def churn(changes: DataFrame, by: str) -> DataFrame:
    """(by, n, changed, rate, low, high): the share of keys that aren't stable."""
    rows = changes.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col("operation") != "stable").cast("long")).alias("changed"))
    low, high = wilson(F.col("changed").cast("double"), F.col("n").cast("double"))
    return rows.select(by, "n", "changed", F.round(F.col("changed") / F.col("n"), 8).alias("rate"), low.alias("low"), high.alias("high"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, distance) of (child, parent): the shortest way up from each node, however long; a node on a cycle is its own ancestor.

    Known ways are joined with each other, so that each round doubles the
    length that is covered; rounds end when none gets shorter or is new.
    """
    known = checkpointed(edges.where("child is not null and parent is not null").select("child", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct())
    state = None
    while True:
        now = known.agg(F.count("*"), F.sum("distance")).first()
        if now == state:
            return known
        state = now
        up = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        longer = known.join(up, "ancestor").select("child", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        known = checkpointed(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))


def impacts(up: DataFrame) -> DataFrame:
    """(root, affected, depth) of a closure: how many nodes each one reaches, and the farthest."""
    return up.groupBy(F.col("ancestor").alias("root")).agg(F.count_distinct("child").alias("affected"), F.max("distance").alias("depth"))
