"""Occurrences (doc_id, id, start, end) against chains and units of the same texts; ranges meet in bins, see ``quality.overlapping``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.quality import overlapping


def expanded(found: DataFrame, chains: DataFrame) -> DataFrame:
    """(doc_id, id, start, end, absorbed): each occurrence stretched over the chains that it touches, and whether it lies within one."""
    pairs = overlapping(found, chains, ["doc_id"])
    inside = (F.col("r.start") <= F.col("l.start")) & (F.col("r.end") >= F.col("l.end"))
    sums = pairs.groupBy("doc_id", F.col("l.id").alias("id")).agg(F.min("r.start").alias("_a"), F.max("r.end").alias("_b"), F.some(inside).alias("absorbed"))
    rows = found.select("doc_id", "id", "start", "end").join(sums, ["doc_id", "id"], "left")
    return rows.select("doc_id", "id", F.least("start", "_a").alias("start"), F.greatest("end", "_b").alias("end"), F.coalesce("absorbed", F.lit(False)).alias("absorbed"))


def attached(found: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """(doc_id, unit, id, badge): each occurrence on each unit that it touches; the badge is on those in which it begins."""
    pairs = overlapping(found, units, ["doc_id"])
    badge = (F.col("l.start") >= F.col("r.start")) & (F.col("l.start") < F.col("r.end"))
    return pairs.select("doc_id", F.col(f"r.{unit}").alias(unit), F.col("l.id").alias("id"), badge.alias("badge"))


def widest(found: DataFrame, chains: DataFrame, chain: str) -> DataFrame:
    """(doc_id, id, chain): the widest chain that an occurrence lies in, the first of equal ones."""
    pairs = overlapping(found, chains, ["doc_id"]).where((F.col("r.start") <= F.col("l.start")) & (F.col("r.end") >= F.col("l.end")))
    width = F.struct((F.col("r.end") - F.col("r.start")).alias("w"), (-F.col(f"r.{chain}")).alias("c"))
    return pairs.groupBy("doc_id", F.col("l.id").alias("id")).agg(F.max_by(F.col(f"r.{chain}"), width).alias(chain))
