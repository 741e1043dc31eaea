"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.sources.shared import checkpointed, shared_folder  # noqa: F401  (operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))


def held_out(id_col: str, of: int, is_: int) -> Column:
    """True where that remainder marks a row as held out; false for a null id."""
    return F.coalesce(remainder(id_col, of) == is_, F.lit(False))


def bounded_sample(df: DataFrame, keys: list[str], limit: int, seed: int = 7) -> tuple[DataFrame, float]:
    """At most about ``limit`` rows, chosen by a hash of ``keys`` alone, and how many rows each stands for.

    The number of rows is counted first, so that the rate fits any input; the
    same rows come out whatever the partitions are. With up to ``limit`` rows
    all are taken.
    """
    n = df.count()
    if n <= limit:
        return df, 1.0
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(steps)) < int(steps * limit / n)), n / limit


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one row for each id; of repeated rows the larger label counts, null ids and labels go."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    return rows.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, clean: int, marked: int) -> DataFrame:
    """(doc_id, y, weight, text) of at most about ``clean`` labelled documents with label 0 and ``marked`` with label 1.

    ``weight`` says how many labelled documents a row stands for, so weighted
    counts have the mix of classes that all labels have, whatever their number.
    The sampled ids are few by construction (clean + marked rows of 20 bytes),
    which is what allows them to be broadcast to the documents.
    """
    rows = label_rows(labels, column).where(learn)
    parts = [bounded_sample(rows.where(F.col("y") == y), ["doc_id"], n) for y, n in ((0, clean), (1, marked))]
    chosen = reduce(DataFrame.unionByName, [df.withColumn("weight", F.lit(weight)) for df, weight in parts])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def released() -> None:
    """Give back what Arrow and C hold without need: a Python worker stays for later tasks and stages, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


def outside(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet (without regard to case)."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted
