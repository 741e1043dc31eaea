"""Sources: driver tables, text selections, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, line): lines counted from 1, with their first code point."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = F.sum(F.length("line") + 1).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.coalesce(before, F.lit(0)).cast("long").alias("start"), "line")


def line_page(docs: DataFrame, page: int, size: int) -> DataFrame:
    """The lines of one page of every document."""
    return lines(docs).where(F.col("line_no").between((page - 1) * size + 1, page * size))


def sampled_lines(docs: DataFrame, every: int) -> DataFrame:
    """Every n-th line, blank ones left out."""
    return lines(docs).where(((F.col("line_no") - 1) % every == 0) & (F.trim("line") != ""))


def chapter(docs: DataFrame, title: str) -> DataFrame:
    """(doc_id, line_no, line) of the section under the exact heading ``## title``, up to the next one."""
    rows = lines(docs).withColumn("n", F.sum(F.col("line").startswith("## ").cast("int")).over(W.partitionBy("doc_id").orderBy("line_no")))
    named = rows.where(F.col("line") == f"## {title}").groupBy("doc_id").agg(F.min("n").alias("n"))
    return rows.join(named, ["doc_id", "n"]).where(~F.col("line").startswith("## ")).select("doc_id", "line_no", "line")


def dictionary_records(spark: SparkSession, path: str) -> DataFrame:
    """(headword, reading, definition, target) of a text dictionary: records end with a line ``</>``; a definition ``@@@LINK=x`` is an alias of x."""
    records = spark.read.text(path, lineSep="</>\n").where(F.trim("value") != "")
    head = F.split(F.element_at(F.split("value", "\n"), 1), "\t")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"^\s+|\s+$", "")
    link = F.regexp_extract(body, r"^@@@LINK=([^\n]*)", 1)
    return records.select(head[0].alias("headword"), F.get(head, F.lit(1)).alias("reading"), F.when(link == "", body).alias("definition"), F.when(link != "", F.trim(link)).alias("target"))
