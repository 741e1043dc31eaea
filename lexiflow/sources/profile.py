"""A user's profile as tables: what was met, what is known, choices and rules. A table that isn't there yet is empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "exposures": "base string, reading string, pos string, count long, last_seen timestamp",
    "kanji": "kanji string, reading string, confidence double, source_words array<string>",
    "choices": "surface string, parts array<string>, selected_at timestamp",
    "rules": "rule_id string, pattern string, label string, enabled boolean",
    "dictionary_order": "dict string, position int",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; one whose columns aren't those of TABLES is refused."""
    empty = spark.createDataFrame([], TABLES[name])
    try:
        found = spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return empty
    if found.columns != empty.columns:
        raise ValueError(f"{name} has the columns {found.columns}")
    return found


def write(rows: DataFrame, folder: str, name: str) -> None:
    """Replace a table; the rows may come from the table itself, which stays whole until the new one is written beside it."""
    from lexiflow.sources.shared import removed

    spark = rows.sparkSession
    rows = rows.select(*spark.createDataFrame([], TABLES[name]).columns)
    rows.write.mode("overwrite").parquet(f"{folder}/{name}.new")
    spark.read.parquet(f"{folder}/{name}.new").write.mode("overwrite").parquet(f"{folder}/{name}")
    removed(spark, f"{folder}/{name}.new")
