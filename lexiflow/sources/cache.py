"""Stage cache: results by hash of their source and fingerprint of the code, and pruning of old ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lexiflow.sources.shared import removed


def key(source: str, fingerprint: str) -> str:
    return hashlib.sha256(f"{len(source)}:{source}{fingerprint}".encode()).hexdigest()


def cached(spark: SparkSession, folder: str, source: str, fingerprint: str, compute: Callable[[], DataFrame], columns: list[str] | None = None) -> DataFrame:
    """The stored result for this source and fingerprint; computed and stored if there's none, if it can't be read, or if it hasn't the ``columns``.

    A stored result is read once in full, so that a damaged file is found here and replaced, not in the middle of a later job.
    """
    path = f"{folder}/key={key(source, fingerprint)}"
    try:
        found = spark.read.parquet(path)
        if columns is None or found.columns == columns:
            found.write.format("noop").mode("overwrite").save()
            return found
    except AnalysisException:
        pass  # nothing there, or no schema in it
    except Exception as e:  # noqa: BLE001  (Spark reports a damaged file as a failed job)
        if not any(x in str(e) for x in ("FAILED_READ_FILE", "CANNOT_READ_FILE", "is not a Parquet file", "Parquet", "FileNotFound", "FILE_NOT_EXIST")):
            raise
    removed(spark, path)
    compute().write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def pruned(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Remove all but the ``keep`` results that were stored last; gives what went."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    held = sorted(((-s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(base) if s.isDirectory() and s.getPath().getName().startswith("key=")))
    for _, path in held[keep:]:
        removed(spark, path)
    return [p for _, p in held[keep:]]
