"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secret scan, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``docs`` as they are given, extra ones included; names
that stages need for themselves don't clash with them. Stages need the columns
doc_id and text; rows with a null doc_id are judged by their text alone, and
are kept by stages that decide by id.

The stages decide by models and by graphs, which SQL can't express; tests hold
them against brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import decontaminate, minhash, secrets, sentencepiece_bpe, toxicity
from lexiflow.llm.common import held_out, outside, table
from lexiflow.sources.shared import removed, shared_folder

ORACLE_SQL = None
#: Documents that score this or more are rejected.
TOXIC = 0.3
#: Near duplicates: words in a shingle, and the similarity in percent.
WORDS, PERCENT = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose doc_id is among the distinct ``ids``."""
    key = outside(docs, "_dropped")
    return docs.join(ids.select(F.col("doc_id").alias(key)), F.col("doc_id") == F.col(key), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under TOXIC; the model is fitted on what is labelled, but for the held-out part."""
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    tagged = outside(docs, "_tagged")
    scored = docs.withColumn(tagged, toxicity.tagger(field)(F.col("text").cast("string")))
    return scored.where(F.col(f"{tagged}.score") < TOXIC).drop(tagged)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates; rows that repeat an id stay together."""
    classes = minhash.near_duplicates(docs, words=WORDS, percent=PERCENT)
    return without(docs, classes.where("not kept").select("doc_id").distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct())


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of each secret; n_chars, where it was there, counts the new text."""
    spans = outside(docs, "_spans")
    masked = secrets.scan(docs, secrets=spans).withColumn("text", secrets.redacted(F.col("text").cast("string"), F.col(spans))).drop(spans)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the number of these, and whether decoding gives the text again."""
    model = sentencepiece_bpe.read_model(sentencepiece_bpe.default_model_path())
    ids, decoded, mismatches = (outside(docs, n) for n in ("token_ids", "_decoded", "_mismatches"))
    coded = sentencepiece_bpe.encode(docs, model, ids=ids, decoded=decoded, mismatches=mismatches)
    exact = (F.col(decoded) == F.coalesce(F.col("text").cast("string"), F.lit(""))) & (F.col(mismatches) == 0)
    return coded.withColumn(outside(docs, "n_tokens"), F.size(ids).cast("long")).withColumn(outside(docs, "round_trip"), exact).drop(decoded, mismatches)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next one, after which it's removed."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
