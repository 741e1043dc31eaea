"""The engine as one object, and its functions by name for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions import scalars
from lexiflow.operators import catalog, dictionary, html, lookup, markdown, matching, quality, text
from lexiflow.streaming import session

#: SQL names of Arrow functions.
FUNCTIONS = {"lex_nfkc": scalars.nfkc, "lex_canonical_json": scalars.canonical_json, "lex_json_diff": scalars.json_diff, "lex_opcodes": scalars.opcodes, "lex_prepared": scalars.prepared, "lex_pieces": text.pieces_of, "lex_html_blocks": html.blocks_of, "lex_sanitized": html.sanitized, "lex_reader_blocks": markdown.blocks_of}


class Words:
    """Table function: (pos, sent, word) of a text."""

    def eval(self, text: str):
        words, sentences = matching.words_of(text)
        for k, (w, s) in enumerate(zip(words, sentences)):
            yield k, s, w


def register(spark: SparkSession) -> None:
    """Make the functions, and the table function ``lex_words``, known to the session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("sent", T.LongType()), T.StructField("word", T.StringType())])
    spark.udtf.register("lex_words", F.udtf(Words, returnType=schema))


class Engine:
    """Analysis, lookup, sessions and comparison over DataFrames; it holds a session and rules, and no data."""

    def __init__(self, spark: SparkSession, rules: list[matching.Rule] | None = None):
        self.spark = spark
        self.rules = list(rules or [])
        register(spark)

    def analyse(self, docs: DataFrame) -> dict[str, DataFrame]:
        """Segments, tokens, sentences and expressions of (doc_id, text)."""
        found = {"segments": text.segments(docs), "tokens": text.tokens(docs), "sentences": text.sentences(docs)}
        if self.rules:
            found["expressions"] = matching.matches(docs, self.rules)
        return found

    def open(self, docs: DataFrame, lines_each: int, target: int) -> DataFrame:
        """(doc_id, chunk, start, text, batch) of a progressive session."""
        parts = session.chunks(docs, lines_each)
        return parts.join(session.batches(parts, target), ["doc_id", "chunk"])

    def novelty(self, docs: DataFrame, profile: DataFrame) -> DataFrame:
        return dictionary.novelty(text.words(docs), profile)

    def lookup(self, queries: DataFrame, entries: DataFrame, keys: DataFrame, aliases: DataFrame, order: DataFrame | None = None) -> DataFrame:
        """Entries of each query; with an order of dictionaries, those of the best form in that order."""
        return lookup.lookup(queries, entries, keys, aliases) if order is None else lookup.matrix(queries, entries, keys, aliases, order)

    def search(self, bundles: DataFrame, **wanted) -> DataFrame:
        """Concepts of a rule catalogue."""
        return catalog.search(catalog.search_index(catalog.expanded(bundles)), **wanted)

    def compare(self, before: DataFrame, after: DataFrame, needs: DataFrame) -> DataFrame:
        """Changes of two snapshots and their causes."""
        return quality.causes(quality.changes(before, after), needs)
