"""Dictionary lookup in stages, and exposure profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiflow.sources.shared import checkpointed

# fixed values: letters and what they become when accents are dropped
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"


# fixed value: novelty under which a word is known
KNOWN = 0.2


def plain(w: Column) -> Column:
    return F.translate(w, ACCENTED, PLAIN)


def cascade(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(w, stage, target): exact entry, else one that differs in accents, else one with the same first five letters; 4 and null without any.

    Each stage is an equi-join on its own key; the first stage that finds
    something decides, and of its entries the first in order.
    """
    keys: list[tuple[int, Column]] = [(1, F.col("w")), (2, plain(F.col("w"))), (3, F.when(F.length("w") >= 5, F.substring("w", 1, 5)))]
    targets = entries.select("w").distinct()
    found = []
    for stage, key in keys:
        names = targets.select(key.alias("k"), F.col("w").alias("target")).where("k is not null").groupBy("k").agg(F.min("target").alias("target"))
        found.append(queries.select("w", key.alias("k")).join(names, "k").select("w", F.lit(stage).cast("long").alias("stage"), "target"))
    best = reduce(DataFrame.unionByName, found).groupBy("w").agg(F.min(F.struct("stage", "target")).alias("b"))
    return queries.join(best, "w", "left").select("w", F.coalesce("b.stage", F.lit(4)).cast("long").alias("stage"), F.col("b.target").alias("target"))


def ranked(entries: DataFrame, group: list[str], score: Column, order: list[Column], least: int = 80, margin: int = 16) -> DataFrame:
    """``entries`` with score, rank in its group, and whether it's preferred: first, at ``least`` or more, and ``margin`` above the second."""
    rows = entries.withColumn("score", score)
    w = W.partitionBy(*group).orderBy(F.desc("score"), *order)
    second = F.lead("score").over(w)
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return rows.withColumn("preferred", (F.col("rank") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce(second, F.lit(0)) >= margin))


def exposures(words: DataFrame) -> DataFrame:
    """(w, n): how often each word was met."""
    return words.groupBy("w").agg(F.count("*").alias("n"))


def interned(rows: DataFrame, column: str, code: str) -> DataFrame:
    """``rows`` with ``code``: the rank of ``column``, whose values must be distinct, from 1 up.

    Rows are sorted once by range partitions and written with their place in
    them; ranks are that place and what the partitions before hold, whose sizes
    are one row for each partition.
    """
    place = F.monotonically_increasing_id()
    placed = checkpointed(rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("_place", place))
    part, k = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(code, F.col("_before") + k + 1).drop("_part", "_before", "_place")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(w, n): counts of both added; an immutable-table merge."""
    return old.withColumnRenamed("n", "a").join(new.withColumnRenamed("n", "b"), "w", "full_outer").select("w", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


def novelty(words: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc_id, w, times, novelty, known) for each distinct word of a document: 0.5 + 0.5 * exp(-n / 5) of its exposures, 1 without any; under 0.55 it's known."""
    own = words.groupBy("doc_id", "w").agg(F.count("*").alias("times"))
    rows = own.join(profile, "w", "left").withColumn("novelty", F.round(0.5 + 0.5 * F.exp(-F.coalesce("n", F.lit(0)) / F.lit(5.0)), 6))
    return rows.select("doc_id", "w", "times", "novelty", (F.col("novelty") < 0.55).alias("known"))


def fold_confidence(events: DataFrame, known: str, unknown: str) -> DataFrame:
    """(user_id, confidence): in order of time, a ``known`` event adds 0.8 up to 1, an ``unknown`` one takes 0.2 down to 0."""
    steps = events.where(F.col("event_type").isin(known, unknown)).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_type") == known).alias("up")))).alias("e"))
    value = F.aggregate("e", F.lit(0.0), lambda s, x: F.when(x["up"], F.least(F.lit(1.0), s + 0.8)).otherwise(F.greatest(F.lit(0.0), s - 0.2)))
    return steps.select("user_id", F.round(value, 6).alias("confidence"))


def stats(entries: DataFrame, keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """(dict, entries, aliases, forms, readings): what each dictionary holds; null where it has no key or alias."""
    count = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("value")))
    out = entries.groupBy("dict").agg(F.count("*").alias("entries"))
    return out.join(aliases.groupBy("dict").agg(F.count("*").alias("aliases")), "dict", "left").join(keys.groupBy("dict").agg(count("form").alias("forms"), count("reading").alias("readings")), "dict", "left")


def search_feed(keys: DataFrame) -> DataFrame:
    """(dict, entry_id, feed): the distinct form keys of each entry, in order, in one string."""
    return keys.where("kind = 'form'").groupBy("dict", "entry_id").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("feed"))


def trigrams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3))))


def substring_search(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, dict, entry_id) of the entries whose headword holds what's wanted, of three letters or more.

    A query looks up its rarest trigram only, so that common ones make no long
    lists; what is found there is checked in full.
    """
    index = entries.where(F.length("headword") >= 3).select("dict", "entry_id", "headword", F.explode(trigrams(F.col("headword"))).alias("gram"))
    sizes = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = queries.where(F.length("wanted") >= 3).select("query_id", "wanted", F.explode(trigrams(F.col("wanted"))).alias("gram")).join(sizes, "gram", "left")
    rarest = asked.groupBy("query_id", "wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return rarest.join(index, "gram").where(F.contains("headword", "wanted")).select("query_id", "dict", "entry_id")


def scored_novelty(words: DataFrame, profile: DataFrame, characters: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, w, times, novelty, known): half of it falls with the exposures of a word, half with what ``characters`` (w, confidence) says of it.

    Words among ``known`` (w) aren't new at all; under KNOWN a word counts as known.
    """
    own = words.groupBy("doc_id", "w").agg(F.count("*").alias("times"))
    rows = own.join(profile, "w", "left").join(characters, "w", "left").join(known.select("w").withColumn("_known", F.lit(True)), "w", "left")
    value = 0.5 * (1 - F.coalesce("confidence", F.lit(0.0))) + 0.5 * F.exp(-F.coalesce("n", F.lit(0)) / F.lit(5.0))
    rows = rows.withColumn("novelty", F.when(F.col("_known"), 0.0).otherwise(F.round(value, 6)))
    return rows.select("doc_id", "w", "times", "novelty", (F.col("novelty") < KNOWN).alias("known"))
