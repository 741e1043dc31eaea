"""Contextual dictionary lookup as joins: stages of keys, aliases and readings, scores, forms and their availability.

Tables: ``entries`` (dict, entry_id, record_index, headword, reading, kind,
labels, forms, content), ``keys`` (dict, entry_id, kind, value, rank) with kinds
``form`` and ``reading``, ``aliases`` (dict, alias, target), ``queries``
(query_id, headword, reading, pos, observed). Keys and headwords of queries are
compared in their normal form. All steps are equi-joins on keys that both sides
have, so a query never meets more than the entries that share its key; of one
key and dictionary ``MOST`` entries count at most, by rank and id, which is the
lookup's own rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiflow.functions import scalars
from lexiflow.sources.shared import checkpointed

#: Entries of one key in one dictionary.
MOST = 10
# fixed values: scores of match types, kinds and evidence; words that mark parts of speech; rows of inflection
MATCH = {"exact_headword": 180, "exact_form": 160, "explicit_alias": 120, "compatibility_alias": 105, "reading_fallback": 55, "fuzzy": 10}
OTHER_MATCH, SAME_FORM, SAME_READING, OTHER_READING = 80, 45, 30, -45
POS_SCORE = {"exact": 24, "compatible": 12, "conflict": -20}
KINDS = {"kanji": -80, "surname": -65, "prefix": -75, "suffix": -75, "bound_morpheme": -75, "navigation": -120, "redirect": -120}
HYPHEN, PREFERRED, MARGIN = -60, 80, 16
MARKERS = {"動詞": ["動"], "形容詞": ["形"], "副詞": ["副"], "連体詞": ["連体"], "接続詞": ["接続", "接"], "名詞": ["名", "姓"], "助詞": ["助詞"], "助動詞": ["助動"], "感動詞": ["感"]}
ROWS = {"ウ": "ワイウエオッ", "ク": "カキクケコイッ", "グ": "ガギグゲゴイッ", "ス": "サシスセソ", "ツ": "タチツテトッ", "ヌ": "ナニヌネノン", "ブ": "バビブベボン", "ム": "マミムメモン", "ル": "ラリルレロッ"}
SEEDS = {"observed": 240, "query": 180, "reading": 40, "observed_surface": 1000, "query_surface": 700, "context_query": 2000, "context_observed": 3000}
NAVIGATION = ("navigation", "redirect")


def substantive(kind: Column) -> Column:
    return ~kind.isin(*NAVIGATION)


def reading_candidates(headword: Column, reading: Column) -> Column:
    """Readings to try: the given one and, where the headword's last kana differs from its last mora, one with that ending."""
    normal = scalars.normalized_reading(reading)
    ending = F.when(F.substring(headword, -1, 1).rlike(r"^[\x{3041}-\x{30FF}]$"), scalars.to_katakana(F.substring(headword, -1, 1)))
    last = F.substring(normal, -1, 1)
    rows = F.lit("")
    for k, row in ROWS.items():
        rows = F.when(ending == k, row).otherwise(rows)
    changed = F.when(F.contains(rows, last), F.concat(F.substring(normal, F.lit(1), F.length(normal) - 1), ending)).otherwise(F.concat(normal, ending))
    second = F.when(ending.isNotNull() & (last != ending) & last.rlike(r"^[\x{30A1}-\x{30FF}]$"), changed)
    return F.array_compact(F.array(normal, second))


def pos_match(pos: Column, kind: Column, labels: Column) -> Column:
    """exact, compatible, conflict or unknown: labels hold a mark of the part of speech; without labels the entry's kind decides; set phrases say nothing."""
    marks = F.lit(None).cast("array<string>")
    for k, m in MARKERS.items():
        marks = F.when(pos == k, F.array(*map(F.lit, m))).otherwise(marks)
    bare = F.when((kind == "surname") & (pos == "名詞"), "compatible").when(kind.isin("surname", "kanji", "prefix", "suffix", "bound_morpheme"), "conflict").otherwise("unknown")
    held = F.when(F.exists(labels, lambda x: F.exists(marks, lambda m: F.contains(x, m))), "exact").otherwise("conflict")
    return F.when(pos.isNull(), "unknown").when(F.coalesce(F.size(labels), F.lit(0)) <= 0, bare).when(F.forall(labels, lambda x: F.contains(x, F.lit("連語"))), "unknown").when(marks.isNull(), "unknown").otherwise(held)


def by_key(wanted: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """``wanted`` (value and more) with (dict, entry_id): the first MOST entries of each dictionary by rank and id."""
    w = W.partitionBy("dict", "value").orderBy("rank", "entry_id")
    # ranked once for each key, however many queries ask for it
    own = keys.where(F.col("kind") == kind).join(wanted.select("value").distinct(), "value", "left_semi")
    own = own.groupBy("dict", "value", "entry_id").agg(F.min("rank").alias("rank")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= MOST)
    return wanted.join(own.select("value", "dict", "entry_id"), "value")


def exact(wanted: DataFrame, keys: DataFrame, entries: DataFrame) -> DataFrame:
    """``wanted`` (value, headword and more) with (dict, entry_id): by form keys, and in dictionaries without such a key by the headword itself."""
    found = by_key(wanted, keys, "form")
    heads = entries.select(F.col("headword"), "dict", "entry_id")
    by_head = wanted.join(heads, "headword").join(found.select("value", "dict").distinct(), ["value", "dict"], "left_anti")
    w = W.partitionBy("dict", "value", "headword").orderBy("entry_id")
    by_head = by_head.withColumn("k", F.dense_rank().over(w)).where(F.col("k") <= MOST).drop("k")
    return found.unionByName(by_head.select(*found.columns))


def discovered(queries: DataFrame, entries: DataFrame, keys: DataFrame, aliases: DataFrame, compatible: DataFrame | None = None) -> DataFrame:
    """(query_id, dict, entry_id, match_type): exact forms, then targets of aliases; readings in dictionaries where neither gives an entry that can be read.

    ``compatible`` (alias, target) is for queries that find nothing at all.
    """
    q = queries.where("headword <> ''").withColumn("value", scalars.normalized_form(F.col("headword")))
    q = q.withColumn("wanted", F.coalesce(F.nullif(F.nullif("reading", F.lit("*")), F.lit("")), F.when(scalars.is_kana(F.col("headword")), F.col("headword"))))
    q = checkpointed(q)
    direct = checkpointed(exact(q.select("query_id", "value", "headword"), keys, entries).select("query_id", "dict", "entry_id"))
    hops = aliases.select("dict", F.explode(F.array_distinct(F.array("alias", scalars.normalized_form(F.col("alias"))))).alias("value"), "target").distinct()
    hops = q.select("query_id", F.explode(F.array_distinct(F.array("headword", "value"))).alias("value")).join(hops, "value").select("query_id", "dict", "target").distinct()
    targets = hops.select("query_id", F.col("dict").alias("own"), F.col("target").alias("headword"), scalars.normalized_form(F.col("target")).alias("value"))
    hopped = checkpointed(exact(targets, keys, entries).where("dict = own").select("query_id", "dict", "entry_id").distinct())
    facts = entries.select("dict", "entry_id", substantive(F.col("kind")).alias("real"), "content", F.col("reading").alias("own_reading"), "forms")
    wanted = q.select("query_id", "headword", "wanted", F.col("value").alias("form"))
    enough = direct.join(facts, ["dict", "entry_id"]).where("real and content").select("query_id", "dict")
    read = hopped.join(facts, ["dict", "entry_id"]).join(wanted, "query_id")
    same = F.col("wanted").isNull() | (scalars.normalized_reading(F.col("own_reading")) == scalars.normalized_reading(F.col("wanted")))
    enough = enough.unionByName(read.where(F.col("real") & same).select("query_id", "dict")).distinct()
    tried = wanted.where("wanted is not null").select("query_id", "headword", "form", F.posexplode(reading_candidates(F.col("headword"), F.col("wanted"))).alias("try", "value"))
    back = by_key(tried, keys, "reading").join(enough, ["query_id", "dict"], "left_anti").join(facts.select("dict", "entry_id", "forms"), ["dict", "entry_id"])
    back = back.where(scalars.is_kana(F.col("headword")) | F.exists("forms", lambda f: matched(f, F.col("form"))))
    first = back.groupBy("query_id", "dict").agg(F.min("try").alias("try"))
    back = back.join(first, ["query_id", "dict", "try"]).select("query_id", "dict", "entry_id")
    stages = [df.withColumn("stage", F.lit(n)) for n, df in enumerate((direct, hopped, back))]
    types = F.element_at(F.array(F.lit("exact_form"), F.lit("explicit_alias"), F.lit("reading_fallback")), F.col("stage") + 1)
    found = reduce(DataFrame.unionByName, stages).groupBy("query_id", "dict", "entry_id").agg(F.min("stage").alias("stage")).select("query_id", "dict", "entry_id", types.alias("match_type"))
    if compatible is None:
        return found
    found = checkpointed(found)
    left = q.join(found.select("query_id").distinct(), "query_id", "left_anti").join(compatible.select(scalars.normalized_form(F.col("alias")).alias("value"), "target"), "value")
    last = exact(left.select("query_id", F.col("target").alias("headword"), scalars.normalized_form(F.col("target")).alias("value")), keys, entries)
    return found.unionByName(last.select("query_id", "dict", "entry_id").distinct().withColumn("match_type", F.lit("compatibility_alias")))


def matched(form: Column, wanted: Column) -> Column:
    """Whether a form and a query's are the same but for spaces, dashes and kana."""
    plain = lambda c: scalars.to_hiragana(F.translate(c, scalars.JOINERS, ""))
    return plain(form) == plain(wanted)


def scored(found: DataFrame, queries: DataFrame, entries: DataFrame) -> DataFrame:
    """``found`` with score, reading_match, pos_match, rank and preferred: the best real entry of a dictionary, if its score is high enough and clear of the second."""
    rows = found.join(queries.select("query_id", F.col("headword").alias("query"), F.col("reading").alias("asked"), "pos"), "query_id").join(entries, ["dict", "entry_id"])
    asked = F.coalesce(F.nullif(F.nullif("asked", F.lit("*")), F.lit("")), F.when(scalars.is_kana(F.col("query")), F.col("query")))
    dashed = lambda c: F.col(c).startswith("-") | F.col(c).endswith("-")
    match = reduce(lambda c, m: c.when(F.col("match_type") == m[0], m[1]), MATCH.items(), F.when(F.lit(False), 0)).otherwise(OTHER_MATCH)
    normal = scalars.normalized_form(F.col("query"))
    form = F.when((scalars.normalized_form(F.col("headword")) == normal) | (scalars.normalized_form(F.get("forms", F.lit(0))) == normal), SAME_FORM).otherwise(0)
    reading = F.when(asked.isNull() | F.col("reading").isNull(), "absent").when(scalars.normalized_reading(F.col("reading")) == scalars.normalized_reading(asked), "exact").otherwise("conflict")
    bound = F.col("kind").isin("prefix", "suffix", "bound_morpheme")
    kind = F.when(bound & dashed("query"), 0)
    for k, v in KINDS.items():
        kind = kind.when(F.col("kind") == k, v)
    hyphen = F.when(F.coalesce(dashed("reading"), F.lit(False)) & ~dashed("query"), HYPHEN).otherwise(0)
    rows = rows.withColumn("reading_match", reading).withColumn("pos_match", pos_match(F.col("pos"), F.col("kind"), F.col("labels")))
    read = F.when(F.col("reading_match") == "exact", SAME_READING).when(F.col("reading_match") == "conflict", OTHER_READING).otherwise(0)
    pos = reduce(lambda c, m: c.when(F.col("pos_match") == m[0], m[1]), POS_SCORE.items(), F.when(F.lit(False), 0)).otherwise(0)
    rows = rows.withColumn("score", (match + form + read + pos + kind.otherwise(0) + hyphen).cast("long"))
    order = [F.desc("score"), F.col("dict"), F.col("record_index")]
    own = W.partitionBy("query_id", "dict").orderBy(F.col("kind").isin(*NAVIGATION), *order)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))
    # entries of mere navigation count only where a dictionary has no others
    second = F.when(F.lead(F.col("kind").isin(*NAVIGATION)).over(own) == F.col("kind").isin(*NAVIGATION), F.lead("score").over(own))
    rows = rows.withColumn("preferred", (F.row_number().over(own) == 1) & (F.col("score") >= PREFERRED) & (second.isNull() | (F.col("score") - second >= MARGIN)))
    return rows.drop("query", "asked", "pos")


def lookup(queries: DataFrame, entries: DataFrame, keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, dict, entry_id, match_type, reading_match, pos_match, score, rank, preferred and the entry's columns) of all entries of each query."""
    return scored(discovered(queries, entries, keys, aliases), queries, entries)


def seeds(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, normal, display, score, dicts, readings): forms of the entries that can be read as asked, with the best score of each.

    What was observed and what was asked for raise their own forms; of a form's
    spellings the best one is displayed.
    """
    q = queries.select("query_id", F.col("headword").alias("query"), "observed", F.coalesce(F.nullif(F.nullif("reading", F.lit("*")), F.lit("")), F.when(scalars.is_kana(F.col("headword")), F.col("headword"))).alias("wanted"))
    rows = found.where(substantive(F.col("kind"))).join(q, "query_id")
    rows = rows.where(F.col("wanted").isNull() | F.col("reading").isNull() | (scalars.normalized_reading(F.col("reading")) == scalars.normalized_reading(F.col("wanted"))))
    rows = rows.select("query_id", "dict", "reading", "score", "query", "observed", F.explode("forms").alias("form"))
    rows = rows.withColumns({"normal": scalars.form_identity(F.col("form")), "q": scalars.form_identity(F.col("query")), "o": scalars.form_identity(F.col("observed"))}).where("normal <> ''")
    points = [(F.col("normal") == F.col("o"), "observed"), (F.col("normal") == F.col("q"), "query"), (F.lit(True), "reading"), (F.col("form") == F.col("observed"), "observed_surface"), (F.col("form") == F.col("query"), "query_surface")]
    rows = rows.withColumn("points", (F.col("score") + sum(F.when(c, SEEDS[n]).otherwise(0) for c, n in points)).cast("long"))
    context = F.greatest(F.when(F.first("o") == F.col("normal"), SEEDS["context_observed"]).otherwise(0), F.when(F.first("q") == F.col("normal"), SEEDS["context_query"]).otherwise(0))
    best = F.max(F.struct("points", "form"))
    grouped = rows.groupBy("query_id", "normal").agg(F.greatest(F.max("points"), context.cast("long")).alias("score"), best["form"].alias("form"), F.array_sort(F.collect_set("dict")).alias("dicts"), F.array_sort(F.collect_set("reading")).alias("readings"), F.first("q").alias("q"), F.first("o").alias("o"), F.first("query").alias("query"), F.first("observed").alias("observed"))
    display = F.when(F.col("o") == F.col("normal"), F.col("observed")).when(F.col("q") == F.col("normal"), F.col("query")).otherwise(F.col("form"))
    return grouped.select("query_id", "normal", display.alias("display"), "score", "dicts", "readings")


def form_groups(seeds_: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """``seeds_`` with ``availability``, one flag for each of the given dictionaries in their order, and ``place`` by score, then by how many have the form.

    The dictionaries (dict, place) are few by nature; each seed carries its own, so no seed is crossed with them.
    """
    names = [r[0] for r in dictionaries.orderBy("place", "dict").select("dict").collect()]
    flags = F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(n.alias("dict"), F.array_contains("dicts", n).alias("available")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("dicts")), "normal")
    return seeds_.withColumn("availability", flags).withColumn("place", F.row_number().over(w).cast("long"))


def user_order(found: DataFrame, order: DataFrame) -> DataFrame:
    """``found`` with ``place``: by the user's order of dictionaries (dict, position; names without regard to case, unknown ones last), then by rank."""
    own = order.select(F.lower("dict").alias("_name"), "position").groupBy("_name").agg(F.min("position").alias("position"))
    rows = found.withColumn("_name", F.lower("dict")).join(own, "_name", "left").drop("_name")
    w = W.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), "rank")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).drop("position")


def matrix(queries: DataFrame, entries: DataFrame, keys: DataFrame, aliases: DataFrame, order: DataFrame) -> DataFrame:
    """(query_id, form, dict, entry_id, score, place): discovery, forms, the best form, and the entries that have it, ranked for it and put in the user's order."""
    found = checkpointed(lookup(queries, entries, keys, aliases))
    active = seeds(found, queries)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("dicts")), "normal")
    active = active.withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", "normal", F.col("display").alias("form"))
    active = checkpointed(active)
    again = exact(active.select("query_id", F.col("form").alias("headword"), scalars.normalized_form(F.col("form")).alias("value")), keys, entries).select("query_id", "dict", "entry_id")
    both = again.withColumn("t", F.lit(0)).unionByName(found.select("query_id", "dict", "entry_id").withColumn("t", F.lit(1)))
    types = both.groupBy("query_id", "dict", "entry_id").agg(F.min("t").alias("t")).join(found.select("query_id", "dict", "entry_id", "match_type"), ["query_id", "dict", "entry_id"], "left")
    types = types.select("query_id", "dict", "entry_id", F.when(F.col("t") == 0, "exact_form").otherwise(F.col("match_type")).alias("match_type"))
    asked = queries.join(active, "query_id").select("query_id", F.col("form").alias("headword"), "reading", "pos")
    rows = scored(types, asked, entries).join(active, "query_id")
    wanted = queries.select("query_id", F.nullif(F.nullif("reading", F.lit("*")), F.lit("")).alias("wanted"))
    rows = rows.join(wanted, "query_id").where(substantive(F.col("kind")) & F.exists("forms", lambda f: matched(f, F.col("form"))))
    rows = rows.where(F.col("wanted").isNull() | F.col("reading").isNull() | (scalars.normalized_reading(F.col("reading")) == scalars.normalized_reading(F.col("wanted"))))
    return user_order(rows, order).select("query_id", "form", "dict", "entry_id", "score", "place")
