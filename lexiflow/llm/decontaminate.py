"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits in lower case. Each window of ``SPAN``
words gives one hash for each mask; a mask's zeros are places whose word is
ignored, so a hash survives words that have been replaced there. Hashes of
documents are looked up among those of the benchmark; around each hit the two
texts are laid side by side (the hit's diagonal) and the best run is found,
where a matching word counts 1 and a replaced one -2. A run is an overlap if
that score reaches ``LEAST``, or ``SHARE`` of the item's words for short items.

Items of 5 to SPAN - 1 words are looked up by runs of so few words that each
overlap by that rule contains one (see ``unbroken``); items with fewer words
never match. Items with the same words are looked up once and
named by their smallest id. The benchmark is taken in blocks of at most
``BLOCK`` hashes, each of which is broadcast, so that its size is bounded for
any benchmark; only hits are shuffled.

Null and empty texts overlap with nothing; long ones are read whole; documents
and items with a null id are reported under the null id; repeated rows count
once; of equally good runs the one farthest left counts. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, table

# fixed values: 1 marks a word that counts, 0 one that is ignored
MASKS = ("11101101", "110010111", "1010011011")
SPAN = max(map(len, MASKS))
FEWEST = 5
LEAST, SHARE = 10, 0.6
MISMATCH = -2
#: Hashes of the benchmark that are broadcast at a time (about 40 bytes each).
BLOCK = 500_000
#: Bytes of items, or of hits with their items' words, that are broadcast at most; beyond that they're shuffled.
BYTES = 32_000_000
#: Documents with hits (24 bytes each) whose ids are broadcast at most.
DOCUMENTS = 1_000_000


def unbroken(n: int) -> int:
    """The longest run of matching words that every overlap with an item of ``n`` words has, n under SPAN: with j replaced words, the matching ones lie in j + 1 runs."""
    least = ceil(n * SHARE)
    return min(ceil((least - MISMATCH * j) / (j + 1)) for j in range(n) if least - MISMATCH * j + j <= n)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, hashes: str, masks: tuple[str, ...], keep: list[str]) -> DataFrame:
    """``keep`` and (pos, seed) for each mask at each window; pos counts from 0."""
    span = max(map(len, masks))
    n = F.greatest(F.size(hashes) - (span - 1), F.lit(0))
    windows = F.arrays_zip(*[F.slice(F.col(hashes), k + 1, n).alias(f"w{k}") for k in range(span)])
    rows = df.select(*keep, F.posexplode(windows).alias("pos", "w"))
    each = [F.xxhash64(F.lit(n), *[F.col(f"w.w{k}") for k, c in enumerate(m) if c == "1"]) for n, m in enumerate(masks)]
    return rows.select(*keep, "pos", F.explode(F.array(*each)).alias("seed"))


def best_run(doc: Column, item: Column, shift: Column) -> Column:
    """Struct of score, item_start, item_end, matched for the best run of ``item`` laid at ``shift`` (its first word's place in ``doc``)."""
    first = F.greatest(F.lit(0), -shift)
    n = F.least(F.size(item), F.size(doc) - shift) - first
    pairs = F.zip_with(F.slice(doc, first + shift + 1, n), F.slice(item, first + 1, n), lambda a, b: a == b)
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("begin"), F.lit(0).alias("hits"), F.lit(0).alias("at"), F.struct(F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("matched")).alias("top"))

    def step(s: Column, same: Column) -> Column:
        fresh = s["score"] <= 0
        score = F.when(fresh, 0).otherwise(s["score"]) + F.when(same, 1).otherwise(MISMATCH)
        begin = F.when(fresh, s["at"]).otherwise(s["begin"])
        hits = F.when(fresh, 0).otherwise(s["hits"]) + same.cast("int")
        here = F.struct(score.alias("score"), begin.alias("start"), (s["at"] + 1).alias("end"), hits.alias("matched"))
        return F.struct(score.alias("score"), begin.alias("begin"), hits.alias("hits"), (s["at"] + 1).alias("at"), F.when(score > s["top"]["score"], here).otherwise(s["top"]).alias("top"))

    def done(s: Column) -> Column:
        t = s["top"]
        return F.struct(t["score"].alias("score"), (t["start"] + first).alias("item_start"), (t["end"] + first).alias("item_end"), t["matched"].alias("matched"))

    return F.aggregate(pairs, start, step, done)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that overlap: the best run, as word places in both, its score and its number of matching words."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), hashed_words(F.col(item_text_col)).alias("item")).where(F.size("item") >= FEWEST)
    items = items.groupBy("item").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")).withColumn("key", F.xxhash64("item"))  # of the words, as ids can be null or repeat
    # the text's own hash keeps apart rows that repeat an id or have none
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    given = texts.select("doc_id", "own", hashed_words(F.col("text")).alias("h"))
    items = checkpointed(items)
    lengths = items.groupBy(F.least(F.size("item"), F.lit(SPAN))).agg(F.sum(F.size("item"))).collect()  # at most SPAN rows
    passes = sum(-(-n * (len(MASKS) if length == SPAN else 1) // BLOCK) for length, n in lengths)
    if passes > 1:
        given = checkpointed(given)  # words are hashed once, however often they're looked at
    found = []
    for n, total in sorted(tuple(r) for r in lengths):
        masks = MASKS if n == SPAN else ("1" * unbroken(n),)
        blocks = -(-total * len(masks) // BLOCK)
        for k in range(blocks):
            own = items.where((F.least(F.size("item"), F.lit(SPAN)) == n) & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == k))
            known = seeds(own, "item", masks, ["key"]).withColumnRenamed("pos", "item_pos")
            hits = seeds(given, "h", masks, ["doc_id", "own"]).join(F.broadcast(known), "seed")
            found.append(hits.select("doc_id", "own", "key", (F.col("pos") - F.col("item_pos")).alias("shift")))
    if not found:
        return docs.sparkSession.createDataFrame([], RESULT)
    hits = checkpointed(reduce(DataFrame.unionByName, found).distinct())
    size = F.size("item").cast("long") * 8 + 100
    held = items.agg(F.sum(size)).first()[0]
    # a hit needs its item's words; while all items are small they go to the hits, so that an item in many documents is no hot key
    beside = hits.join(F.broadcast(items) if held <= BYTES else items, "key")
    total = beside.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    beside = beside.groupBy("doc_id", "own").agg(F.collect_list(F.struct("key", "item_id", "copies", "item", "shift")).alias("hits"))
    wanted = hits.select("doc_id", "own").distinct()
    if total <= BYTES:
        beside = F.broadcast(beside)
    else:  # only documents with hits are shuffled
        ids = checkpointed(wanted)
        few = F.broadcast(ids) if ids.count() <= DOCUMENTS else ids
        texts = texts.alias("t").join(few.alias("w"), F.expr("t.doc_id <=> w.doc_id and t.own = w.own"), "left_semi")
    both = texts.alias("t").join(beside.alias("b"), F.expr("t.doc_id <=> b.doc_id and t.own = b.own")).select("t.doc_id", "hits", hashed_words(F.col("text")).alias("h"))

    def verified(h: Column) -> Column:
        return F.struct(h["key"].alias("key"), h["item_id"].alias("item_id"), h["copies"].alias("copies"), F.size(h["item"]).alias("item_words"), h["shift"].alias("shift"), best_run(F.col("h"), h["item"], h["shift"]).alias("run"))

    runs = both.select("doc_id", F.explode(F.transform("hits", verified)).alias("v")).select("doc_id", "v.*")
    runs = runs.where(F.col("run.score") >= F.least(F.lit(float(LEAST)), F.col("item_words") * SHARE))
    place = F.struct(F.col("run.score"), F.col("run.matched"), (-F.col("shift")).alias("back"), (F.col("run.item_end") - F.col("run.item_start")).alias("width"), F.col("run.item_start"))
    apart = F.when(F.col("item_id").isNull(), F.col("key"))  # items without an id are told apart by their words
    best = runs.groupBy("doc_id", "item_id", "copies", "item_words", apart.alias("apart")).agg(F.max(place).alias("b"))
    begin = F.col("b.item_start") - F.col("b.back")
    return best.select("doc_id", "item_id", "copies", "item_words", F.col("b.score").alias("score"), F.col("b.matched").alias("matched"), F.col("b.item_start").alias("item_start"), (F.col("b.item_start") + F.col("b.width")).alias("item_end"), begin.alias("doc_start"), (begin + F.col("b.width")).alias("doc_end"))


RESULT = "doc_id long, item_id long, copies long, item_words int, score int, matched int, item_start int, item_end int, doc_start int, doc_end int"


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of documents with benchmark items."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
