"""Progressive sessions: documents that arrive in chunks, in any order.

State holds which chunks have come and a revision, never the document; the
result of a chunk carries absolute places, so that no order of arrival changes
the final rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiflow.operators.intervals import located
from lexiflow.operators.text import tokens
from lexiflow.sources.tables import lines


def chunks(docs: DataFrame, lines_each: int) -> DataFrame:
    """(doc_id, chunk, start, text): runs of lines, which tile the document."""
    rows = lines(docs).withColumn("chunk", F.floor((F.col("line_no") - 1) / lines_each))
    parts = rows.groupBy("doc_id", "chunk").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return parts.select("doc_id", "chunk", "start", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def analysed(parts: DataFrame) -> DataFrame:
    """(doc_id, chunk, start, end, w): the tokens of chunks at their places in the document."""
    key = F.struct("doc_id", "chunk", F.col("start").alias("base"))
    found = tokens(parts.select(key.alias("doc_id"), "text"))
    return found.select("doc_id.doc_id", "doc_id.chunk", (F.col("start") + F.col("doc_id.base")).alias("start"), (F.col("end") + F.col("doc_id.base")).alias("end"), "w")


def progressive(parts: DataFrame, batches: int) -> DataFrame:
    """The analysis of all chunks, taken in ``batches`` rounds whose order has nothing to do with their places."""
    out = None
    for k in range(batches):
        own = analysed(parts.where(F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(batches)) == k))
        out = own if out is None else out.unionByName(own)
    return out


def stream(parts: DataFrame, sink: str, checkpoint: str):
    """A streaming query over chunks (a streaming DataFrame): each micro-batch is written under its number, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        analysed(batch.dropDuplicates(["doc_id", "chunk"])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return parts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage(parts: DataFrame, done: DataFrame) -> DataFrame:
    """(doc_id, n, arrived, complete) of the chunks that have been analysed."""
    seen = done.select("doc_id", "chunk").distinct().withColumn("seen", F.lit(1))
    rows = parts.join(seen, ["doc_id", "chunk"], "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("seen").alias("arrived"), F.every(F.col("seen").isNotNull()).alias("complete"))


#: Stages of the analysis and what each one needs, in order; a user's profile changes what is shown, not what is found.
STAGES = {"text": (), "tokens": ("text",), "units": ("tokens",), "phrases": ("units",), "grammar": ("phrases",), "expressions": ("phrases",), "profile": ("phrases",)}


def batches(parts: DataFrame, target: int, done: Column | None = None) -> DataFrame:
    """(doc_id, chunk, batch): runs of neighbouring chunks that aren't ``done``, closed as soon as they have ``target`` characters.

    Of each document only the lengths of its chunks are gathered, and folded in order.
    """
    done = F.lit(False) if done is None else F.coalesce(done, F.lit(False))
    rows = parts.select("doc_id", "chunk", F.length("text").cast("long").alias("n"), done.alias("done"))
    sizes = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "done"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<chunk:bigint,batch:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        total = s["total"] + x["n"]
        full = total >= target
        put = F.concat(s["out"], F.array(F.struct(x["chunk"].cast("long").alias("chunk"), s["batch"].alias("batch"))))
        # a chunk that is done closes what was open before it
        after = F.struct(F.when(x["done"], s["batch"] + (s["total"] > 0).cast("long")).otherwise(s["batch"] + full.cast("long")).alias("batch"), F.when(x["done"] | full, 0).otherwise(total).cast("long").alias("total"), F.when(x["done"], s["out"]).otherwise(put).alias("out"))
        return after

    return sizes.select("doc_id", F.explode(F.aggregate("c", start, step, lambda s: s["out"])).alias("o")).select("doc_id", "o.chunk", "o.batch")


def batch_at(parts: DataFrame, at: DataFrame, target: int) -> DataFrame:
    """(doc_id, chunk): for each (doc_id, at) the chunk that holds that place and those after it until ``target`` characters are there."""
    rows = parts.join(at, "doc_id").where(F.col("start") + F.length("text") >= F.col("at"))
    w = W.partitionBy("doc_id", "at").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    return rows.where(F.col("before") < target).select("doc_id", "at", "chunk")


def accepted(mutations: DataFrame) -> DataFrame:
    """(session, number, base, accepted, revision): in order, a mutation counts only if its base is the session's revision, which it then raises."""
    rows = mutations.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("number", "base"))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("revision"), F.array().cast("array<struct<number:bigint,base:bigint,accepted:boolean,revision:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = F.coalesce(x["base"] == s["revision"], F.lit(False))
        now = s["revision"] + fits.cast("long")
        return F.struct(now.alias("revision"), F.concat(s["out"], F.array(F.struct(x["number"].cast("long").alias("number"), x["base"].cast("long").alias("base"), fits.alias("accepted"), now.alias("revision")))).alias("out"))

    return rows.select("session", F.explode(F.aggregate("m", start, step, lambda s: s["out"])).alias("o")).select("session", "o.*")


def patch(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, op, fields): what to insert, update and remove to get from one table to the other."""
    a, b = (df.select(*key, F.struct(*fields).alias(n)) for df, n in ((before, "a"), (after, "b")))
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "remove").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    rows = a.join(b, key, "full_outer").withColumn("op", op).where("op is not null")
    return rows.select(*key, "op", *[F.col(f"b.{f}").alias(f) for f in fields])


def patch_kinds(changes: DataFrame, document: str) -> DataFrame:
    """(document, kind, n): ``token_update`` where rows only change in place, else ``range_replace``; ``full_replace`` where everything is new."""
    n = lambda op: F.count_if(F.col("op") == op)
    rows = changes.groupBy(document).agg(n("insert").alias("i"), n("update").alias("u"), n("remove").alias("r"), F.count("*").alias("n"))
    kind = F.when((F.col("i") + F.col("r")) == 0, "token_update").when((F.col("u") == 0) & (F.col("r") == 0), "full_replace").otherwise("range_replace")
    return rows.select(document, kind.alias("kind"), "n")


def patched(before: DataFrame, changes: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``before`` after its patch: removed rows go, others take the patch's fields where it has them."""
    c = changes.select(*key, F.col("op"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = before.select(*key, *fields, F.lit(True).alias("_old")).join(c, key, "full_outer").where("op is null or op <> 'remove'")
    return rows.select(*key, *[F.when(F.col("op").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def restored(cached: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, chunk, start, end, w): cached tokens (doc_id, start, end, w), at their places within the chunks that are asked for; tokens of other chunks are left out."""
    points = cached.select("doc_id", F.col("start").alias("at"), "end", "w")
    own = parts.select("doc_id", "start", F.struct("chunk", F.col("start").alias("base"), (F.col("start") + F.length("text")).alias("stop")).alias("c"))
    rows = located(points, own, ["doc_id"], "c").where(F.col("at") < F.col("c.stop"))
    return rows.select("doc_id", "c.chunk", (F.col("at") - F.col("c.base")).alias("start"), (F.col("end") - F.col("c.base")).alias("end"), "w")


def recorded_once(cover: DataFrame, tokens_: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exposures (w, n) of the documents that are complete and not yet flagged, and the flags after that: a replay adds nothing."""
    ready = cover.where("complete").select("doc_id").join(flags.select("doc_id"), "doc_id", "left_anti")
    counts = tokens_.join(ready, "doc_id", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    return counts, flags.select("doc_id").unionByName(ready)


def invalidated(touched: DataFrame) -> DataFrame:
    """(session, stage) of all stages that must run again where (session, stage) were touched: the stage itself and what needs it, directly or not."""
    spark = touched.sparkSession
    needs = {s: {s} for s in STAGES}
    for s, parents in STAGES.items():
        for p in parents:
            needs[s] |= needs[p]
    pairs = spark.createDataFrame([(p, s) for s, ps in needs.items() for p in sorted(ps)], "stage string, again string")
    return touched.select("session", "stage").distinct().join(F.broadcast(pairs), "stage").select("session", F.col("again").alias("stage")).distinct()


def progress(arrivals: DataFrame) -> DataFrame:
    """(session, number, percent): what has arrived, in order; it never falls, whatever is reported again."""
    w = W.partitionBy("session").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    return arrivals.withColumn("percent", F.max(F.round(100 * F.col("done") / F.col("total"), 2)).over(w)).select("session", "number", "percent")


def run_group(spark: SparkSession, name: str) -> None:
    """Name the jobs that this thread starts from now on, so that ``cancel`` can end them."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)
