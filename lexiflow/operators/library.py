"""Libraries of books, and orders, pages and budgets of any rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: file endings of images
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "svg")


def book_id(content: Column) -> Column:
    """32 hexadecimal digits of the content's digest."""
    return F.substring(F.sha2(content, 256), 1, 32)


def is_book_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{32}$"), F.lit(False))


def extension(path: Column) -> Column:
    """The path's image ending in lower case; null for other files."""
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found.isin(*IMAGES), found)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, title, total, offset, opened): new books and new titles; a book's length never falls, and its progress stays."""
    a = old.select("book_id", F.struct("title", "total", "offset", "opened").alias("a"))
    b = new.groupBy("book_id").agg(F.max(F.struct("title", "total")).alias("b"))
    rows = a.join(b, "book_id", "full_outer")
    return rows.select("book_id", F.coalesce("b.title", "a.title").alias("title"), F.greatest("a.total", "b.total").alias("total"), F.coalesce("a.offset", F.lit(0).cast("long")).alias("offset"), F.col("a.opened").alias("opened"))


def after_log(books: DataFrame, log: DataFrame) -> DataFrame:
    """``books`` after (book_id, number, op, value): ``progress`` sets the offset, ``reset`` clears it, ``remove`` drops the book; in their order."""
    ops = log.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("number", "op", "value"))).alias("ops"))
    start = F.struct(F.col("offset").alias("offset"), F.lit(False).alias("gone"))

    def step(s: Column, o: Column) -> Column:
        return F.struct(F.when(o["op"] == "progress", o["value"]).when(o["op"] == "reset", F.lit(0).cast("long")).otherwise(s["offset"]).alias("offset"), (s["gone"] | (o["op"] == "remove")).alias("gone"))

    rows = books.join(ops, "book_id", "left").withColumn("s", F.aggregate(F.coalesce("ops", F.array().cast("array<struct<number:bigint,op:string,value:bigint>>")), start, step)).where("not s.gone")
    return rows.withColumn("offset", F.col("s.offset")).drop("ops", "s")


def progress(offset: Column, total: Column) -> Column:
    """The share that has been read; 0 of an empty book."""
    return F.round(F.coalesce(F.try_divide(F.least(offset, total), total), F.lit(0.0)), 4)


def minutes_left(offset: Column, total: Column, per_minute: int) -> Column:
    return F.ceil(F.greatest(total - offset, F.lit(0)) / per_minute).cast("long")


def recent_first(books: DataFrame, keys: list[str]) -> DataFrame:
    """``books`` (opened, created, book_id and more) with ``place`` in each group: the last opened first, those never opened last, then the newest."""
    w = W.partitionBy(*keys).orderBy(F.col("opened").desc_nulls_last(), F.col("created").desc_nulls_last(), "book_id")
    return books.withColumn("place", F.row_number().over(w).cast("long"))


def with_parts(books: DataFrame, tags: DataFrame, chapters: DataFrame) -> DataFrame:
    """``books`` with their ``tags`` in order and their ``chapters`` (book_id, place, title) in theirs; lists are aggregated before they're joined."""
    t = tags.groupBy("book_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    c = chapters.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("chapters"))
    none = F.array().cast("array<string>")
    rows = books.join(t, "book_id", "left").join(c, "book_id", "left")
    return rows.withColumn("tags", F.coalesce("tags", none)).withColumn("chapters", F.coalesce("chapters", none))


def resource_key(path: Column) -> Column:
    """A path in lower case with forward slashes and without leading dots and slashes."""
    return F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"^(\.?/)+", "")


def with_resources(images: DataFrame, resources: DataFrame, path: str) -> DataFrame:
    """``images`` with ``resource``: the id of the resource (path, resource) with the same key, the first by id."""
    own = resources.groupBy(resource_key(F.col("path")).alias("_key")).agg(F.min("resource").alias("resource"))
    return images.withColumn("_key", resource_key(F.col(path))).join(own, "_key", "left").drop("_key")


def paged(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with ``page`` and ``pages`` of their group."""
    w = W.partitionBy(*keys)
    return rows.withColumn("page", F.ceil(F.row_number().over(w.orderBy(*order)) / size).cast("long")).withColumn("pages", F.ceil(F.count("*").over(w) / size).cast("long"))


def newest(rows: DataFrame, keys: list[str], time: str, tie: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The n newest rows of each group, and the others."""
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(time), tie)))
    return ranked.where(F.col("_k") <= n).drop("_k"), ranked.where(F.col("_k") > n).drop("_k")


def without_repeats(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` but for those whose value is that of the row before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def within_budget(rows: DataFrame, keys: list[str], order: str, size: str, each: float, total: float) -> DataFrame:
    """(keys, order, size, taken): in their order, rows of up to ``each`` as long as the sum of what is taken stays within ``total``; what doesn't fit is left out, and smaller ones after it may still fit."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("double").alias("s")))).alias("r"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = F.coalesce((x["s"] >= 0) & (x["s"] <= each) & (a["sum"] + x["s"] <= total), F.lit(False))
        return F.struct((a["sum"] + F.when(fits, x["s"]).otherwise(0.0)).alias("sum"), F.concat(a["out"], F.array(fits)).alias("out"))

    flags = F.aggregate("r", start, step, lambda a: a["out"])
    rows = packed.select(*keys, F.explode(F.arrays_zip("r", flags.alias("taken"))).alias("x"))
    return rows.select(*keys, F.col("x.r.o").alias(order), F.col("x.r.s").alias(size), F.col("x.taken").alias("taken"))


def counters(rows: DataFrame, by: list[str], status: str, rule: str) -> DataFrame:
    """(by, n, accepted, pending, rejected, rules): occurrences, those of each status, and how many different rules they come from."""
    n = lambda s: F.count_if(F.col(status) == s).alias(s)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), n("accepted"), n("pending"), n("rejected"), F.count_distinct(rule).alias("rules"))


def shuffled(rows: DataFrame, keys: list[str], item: str, seed: str) -> DataFrame:
    """``rows`` with ``place``, an order that depends on nothing but the seed and the item."""
    w = W.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(item).cast("string"))), item)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def exported(rows: DataFrame, key: list[str], order: list[str], levels: str, content: list[str]) -> DataFrame:
    """``rows``, the first of each key, with their levels in order, each once, and the digest of their content as ``id``."""
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
    return first.withColumn(levels, F.array_sort(F.array_distinct(levels))).withColumn("id", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in content]), 256))
