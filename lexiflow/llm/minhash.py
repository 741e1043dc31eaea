"""Near-duplicate classes by one-permutation hashing.

1. Every distinct word sequence gets one sketch: its shingles are hashed once,
   the hashes fall into ``BANDS * ROWS`` bins, each bin keeps its least hash,
   and an empty bin copies the bin that its own sequence of random bins meets
   first (optimal densification), so that the copies are spread evenly.
2. Bands of ``ROWS`` bins are buckets. A bucket links its members only to one
   centre, the member with the smallest share of shingles that no other text
   has (a star), so a bucket of m members gives m - 1 candidates. Where buckets
   hold several classes after that, their members are compared with those of
   the other classes, block by block, unless they have so many shingles for
   themselves alone that they can't be similar to anything. No bucket is
   capped.
3. Candidates are confirmed on their full shingle sets, and the classes are
   the connected components of the confirmed links, found by min-label
   hooking with pointer jumping, all in DataFrames.

A pair with similarity 0.8 shares no bucket with a chance of under 4e-6.
Copies of one word sequence are one node of this graph.

Null and empty texts, and those without words, have an empty set and are
linked with nothing. A null id can't name a class: such rows get a null
component, are kept, and link nothing. Rows that repeat an id are judged by
their own texts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import checkpointed, released, table

BANDS, ROWS = 32, 5
#: Keys (16 bytes each) that are broadcast at most.
KEYS = 2_000_000
#: Rows of one key beyond which a join deals them over SALT parts.
HOT, SALT = 500, 32
#: Texts that a task compares with as many others at a time.
BLOCK = 128
#: Word hashes that a task remembers at most, and rows that are Python objects at a time.
REMEMBERED, SLICE = 200_000, 500
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


class Shingler:
    """Words, shingle sets and sketches of whole texts."""

    def __init__(self, words: int, bands: int = BANDS, rows: int = ROWS):
        self.n, self.bands, self.rows = words, bands, rows
        self.hashes = WordHashes()
        bins = bands * rows
        salt = np.arange(1, bins + 1, dtype=np.uint64) << np.uint64(32)
        with np.errstate(over="ignore"):
            # row t: where each empty bin looks in its t-th attempt
            self.tries = np.stack([(mixed(salt + np.uint64(t)) % np.uint64(bins)).astype(np.int64) for t in range(4 * bins)])
            self.odd = mixed(np.arange(1, words + 2, dtype=np.uint64)) | np.uint64(1)
            self.row_salt = mixed(np.arange(1, rows + 1, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)

    def words(self, text: str | None) -> np.ndarray:
        """Hashes of the words; A-Z count as lower case, white space is \\x20 and \\x09-\\x0D, as for bytes.split."""
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))

    def set_of(self, words: np.ndarray) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        if not len(words):
            return words
        with np.errstate(over="ignore"):
            n = min(self.n, len(words))
            h = np.full(len(words) - n + 1, n, np.uint64)
            for k in range(n):
                h = mixed(h * self.odd[k] + words[k : len(words) - n + 1 + k])
        return np.unique(h)

    def digest(self, words: np.ndarray) -> bytes:
        return xxhash.xxh3_128_digest(words.tobytes())

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each band."""
        bins = self.bands * self.rows
        with np.errstate(over="ignore"):
            h = mixed(shingles + np.uint64(0x5851F42D4C957F2D))
            where = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(h)[::-1]
            least = np.full(bins, EMPTY)
            least[where[order]] = h[order]  # the last that is written is the least
            empty = np.flatnonzero(least == EMPTY)
            source = least.copy()
            for t in range(len(self.tries)):
                if not len(empty):
                    break
                found = source[self.tries[t][empty]]
                least[empty] = found
                empty = empty[found == EMPTY]
            least[empty] = h.min()
            bands = (least.reshape(self.bands, self.rows) * self.row_salt).sum(1, dtype=np.uint64)
            return mixed(bands + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, so that few texts and sets are Python objects at a time."""
    for b in batches:
        for k in range(0, max(1, len(b)), SLICE):
            yield b.slice(k, SLICE)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest, keys): digest names the word sequence; it is null, and keys empty, for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for b in sliced(batches):
            n, digests, keys, offsets = [], [], [], [0]
            for t in b.column(1).to_pylist():
                w = s.words(t)
                shingles = s.set_of(w)
                n.append(len(shingles))
                digests.append(s.digest(w) if len(w) else None)
                if len(w):
                    keys.append(s.keys(shingles))
                offsets.append(offsets[-1] + s.bands * bool(len(w)))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "n_shingles", "digest", "keys"])
        s = w = shingles = n = digests = keys = flat = None
        released()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for b in sliced(batches):
            found = [s.words(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s.digest(w) for w in found], pa.binary()), pa.array([s.set_of(w).tobytes() for w in found], pa.binary())], ["digest", "shingles"])
        s = found = None
        released()

    return texts.select("text").mapInArrow(run, "digest binary, shingles binary")


@F.arrow_udf(T.BooleanType())
def similar(a: pa.Array, b: pa.Array, percent: pa.Array) -> pa.Array:
    """100 * intersection >= percent * union of two sorted sets."""
    out = []
    for k in range(len(a)):
        x, y, p = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64), percent[k].as_py()
        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
        out.append(both > 0 and 100 * both >= p * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def among(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; up to ``KEYS`` keys are broadcast, more are shuffled."""
    keys = checkpointed(keys.distinct())
    return df.join(F.broadcast(keys) if keys.count() <= KEYS else keys, on, "left_semi")


def solitary(sets: DataFrame) -> DataFrame:
    """(h, own): how many shingles each text, named by the hash of its digest, has for itself alone among ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                h = b.column(0).slice(k, 256).to_numpy()
                shingles = [np.frombuffer(x, np.int64) for x in b.column(1).slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, [len(x) for x in shingles])), pa.array(np.concatenate(shingles))], ["h", "shingle"])
        released()

    rows = sets.select(F.xxhash64("digest").alias("h"), "shingles").mapInArrow(run, "h long, shingle long")
    return rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n = 1").groupBy("h").agg(F.count("*").alias("own"))


def compared(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between texts of different classes, of (top, it, label, asks): all that ask against all with the same ``top``.

    Texts are dealt into blocks of about BLOCK, and each task compares one
    block of askers with one of the others through an index of the askers'
    shingles. Pairs aren't rows at any time, and of the links of a text with
    one class only the first is given out.
    """

    def compare(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("side").to_pylist(), bool)
        nodes, labels = group.column("node").to_numpy(), group.column("label").to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in found])
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if len(x) and len(y):
            values, owner = np.concatenate([found[k] for k in x]), np.repeat(np.arange(len(x)), sizes[x])
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            for k in y:
                low, high = np.searchsorted(values, found[k], "left"), np.searchsorted(values, found[k], "right")
                n = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(x))
                for j in np.flatnonzero((100 * both >= percent * (sizes[x] + sizes[k] - both)) & (labels[x] != labels[k])):
                    out.setdefault((int(nodes[x[j]]), int(labels[k])), (int(nodes[x[j]]), int(nodes[k])))
        return pa.table({"a": pa.array([a for a, _ in out.values()], pa.int64()), "b": pa.array([b for _, b in out.values()], pa.int64())})

    named = checkpointed(named)
    shingles = among(sets, named.select(F.col("it.digest").alias("digest")), "digest")
    counts = named.groupBy("top").agg(F.sum(F.col("asks").cast("long")).alias("asking"), F.count("*").alias("all")).where("asking > 0")
    counts = counts.select("top", F.ceil(F.col("asking") / BLOCK).alias("m"), F.ceil(F.col("all") / BLOCK).alias("n"))
    rows = named.select("top", F.col("it.digest").alias("digest"), F.col("it.node").alias("node"), "label", "asks").join(counts, "top").join(shingles, "digest")
    h = F.xxhash64("digest", F.lit(11))
    both = [("asks", True, F.pmod(h, F.col("m")), F.col("n")), ("true", False, F.pmod(h, F.col("n")), F.col("m"))]
    dealt = [rows.where(which).select("top", F.lit(side).alias("side"), "node", "label", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("other")) for which, side, own, times in both]
    askers, others = dealt[0].withColumnsRenamed({"own": "i", "other": "j"}), dealt[1].withColumnsRenamed({"own": "j", "other": "i"})
    return askers.unionByName(others).groupBy("top", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def spread(rows: DataFrame, key: str, unique: DataFrame) -> DataFrame:
    """``rows`` joined with ``unique``, which has one row for each key; rows of a key that more than HOT rows have are dealt over SALT parts.

    There's at most one hot key for HOT rows, and their list is broadcast only
    up to KEYS.
    """
    hot = checkpointed(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(key, F.lit(True).alias("hot")))
    known = hot.count()
    if not known:
        return rows.join(unique, key)
    small = F.broadcast(hot) if known <= KEYS else hot
    left = rows.join(small, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALT))).otherwise(0).cast("int")).drop("hot")
    right = unique.join(small, key, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return left.join(right, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of (a, b), named by their smallest node.

    Each round hooks every node to the least label of its neighbours and then
    jumps to that label's own label. Rounds end when no label falls; their
    number is about the logarithm of the longest path. Rows with one key are
    summed before they are shuffled, and joined in parts where they are many.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = spread(both, "b", labels.withColumnRenamed("node", "b")).groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        # also tell the old label's node, so that whole trees move
        told = hooked.groupBy(F.col("was").alias("node")).agg(F.min("label").alias("t"))
        mine = checkpointed(hooked.join(told, "node", "left").select("node", "was", F.least("label", F.coalesce("t", "label")).alias("label")))
        up = mine.select(F.col("node").alias("label"), F.col("label").alias("top"))  # a label is always a node
        after = checkpointed(spread(mine, "label", up).select("node", "was", F.least("label", "top").alias("label")))
        if not after.where("label < was").head(1):
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Links have 100 * intersection >= percent * union of the sets of ``words``-word shingles.
    """
    rows = checkpointed(sketches(docs, words, id_col, text_col))
    # one node for each distinct word sequence: its smallest id
    known = rows.where("digest is not null and doc_id is not null")
    nodes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
    buckets = nodes.select(F.struct("digest", "node", "size").alias("it"), F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = checkpointed(buckets.join(shared.select("key"), "key"))

    # the sets of the texts that share a bucket with another one
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    sets = shingle_sets(among(texts, members.select(F.col("it.node").alias("node")), "node"), words)
    if known.groupBy("doc_id").count().where("count > 1").head(1):  # else each text comes once
        sets = sets.dropDuplicates(["digest"])
    sets = checkpointed(sets)
    members = members.withColumn("h", F.xxhash64("it.digest")).join(solitary(sets), "h", "left")
    members = checkpointed(members.select("key", "it", (F.col("it.size") - F.coalesce("own", F.lit(0))).alias("open")))

    # stars around the member that shares most of its shingles: it's nearest to the middle of its group
    lonely = F.struct((1 - F.col("open") / F.col("it.size")).alias("lonely"), "it")
    centres = members.groupBy("key").agg(F.min(lonely).alias("c"))
    star = members.join(centres, "key").where("it.digest <> c.it.digest").select(F.col("it").alias("x"), F.col("c.it").alias("y"))
    fits = (F.col("x.size") * 100 >= F.col("y.size") * percent) & (F.col("y.size") * 100 >= F.col("x.size") * percent)
    pairs = star.where(fits).select(F.col("x.digest").alias("dx"), F.col("x.node").alias("a"), F.col("y.digest").alias("dy"), F.col("y.node").alias("b")).distinct()
    x, y = (sets.select(F.col("digest").alias(d), F.col("shingles").alias(s)) for d, s in (("dx", "sx"), ("dy", "sy")))
    links = checkpointed(pairs.join(x, "dx").join(y, "dy").where(similar("sx", "sy", F.lit(percent))).select("a", "b"))
    labels = components(links)

    # in buckets that still hold several classes, each member against the other classes, in blocks; members of the largest class ask nobody
    named = members.withColumn("node", F.col("it.node")).join(labels, "node", "left").select("key", "it", "open", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes"))
    left = named.join(counts.where("classes > 1"), "key").where(F.col("open") * 100 >= F.col("it.size") * percent)  # others have too much for themselves alone
    left = left.groupBy(F.col("top.label").alias("top"), "it", "label").agg((~F.every(F.col("label") == F.col("top.label"))).alias("asks"))
    more = checkpointed(compared(left, sets, percent))
    if more.head(1):
        labels = components(links.unionByName(more))

    named = known.groupBy("digest").agg(F.min("doc_id").alias("node")).join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    found = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates, by 4-word shingles and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
