"""Chroma audio fingerprints.

PCM is cut into overlapping frames whose spectrum is folded into 12 pitch
classes. Over the image of frames and classes, rectangle filters are read from
an integral image; each gives two bits, 16 of them make one packed 32-bit
integer for each frame. Recordings are aligned by the histogram of offsets at
which their integers agree in three of four bytes; of the offsets with
``VOTES`` such hits and an overlap of ``OVERLAP`` frames (or of all frames of
the shorter one) that with the least share of wrong bits decides, and aligns
them if that share is at most ``ERRORS``. Bits that are wrong independently,
at that rate, leave a recording of 75 frames its votes with a chance over 0.9
(see the tests); noise, whose wrong bits come together, leaves more.

``search`` compares a stated query set with all recordings. Queries are taken
in blocks of at most ``FRAMES`` integers (and one recording), which bounds what
the driver and a task hold for any number of queries; nothing is joined, so
common integers make no bucket.

``links`` gives the same pairs, but compares each fingerprint only once: rows
with identical fingerprints are one class, and pairs of classes stand for the
pairs of their members.

Null, empty and too short audio has no fingerprint and matches nothing; long
recordings are read whole. Repeated rows are reported as often as they occur;
null ids can't be reported and are left out. Vectors with null or infinite
components, or none, give no audio. Of equally good offsets the smallest
counts. Extra columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, table

CLASSES = 12
#: Seconds of a frame and between frames; range of frequencies that count; frames under a filter.
FRAME, HOP, LOW, HIGH, SPAN = 0.256, 0.064, 100.0, 900.0, 16
#: Hits at one offset, frames of overlap, and the share of wrong bits, that make a match.
VOTES, OVERLAP, ERRORS = 2, 16, 0.15
#: Integers of queries that are compared at a time; recordings that a task compares at a time.
FRAMES, TOGETHER = 2_000_000, 64
#: What remains of an integer when one of its bytes is left out.
PARTS = tuple(0xFFFFFFFF ^ (0xFF << 8 * k) for k in range(4))


def samples(data: bytes | None, rate: int) -> tuple[np.ndarray, int]:
    """Mono samples and their rate, from a 16-bit WAV file or raw 16-bit PCM of the given rate."""
    if data and data[:4] == b"RIFF":
        try:
            with wave.open(io.BytesIO(data)) as f:
                if f.getsampwidth() != 2:
                    return np.zeros(0), rate
                x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(float)
                return x[: len(x) // f.getnchannels() * f.getnchannels()].reshape(-1, f.getnchannels()).mean(1), f.getframerate()
        except (wave.Error, EOFError):
            return np.zeros(0), rate
    data = data or b""
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(float), rate


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12: each frame's share of energy in each pitch class."""
    size, hop = int(FRAME * rate), max(1, int(HOP * rate))
    if len(x) < size or size < 8:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    frequencies = np.fft.rfftfreq(size, 1 / rate)
    used = np.flatnonzero((frequencies >= LOW) & (frequencies <= HIGH))
    fold = np.zeros((len(used), CLASSES))
    fold[np.arange(len(used)), np.round(12 * np.log2(frequencies[used] / 440)).astype(int) % CLASSES] = 1
    out = []
    for k in range(0, len(frames), 512):  # long recordings need no more memory than short ones
        power = np.abs(np.fft.rfft(frames[k : k + 512] * np.hanning(size), axis=1)[:, used]) ** 2
        energy = power @ fold
        out.append(energy / np.maximum(energy.sum(1, keepdims=True), 1e-9))
    return np.concatenate(out)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of 16 filters, spread by rule over kinds, places and sizes."""
    return [(k % 4, k * 5 % 9, 3 + k % 2, 4 * (1 + k % 4)) for k in range(16)]


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each frame that has a whole window after it."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # lower against upper classes
            a, b = area(y, y + h // 2, 0, w), area(y + h // 2, y + h, 0, w)
        elif kind == 1:  # earlier against later frames
            a, b = area(y, y + h, 0, w // 2), area(y, y + h, w // 2, w)
        elif kind == 2:  # a checkerboard
            a = area(y, y + h // 2, 0, w // 2) + area(y + h // 2, y + h, w // 2, w)
            b = area(y, y + h // 2, w // 2, w) + area(y + h // 2, y + h, 0, w // 2)
        else:  # the classes against the window's mean
            a, b = area(y, y + h, 0, w), area(0, CLASSES, 0, w) * h / CLASSES
        level = np.digitize(np.log((a + 0.01) / (b + 0.01)), (-0.4, 0.0, 0.4))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbours differ in one bit
    return out


def fingerprints(recordings: DataFrame, audio: str | Column, rate: int, id_col: str, out: str = "fingerprint") -> DataFrame:
    """(id, fingerprint): an integer array for each row."""

    @F.arrow_udf("array<int>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [fingerprint(chroma(*samples(x.as_py(), rate))).view(np.int32) for x in b]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))

    audio = F.col(audio) if isinstance(audio, str) else audio
    return recordings.select(F.col(id_col).cast("long").alias(id_col), made(audio).alias(out))


class Index:
    """Places of a query block's integers, sorted by each of their parts."""

    def __init__(self, queries: list[tuple[int | str, bytes]]):
        self.ids = [q for q, _ in queries]
        self.prints = [np.frombuffer(f, np.uint32) for _, f in queries]
        owner = np.repeat(np.arange(len(queries)), [len(p) for p in self.prints])
        place = np.concatenate([np.arange(len(p)) for p in self.prints]) if queries else np.zeros(0, int)
        values = np.concatenate(self.prints) if queries else np.zeros(0, np.uint32)
        self.parts = []
        for mask in PARTS:
            order = np.argsort(values & np.uint32(mask), kind="stable")
            self.parts.append((np.uint32(mask), (values & np.uint32(mask))[order], owner[order], place[order]))

    def matches(self, given: list[np.ndarray]) -> list[list[tuple[int | str, int, int, float]]]:
        """For each recording (query, offset, votes, share of wrong bits) of the queries that align with it; the offset is where the query's first frame lies in it."""
        given = [f.view(np.uint32) for f in given]
        out: list[list[tuple[int | str, int, int, float]]] = [[] for _ in given]
        frames = np.concatenate(given) if given else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(given)), [len(f) for f in given])
        place = np.concatenate([np.arange(len(f)) for f in given]) if given else np.zeros(0, int)
        keys = []
        for mask, values, whose, where in self.parts:
            own = frames & mask
            low = np.searchsorted(values, own, "left")
            n = np.searchsorted(values, own, "right") - low
            hit = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
            mine = np.repeat(np.arange(len(frames)), n)
            keys.append((owner[mine] << 57) | (whose[hit].astype(np.int64) << 29) | (place[mine] - where[hit] + (1 << 28)))
        found, votes = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, int), np.zeros(0, int))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for key, n in zip(found[votes >= VOTES].tolist(), votes[votes >= VOTES].tolist()):
            k, q, s = key >> 57, key >> 29 & (1 << 28) - 1, (key & (1 << 29) - 1) - (1 << 28)
            a, f = self.prints[q], given[k]
            begin, end = max(0, -s), min(len(a), len(f) - s)
            if end - begin < min(OVERLAP, len(a), len(f)):
                continue
            wrong = int(np.bitwise_count(a[begin:end] ^ f[begin + s : end + s]).sum()) / (32 * (end - begin))
            if wrong <= ERRORS and (wrong, s) < best.get((k, q), (2.0, 0, 0))[:2]:
                best[k, q] = (wrong, s, n)
        for (k, q), (wrong, s, n) in sorted(best.items()):
            out[k].append((self.ids[q], s, n, wrong))
        return out


PAIRS = "query_id long, id long, offset int, votes int, bit_error double"
CLASS_PAIRS = "query_class string, class_id string, offset int, votes int, bit_error double"


def aligned(recordings: DataFrame, queries: DataFrame, id_col: str, schema: str) -> DataFrame:
    """(query, recording, offset, votes, bit_error), as ``schema`` names them, of all that align; reads (id, fingerprint) of both."""
    rows = recordings.where(F.col(id_col).isNotNull()).select(id_col, "fingerprint")
    queries = queries.where(F.col(id_col).isNotNull() & (F.size("fingerprint") > 0))
    total = queries.agg(F.sum(F.size("fingerprint").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // FRAMES))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    out = []
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(blocks)) == k)
        block = sorted({(r[0], np.array(r[1], np.int32).tobytes()) for r in part.select(id_col, "fingerprint").toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = Index(block)
            for b in batches:
                for at in range(0, len(b), TOGETHER):
                    ids, prints = (c.to_pylist() for c in b.slice(at, TOGETHER).columns)
                    found = [(m[0], i, *m[1:]) for i, ms in zip(ids, index.matches([np.array(f or [], np.int32) for f in prints])) for m in ms]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], kinds[kind]) for j, (_, kind) in enumerate(fields)], [n for n, _ in fields])

        found = rows.mapInArrow(run, schema)
        out.append(checkpointed(found) if blocks > 1 else found)  # so that the driver holds one block at a time
        del block
    return reduce(DataFrame.unionByName, out)


def search(recordings: DataFrame, queries: DataFrame, id_col: str) -> DataFrame:
    """(query_id, id, offset, votes, bit_error) of all pairs of a query and a recording that align, both (id, fingerprint)."""
    return aligned(recordings, queries, id_col, PAIRS).withColumnRenamed("id", id_col)


def links(recordings: DataFrame, queries: DataFrame, id_col: str) -> DataFrame:
    """(class_id, id, is_query, query_class, offset, votes, bit_error): rows of two kinds that together hold all pairs of ``search``.

    A row with an id says to which class of identical fingerprints a recording
    (or, with ``is_query``, a query) belongs; each has one. A row with a
    ``query_class`` says that the queries of that class align with the
    recordings of ``class_id``: each query of the one with each recording of
    the other.
    """
    # the fingerprint's digest names a class: no join is needed, and rows that repeat an id keep apart
    name = F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ",").cast("binary"), 256)
    sides = [df.where(F.col(id_col).isNotNull()).select(id_col, "fingerprint", F.lit(asks).alias("is_query"), name.alias("class_id")) for df, asks in ((recordings, False), (queries, True))]
    classes = [checkpointed(df.groupBy("class_id").agg(F.first("fingerprint").alias("fingerprint"))) for df in sides]
    pairs = aligned(*classes, "class_id", CLASS_PAIRS)
    return sides[0].unionByName(sides[1]).select("class_id", id_col, "is_query").unionByName(pairs, allowMissingColumns=True)


RATE = 2000


def rendered(vector: str, late: float = 0.0, early: float = 0.0, noise: float = 0.0) -> Column:
    """Arrow UDF column: a tune for a vector, as a WAV file. Each of 24 notes of 0.25 s sounds the 12 pitch classes as loud as some of the vector's components say.

    ``late`` and ``early`` seconds are missing at its start and end; ``noise``
    is added to each sample, drawn from the vector's own digest.
    """

    @F.arrow_udf("binary")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        time = np.arange(RATE // 4) / RATE
        tones = np.sin(2 * np.pi * 220 * 2 ** (np.arange(CLASSES)[:, None] / 12) * time)
        pick = np.arange(24)[:, None] * 7 + np.arange(CLASSES) * 5
        for b in batches:
            out = []
            for v in b.to_pylist():
                if not v or any(x is None or not np.isfinite(x) for x in v):
                    out.append(None)
                    continue
                v = np.array(v, float)
                loud = np.exp(2.5 * v[pick % len(v)] / max(float(v.std()), 1e-9))
                x = ((loud / loud.sum(1, keepdims=True)) @ tones).ravel()
                x = x[int(late * RATE) : len(x) - int(early * RATE)]
                if noise:
                    x = x + noise * np.random.default_rng(xxhash.xxh64_intdigest(v.tobytes())).normal(size=len(x))
                file = io.BytesIO()
                with wave.open(file, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(RATE)
                    f.writeframes(np.clip(x * 16000, -32768, 32767).astype("<i2").tobytes())
                out.append(file.getvalue())
            yield pa.array(out, pa.binary())

    return made(F.col(vector))


#: What a second recording lacks at its start and end (seconds), and the deviation of its noise, where the tune lies between -1 and 1.
LATE, EARLY, NOISE = 0.9, 0.5, 0.2


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tunes of all vectors, and a second recording, cut and noisy, of those whose id is divisible by 20, which is searched among all tunes; all links, between classes of identical fingerprints.

    The tables hold no recordings, so the media column is rendered from the vectors.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    prints = checkpointed(fingerprints(vectors, rendered("embedding"), RATE, "vec_id"))
    asked = vectors.where(F.pmod(F.col("vec_id"), F.lit(20)) == 0)
    queries = checkpointed(fingerprints(asked, rendered("embedding", LATE, EARLY, NOISE), RATE, "vec_id"))
    return links(prints, queries, "vec_id")
