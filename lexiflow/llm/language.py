"""Language identification by nearest centroid.

A whole text becomes a vector of hashed character n-grams (1 to 3 characters
of the lower-case text, everything but letters counting as one space),
weighted by TF-IDF and scaled to length 1. Every language has several
centroids, found by spherical k-means over a bounded sample of its labelled
texts (``PER_LANGUAGE``, chosen by hash); document frequencies come from all
labelled texts. The language of the centroid with the largest cosine is
predicted; ``accepted`` is false for texts that lie farther from it than nearly
all of the centroid's own sample texts do (distance-based rejection).

Null texts and texts without a letter are ``und`` with score 0. With nothing to
learn from every text is ``und``. Equal cosines go to the first language in the
order of names. Repeated rows and null ids are judged like others; extra
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import held_out, outside, table

WIDTH = 1 << 13
#: Fit parameters: sample texts and centroids of each language; share of a centroid's sample that is accepted, and slack.
PER_LANGUAGE, CENTROIDS, ACCEPTED, SLACK = 400, 3, 0.995, 0.05
UNKNOWN = "und"


def letters() -> np.ndarray:
    """For each code point of the basic plane, itself if it's a letter, else a space; other planes are handled in ngrams."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def ngrams(text: str | None, letter: np.ndarray) -> np.ndarray | None:
    """Counts of the hashed n-grams; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = codes < 0x10000
    if low.all():
        codes = letter[codes]
    else:
        codes = np.array([c if chr(c).isalpha() else 32 for c in codes.tolist()], np.uint32)
    space = codes == 32
    if space.all():
        return None
    codes = codes[~(space & np.r_[False, space[:-1]])]
    c = np.r_[np.uint32(32), codes, np.uint32(32)].astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint64(0x9E3779B1) + c[2:]
    h = np.concatenate([c + np.uint64(1 << 40), two + np.uint64(1 << 52), three]) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=WIDTH)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray  # WIDTH x number of centroids
    reach: np.ndarray  # largest accepted distance
    idf: np.ndarray

    def judge(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, False
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]) * self.idf[at]
        cosines = v @ self.vectors[at] / max(float(np.sqrt(v @ v)), 1e-12)
        k = int(cosines.argmax())
        return self.languages[k], float(np.clip(cosines[k], 0, 1)), bool(1 - cosines[k] <= self.reach[k])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the texts each n-gram occurs, and last, how many texts there are."""
    letter = letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(WIDTH + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                counts = ngrams(t.as_py(), letter)
                if counts is not None:
                    found[:-1] += counts > 0
                    found[-1] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["f", "n"])

    rows = texts.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # WIDTH rows at most
    out = np.zeros(WIDTH + 1, np.int64)
    for f, n in rows:
        out[f] = n
    return out


def sampled_vectors(texts: DataFrame) -> dict[str, list[tuple[int, np.ndarray, np.ndarray]]]:
    """lang -> (hash, n-grams, counts) of at most about PER_LANGUAGE texts, in the order of the hash."""
    letter = letters()
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"))
    steps = 1 << 30
    rate = F.least(F.lit(1.0), PER_LANGUAGE / F.col("n")) * steps
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = texts.join(F.broadcast(counts.select("lang", rate.alias("rate"))), "lang").where(F.pmod("h", F.lit(steps)) < F.col("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, h, c) for lang, h, t in zip(*(x.to_pylist() for x in b.columns)) if (c := ngrams(t, letter)) is not None]
            at = [np.flatnonzero(c) for _, _, c in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([x[2][a].astype("<u4").tobytes() for x, a in zip(found, at)], pa.binary())], ["lang", "h", "at", "n"])

    out: dict[str, dict[int, tuple[int, np.ndarray, np.ndarray]]] = {}
    for lang, h, at, n in chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, at binary, n binary").toLocalIterator():
        out.setdefault(lang, {})[h] = (h, np.frombuffer(bytes(at), "<u2").astype(np.int64), np.frombuffer(bytes(n), "<u4"))  # repeated rows once
    return {lang: [rows[h] for h in sorted(rows)] for lang, rows in sorted(out.items())}


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and, of each row, which one it's in. Starts from the first row, then the farthest ones."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.max(x @ np.stack(centres).T, axis=1).argmin())])
    c = np.stack(centres)
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Centroids:
    """Centroids from the rows with a language for which ``learn`` holds."""
    texts = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    frequencies = document_frequencies(texts)
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    languages, vectors, reach = [], [], []
    for name, rows in sampled_vectors(texts).items():
        x = np.zeros((len(rows), WIDTH), np.float32)
        for k, (_, at, n) in enumerate(rows):
            x[k, at] = np.log1p(n) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c, own = clusters(x, CENTROIDS)
        for j in range(len(c)):
            distances = 1 - x[own == j] @ c[j]
            languages.append(name)
            vectors.append(c[j])
            reach.append(float(np.quantile(distances, ACCEPTED)) + SLACK if len(distances) else 0.0)
    return Centroids(languages, np.stack(vectors, 1) if vectors else np.zeros((WIDTH, 0), np.float32), np.array(reach), idf)


def predict(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted for each whole text; columns of those names are replaced."""
    letter = letters()

    @F.arrow_udf("struct<lang_pred: string, score: double, accepted: boolean>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            found = [model.judge(ngrams(t.as_py(), letter)) for t in b]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang_pred", "score", "accepted"])

    new = ["lang_pred", "score", "accepted"]
    rest = [c for c in docs.columns if c.lower() not in new]
    name = outside(docs, "_judged")
    out = docs.select(*rest, judged.asNondeterministic()(F.col(text).cast("string")).alias(name))
    return out.select(*rest, *[F.col(f"{name}.{c}").alias(c) for c in new])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out("doc_id", 4, 2) & F.col("doc_id").isNotNull())
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")
