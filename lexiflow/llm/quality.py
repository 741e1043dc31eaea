"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (windows of ``PASSAGE`` code points over the
whole text). Each passage is described by shares of character classes and of
their successions, and by how much of it repeats earlier lines and words. A
small encoder, gated attention (tanh and sigmoid gates) and a logistic layer
are trained together from document labels: the attention weights say which
passages speak for the label, and the weighted mean of the encoded passages is
scored.

The network is fitted on at most ``PER_CLASS`` labelled documents of each class
(a bounded sample of labelled rows), of long ones on ``FITTED`` passages spread
over the whole text, both classes having equal weight, and scores every whole
text with all of its passages. Null and empty texts are one empty passage and get
that passage's score. Without labels of both classes every score is 0.5.
Repeated rows and null ids are scored like others; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import held_out, labelled_sample, outside, table

PASSAGE = 400
PER_CLASS = 2000
#: Passages of a labelled document that are fitted at most (of 320 bytes each); all of them are scored.
FITTED = 64
ENCODED, GATES = 24, 12
CLASSES = 12
EXTRA = 5
WIDTH = CLASSES + CLASSES * CLASSES + EXTRA


def classes() -> np.ndarray:
    """The class of each code point of the basic plane: lower, upper and other letters, digits, space, line end, and kinds of punctuation."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        s = chr(c)
        out[c] = 0 if s.islower() else 1 if s.isupper() else 2 if s.isalpha() else 3 if s.isdigit() else 4 if s in " \t" else 5 if s in "\r\n" else 6 if s in ".,;:" else 7 if s in "!?" else 8 if s in "|<>{}[]()/\\" else 9 if s in "'\"-" else 10 if c < 128 else 11
    return out


def passages(text: str | None, table_: np.ndarray) -> np.ndarray:
    """A row of WIDTH features for each passage."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = table_[np.minimum(codes, 0xFFFF)].astype(np.int64)
    n = max(1, -(-len(kind) // PASSAGE))
    where = np.arange(len(kind)) // PASSAGE
    size = np.maximum(np.bincount(where, minlength=n), 1)[:, None]
    single = np.bincount(where * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size
    square = CLASSES * CLASSES
    double = np.bincount(where[1:] * square + kind[:-1] * CLASSES + kind[1:], minlength=n * square).reshape(n, square) / size
    extra = np.zeros((n, EXTRA))
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        if line in seen and line:
            for p in range(at // PASSAGE, (at + len(line) - 1) // PASSAGE + 1):
                extra[p, 0] += (min(at + len(line), (p + 1) * PASSAGE) - max(at, p * PASSAGE)) / PASSAGE
        seen.add(line)
        at += len(line) + 1
    words = text.split()
    if words:
        extra[:, 1] = len(set(words)) / len(words)
        extra[:, 2] = sum(map(len, words)) / len(words) / 10
        extra[:, 3] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    extra[:, 4] = np.log1p(len(text)) / 10
    return np.hstack([single, double, extra]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        firsts = np.cumsum([0, *map(len, bags)])[:-1]
        x = (np.concatenate(bags) - self.mean) / self.scale
        return forward(self.weights, np.clip(x, -8, 8), firsts)["p"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.r_[firsts, len(x)])
    e = np.tanh(x @ w["encode"] + w["encode0"])
    t, s = np.tanh(e @ w["tanh"]), sigmoid(e @ w["gate"])
    a = (t * s) @ w["attend"]
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, firsts), sizes))
    a /= np.repeat(np.add.reduceat(a, firsts), sizes)
    z = np.add.reduceat(a[:, None] * e, firsts)
    return {"e": e, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "p": sigmoid(z @ w["out"] + w["out0"][0])}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, firsts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, firsts)
    e, t, s, a, sizes = (f[k] for k in ("e", "t", "s", "a", "sizes"))
    d = weight * (f["p"] - y)
    dz = np.repeat(d[:, None] * w["out"], sizes, axis=0)
    da = (dz * e).sum(1)
    da = a * (da - np.repeat(np.add.reduceat(a * da, firsts), sizes))
    dts = da[:, None] * w["attend"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    de = (a[:, None] * dz + dt @ w["tanh"].T + ds @ w["gate"].T) * (1 - e * e)
    return {"encode": x.T @ de, "encode0": de.sum(0), "tanh": e.T @ dt, "gate": e.T @ ds, "attend": (t * s).T @ da, "out": f["z"].T @ d, "out0": np.array([d.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.004, decay: float = 1e-3) -> Network:
    """Adam over mini-batches in a fixed order; the same bags give the same network."""
    r = np.random.default_rng(5)
    x = np.concatenate(bags)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    w = {"encode": r.normal(0, WIDTH**-0.5, (WIDTH, ENCODED)), "encode0": np.zeros(ENCODED), "tanh": r.normal(0, 0.3, (ENCODED, GATES)), "gate": r.normal(0, 0.3, (ENCODED, GATES)), "attend": r.normal(0, 0.3, GATES), "out": r.normal(0, 0.3, ENCODED), "out0": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).mean() * len(y)), 0.5 / max(1, (y == 0).mean() * len(y))) * len(y)
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            part = [np.clip((bags[i] - mean) / scale, -8, 8) for i in own]
            g = gradients(w, np.concatenate(part), np.cumsum([0, *map(len, part)])[:-1], y[own], weight[own] / len(own))
            step += 1
            for n in w:
                d = g[n] + decay * w[n] * (w[n].ndim > 1)
                m1[n] = 0.9 * m1[n] + 0.1 * d
                m2[n] = 0.999 * m2[n] + 0.001 * d * d
                w[n] = w[n] - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, {k: v.astype(np.float32) for k, v in w.items()})


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Network | None:
    """A network from the labelled documents for which ``learn`` (over doc_id) holds; None without both classes."""
    table_ = classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = (passages(t, table_) for t in b.column(2).to_pylist())
            rows = [bag[np.unique(np.linspace(0, len(bag) - 1, min(len(bag), FITTED)).astype(int))].astype(np.float16).tobytes() for bag in bags]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "bag"])

    sample = labelled_sample(docs, labels, "quality", learn, per_class, per_class).select("doc_id", "y", "text")
    rows = {(i, bytes(bag)): y for i, y, bag in sample.mapInArrow(run, "doc_id long, y int, bag binary").toLocalIterator()}  # repeated rows once
    rows = sorted(rows.items())
    y = np.array([v for _, v in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    return train([np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for (_, b), _ in rows], y)


def score(docs: DataFrame, network: Network | None, text: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each whole text; a column of that name is replaced."""
    table_ = classes()

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for k in range(0, len(b), 256):
                bags = [passages(t, table_) for t in b.slice(k, 256).to_pylist()]
                out += network.score(bags).tolist() if network else [0.5] * len(bags)
            yield pa.array(out, pa.float64())

    rest = [c for c in docs.columns if c.lower() != score_col.lower()]
    return docs.select(*rest, scored.asNondeterministic()(F.col(text).cast("string")).alias(score_col))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    network = fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    found = score(docs.select("doc_id", "text"), network, score_col="score")
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
