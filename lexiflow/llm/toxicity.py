"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters in lower case; chains end at ``. ! ?``, line ends,
and after ``CHAIN`` tokens. The field has two tags (offending, other), weights
for the word, its beginnings and endings, the words beside it, and for the
change from tag to tag. Forward-backward marginals of all tokens of the whole
text give the offsets (marginal of 0.5 or more) and, through a logistic curve
over their maximum and their sum, the document's score.

Only documents are labelled, so token labels are derived first: a word, a
beginning or an ending marks a token of a toxic document as offending if at
least ``PRECISION`` of the labelled documents that hold it are toxic and it
follows at least ``CONTEXTS`` different words; copies of one text thus count
once. ``PRIOR`` clean documents are added to each count, so that rare words
need more than a few lucky finds.

All of this is fitted on a bounded sample of labelled rows, ``CLEAN`` and
``TOXIC`` documents at most, and of each up to ``CHAINS_KEPT`` chains with and
without offending tokens. Each sampled row counts as much as the labelled rows
that it stands for, in the lexicon, the field and the curve, so that the mix
of classes is that of all labels, however many there are. The curve sees only
scores that a field fitted on the other part of the sample gives.

Every row's whole text is scored, however long. Null and empty texts
have no token: their score is that of a text without offending tokens. With no
labelled toxic document every score is 0. Repeated rows and null ids are scored
like others; extra columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import held_out, labelled_sample, outside, released, table

TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = ".!?\n"
CHAIN = 200
#: Size of the hashed weight table.
WIDTH = 1 << 18
#: Fit parameters: labelled documents of either class, precision, contexts and prior of a lexicon entry, chains kept for each document, parts of the sample.
CLEAN, TOXIC, PRECISION, CONTEXTS, PRIOR, CHAINS_KEPT, PARTS = 2000, 2000, 0.9, 5, 0.3, 3, 2
#: Features that a task counts at a time, and words whose weights it remembers, at most.
REMEMBERED, WORDS = 150_000, 150_000


def features(word: str) -> list[str]:
    n = len(word)
    return ["w=" + word, *(f"p{k}={word[:k]}" for k in (4, 5, 6) if n > k), *(f"s{k}={word[-k:]}" for k in (4, 5) if n > k)]


def slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (WIDTH - 1)


@dataclass
class Field:
    """A fitted field. moves: weights of other-to-offending, offending-to-offending, offending-to-other."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    curve: tuple[float, float, float]  # of the document's score: constant, for the maximum, for log(1 + sum)


def chains_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains between the tokens that are ends."""
    inner = np.flatnonzero(~ends)
    if not len(inner):
        return inner, inner
    fresh = np.r_[True, np.diff(inner) > 1]
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(inner)), 0))
    first = np.flatnonzero((np.arange(len(inner)) - run) % CHAIN == 0)
    return inner[first], np.diff(np.r_[first, len(inner)])


def marginals(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(offending) of each token by forward-backward over all chains at once; with weights of the tokens, the expected weight of each move."""
    out, moved = np.zeros(len(score)), np.zeros(3)
    if not len(starts):
        return out, moved
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    odds = np.exp(np.clip(score, -30, 30))
    enter, stay, leave = np.exp(moves)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # chains longer than t
    forward = np.zeros(len(score))
    p = np.zeros(len(starts))
    for t in range(lengths[0]):
        n = alive[t]
        at = starts[:n] + t
        q = p[:n]
        on, off = ((1 - q) * enter + q * stay if t else np.ones(n)) * odds[at], (1 - q + q * leave if t else np.ones(n))
        p[:n] = forward[at] = on / (on + off)
    b_on, b_off = np.ones(len(starts)), np.ones(len(starts))
    for t in range(lengths[0] - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        on, off = forward[at] * b_on[:n], (1 - forward[at]) * b_off[:n]
        out[at] = on / (on + off)
        if t:
            x_on, x_off = odds[at] * b_on[:n], b_off[:n]
            if weight is not None:
                f = forward[at - 1]
                pairs = np.stack([(1 - f) * enter * x_on, f * stay * x_on, f * leave * x_off])
                moved += (pairs / (pairs.sum(0) + (1 - f) * x_off)) @ weight[at]
            on, off = leave * x_off + stay * x_on, x_off + enter * x_on
            b_on[:n], b_off[:n] = on / (on + off), off / (on + off)
    return out, moved


class Words(dict):
    """word -> number; for each number the word's weight for itself, for the token after it and for the one before it. 0-3 are the ends."""

    def __init__(self, field: Field):
        super().__init__({c: i for i, c in enumerate(ENDS)})
        self.field, self.own, self.onward, self.back = field, array("d", [0.0] * 4), array("d", [0.0] * 4), array("d", [0.0] * 4)

    def __missing__(self, word: str) -> int:
        w = self.field.weights
        self.own.append(float(sum(w[slot(f)] for f in features(word))) + self.field.bias)
        self.onward.append(float(w[slot("l=" + word)]))
        self.back.append(float(w[slot("r=" + word)]))
        out = self[word] = len(self.own) - 1
        return out


def tag(texts: list[str | None], words: Words) -> list[tuple[float, float, list[tuple[int, int, float]]]]:
    """Of each text: largest marginal, sum of the marginals of offending tokens, and (start, end, largest marginal) of the offending runs."""
    tokens: list[str] = []
    counts = []
    for t in texts:
        found = TOKEN.findall((t or "").lower())
        found.append("\n")
        counts.append(len(found))
        tokens += found
    ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    own, onward, back = (np.array(x) for x in (words.own, words.onward, words.back))
    ends = ids < len(ENDS)
    score = own[ids]
    score[1:] += onward[ids[:-1]]
    score[:-1] += back[ids[1:]]
    m, _ = marginals(score, *chains_of(ends), words.field.moves)
    first = np.cumsum(counts) - counts
    most, total = np.maximum.reduceat(m, first), np.add.reduceat(np.where(m >= 0.5, m, 0), first)
    out = []
    for k, t in enumerate(texts):
        out.append((float(most[k]), float(total[k]), offsets(t, m[first[k] : first[k] + counts[k]]) if most[k] >= 0.5 else []))
    return out


def offsets(text: str, m: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of offending tokens as code points of the text itself."""
    lower = text.lower()
    # a few letters change length in lower case; then places are found through the text letter by letter
    place = None if len(lower) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    spans: list[tuple[int, int, float]] = []
    joined = False
    for k, found in enumerate(TOKEN.finditer(lower)):
        if m[k] >= 0.5:
            a, b = found.span()
            if place:
                a, b = place[min(a, len(place) - 1)], place[min(b - 1, len(place) - 1)] + 1
            spans[-1:] = [(spans[-1][0], b, max(spans[-1][2], float(m[k])))] if joined else [*spans[-1:], (a, b, float(m[k]))]
        joined = m[k] >= 0.5
    return spans


def feature_counts(sample: DataFrame) -> DataFrame:
    """(f, part, clean, toxic, seen) of (y, weight, part, text): the weights of the documents of either class that hold a feature, and bits of the words before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], list[float]] = {}
        for b in batches:
            for y, weight, part, t in zip(*(c.to_pylist() for c in b.columns)):
                tokens = TOKEN.findall(t.lower())
                before = {}
                for p, w in zip(["", *tokens], tokens):
                    before[w] = before.get(w, 0) | 1 << (xxhash.xxh32_intdigest(p) & 62)
                own: dict[str, int] = {}
                for w, seen in before.items():
                    if w not in ENDS:
                        for f in features(w):
                            own[f] = own.get(f, 0) | seen
                for f, seen in own.items():
                    x = found.setdefault((part, f), [0.0, 0.0, 0])
                    x[y] += weight
                    if y:
                        x[2] |= seen
            if len(found) > REMEMBERED:
                yield rows(found)
                found = {}
        yield rows(found)
        found = None
        released()

    def rows(found: dict[tuple[int, str], list[float]]) -> pa.RecordBatch:
        kinds = (pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([f for _, f in found], pa.string()), pa.array([p for p, _ in found], pa.int32()), *(pa.array([x[k] for x in found.values()], kind) for k, kind in enumerate(kinds))], ["f", "part", "clean", "toxic", "seen"])

    counted = sample.select("y", "weight", "part", "text").mapInArrow(count, "f string, part int, clean double, toxic double, seen long")
    summed = counted.groupBy("f", "part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("seen").alias("seen"))
    return summed.where("toxic > 0")


def lexicon(counts: DataFrame, prior: float) -> set[str]:
    """Words, beginnings and endings that mark toxic documents: those whose share of toxic documents, with ``prior`` clean ones more, is PRECISION or more."""
    summed = counts.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("seen").alias("seen"))
    chosen = summed.where((F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean") + prior)) & (F.bit_count("seen") >= CONTEXTS))
    return {r[0] for r in chosen.select("f").collect()}


def labelled_chains(sample: DataFrame, marks: set[str]) -> list[tuple[list[str], list[int], float]]:
    """Token lists with tags and weights, from (y, weight, text): chains with marked tokens and as many others, a few for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: dict[str, bool] = {}
        for b in batches:
            weights, kept, tags = [], [], []
            for y, weight, t in zip(*(c.to_pylist() for c in b.columns)):
                tokens = TOKEN.findall(t.lower())
                for w in set(tokens) - marked.keys():
                    marked[w] = w not in ENDS and any(f in marks for f in features(w))
                hits = np.array([marked[w] for w in tokens], bool)
                starts, lengths = chains_of(np.array([w in ENDS for w in tokens], bool))
                groups: tuple[list, list] = ([], [])
                for a, n in zip(starts.tolist(), lengths.tolist()):
                    groups[bool(hits[a : a + n].any())].append((xxhash.xxh32_intdigest("".join(tokens[a : a + n])), a, n))
                for g in groups:
                    for _, a, n in sorted(g)[:CHAINS_KEPT]:
                        weights.append(weight)
                        kept.append(" ".join(tokens[a : a + n]))
                        tags.append((hits[a : a + n] & bool(y)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(tags, pa.binary()), pa.array(weights, pa.float64())], ["tokens", "tags", "weight"])

    found = sample.select("y", "weight", "text").mapInArrow(run, "tokens string, tags binary, weight double").collect()
    return sorted((r[0].split(" "), list(bytes(r[1])), r[2]) for r in found)


def fit_field(chains: list[tuple[list[str], list[int], float]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-6) -> Field:
    """Maximum weighted likelihood with Adam steps over all chains; the same chains give the same field."""
    tokens = [w for c, _, _ in chains for w in [*c, "\n"]]
    tags = np.array([t for _, c, _ in chains for t in [*c, 0]], float)
    weight = np.repeat([w for _, _, w in chains], [len(c) + 1 for c, _, _ in chains])
    ends = np.array([w in ENDS for w in tokens], bool)
    starts, lengths = chains_of(ends)
    names = {w: k for k, w in enumerate(dict.fromkeys(tokens))}
    ids = np.fromiter((names[w] for w in tokens), np.int64, len(tokens))
    del tokens
    own = np.full((len(names), 6), WIDTH, np.int32)
    for w, k in names.items():
        if w not in ENDS:
            row = [slot(f) for f in features(w)]
            own[k, : len(row)] = row
    onward, back = (np.array([slot(side + w) for w in names], np.int32) for side in ("l=", "r="))
    slots = np.full((len(ids), 8), WIDTH, np.int32)
    slots[:, :6] = own[ids]
    joined = ~ends[1:] & ~ends[:-1]
    slots[1:, 6][joined] = onward[ids[:-1]][joined]
    slots[:-1, 7][joined] = back[ids[1:]][joined]
    used, at = np.unique(slots, return_inverse=True)
    at = at.reshape(-1, 8).astype(np.int32)
    follow = np.flatnonzero(~ends[1:] & ~ends[:-1])
    a, b = tags[follow], tags[follow + 1]
    seen = np.array([(1 - a) * b, a * b, a * (1 - b)]) @ weight[follow]
    x = np.zeros(len(used) + 4)  # weights of the used slots, bias, moves
    x[len(used)] = -2.0
    pad = int(np.searchsorted(used, WIDTH))
    m1, m2, n = np.zeros_like(x), np.zeros_like(x), max(1.0, float(weight[~ends].sum()))
    for step in range(1, rounds + 1):
        score = x[: len(used)][at].sum(1) + x[len(used)]
        p, moved = marginals(score, starts, lengths, x[-3:], weight)
        g = np.where(ends, 0, weight * (tags - p))
        grad = np.r_[np.bincount(at.ravel(), np.repeat(g, 8), len(used)), g.sum(), seen - moved] / n - decay * x
        if pad < len(used):
            grad[pad] = 0
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(WIDTH, np.float32)
    real = used < WIDTH
    weights[used[real]] = x[: len(used)][real]
    return Field(weights, float(x[len(used)]), x[-3:].copy(), (0.0, 0.0, 0.0))


def fit_curve(rows: list[tuple[int, float, float, float]]) -> tuple[float, float, float]:
    """Logistic curve over (maximum, log(1 + sum)) from (y, weight, maximum, sum); slopes stay at zero or above."""
    y = np.array([r[0] for r in rows], float)
    x = np.array([[1.0, r[2], np.log1p(r[3])] for r in rows])
    weight = np.array([r[1] for r in rows])
    weight = weight / weight.sum()
    v = np.zeros(3)
    for _ in range(4000):
        p = 1 / (1 + np.exp(-x @ v))
        v += 4.0 * (x.T @ (weight * (y - p)) - 1e-3 * v * [0, 1, 1])
        v[1:] = np.maximum(v[1:], 0)
    return tuple(v.tolist())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, clean: int = CLEAN, toxic: int = TOXIC) -> Field | None:
    """A field from the labelled documents for which ``learn`` (over doc_id) holds; None without a toxic one."""
    sample = labelled_sample(docs, labels, "toxic", learn, clean, toxic)
    # copies of one text are in the same part
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")
    sample = sample.select("doc_id", "y", "weight", "text", part.alias("part")).repartition("doc_id").persist()
    try:
        counts = feature_counts(sample).persist()
        clean_weight = sample.where("y = 0").agg(F.max("weight")).first()[0] or 1.0

        def fitted(rows: DataFrame, counted: DataFrame) -> Field | None:
            marks = lexicon(counted, PRIOR * clean_weight)
            chains = labelled_chains(rows, marks) if marks else []
            return fit_field(chains) if any(1 in tags for _, tags, _ in chains) else None

        field = fitted(sample, counts)
        if field is None:
            return None
        tagged = []
        for k in range(PARTS):
            other = fitted(sample.where(F.col("part") != k), counts.where(F.col("part") != k))
            tagged += sample.where(F.col("part") == k).select("y", "weight", tagger(other, True)("text").alias("s")).select("y", "weight", "s.most", "s.total").collect()
        field.curve = fit_curve(sorted(tuple(r) for r in tagged))
        return field
    finally:
        sample.unpersist()
        counts.unpersist()


def tagger(field: Field | None, raw: bool = False):
    """Arrow UDF: text -> struct of score (raw: of most and total) and offending spans."""
    kind = "struct<start: int, end: int, marginal: double>"

    @F.arrow_udf(f"struct<most: double, total: double, score: double, spans: array<{kind}>>")
    def tagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(field) if field else None
        made = pa.struct([("most", pa.float64()), ("total", pa.float64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))])
        for b in batches:
            for k in range(0, len(b), 500):
                out = []
                texts = b.slice(k, 500).to_pylist()
                found = tag(texts, words) if words is not None else [(0.0, 0.0, [])] * len(texts)
                for most, total, spans in found:
                    c = field.curve if field else None
                    score = 1 / (1 + np.exp(-(c[0] + c[1] * most + c[2] * np.log1p(total)))) if c else 0.0
                    out.append({"most": most, "total": total, "score": float(score), "spans": [{"start": a, "end": e, "marginal": m} for a, e, m in spans]})
                if words is not None and len(words) > WORDS:
                    words = Words(field)
                yield pa.array(out, made)
        words = out = texts = found = None
        released()

    return tagged.asNondeterministic()  # else a filter on its output would run it twice


def score(docs: DataFrame, field: Field | None, text: str = "text", score_col: str = "toxicity", spans: str = "toxic_spans") -> DataFrame:
    """``docs`` with the score and the offending spans of each whole text; columns of those names are replaced."""
    rest = [c for c in docs.columns if c.lower() not in {score_col.lower(), spans.lower()}]
    tagged = outside(docs, "_tagged")
    return docs.select(*rest, tagger(field)(F.col(text).cast("string")).alias(tagged)).select(*rest, F.col(f"{tagged}.score").alias(score_col), F.col(f"{tagged}.spans").alias(spans))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and offending spans of every document."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    found = score(docs.select("doc_id", "text"), field, score_col="score")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_spans")
