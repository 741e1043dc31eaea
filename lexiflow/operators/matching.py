"""Rules over the words of whole texts, matched inside each text.

A rule is a list of atoms. An atom is a set of words or any word, may repeat or
be optional, and may name what it takes. Between atoms a rule may skip a few
words of a given set. Matches lie within a sentence; every choice of
repetitions that fits counts. Rules are data: they come from code or from a
table of JSON patterns, and travel to the executors, behind a check of their
size, as an index by the words of their first atom.

Texts are read once, in one Arrow pass; only matches become rows, so nothing is
shuffled. Null and empty texts have no match.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.text import WORD

PIECE = re.compile(f"[{WORD}]+|[.!?\n]")
#: Characters of rules or entries that travel to the executors at most.
LIMIT = 64_000_000
MATCH = "array<struct<rule_id: string, start_pos: bigint, width: bigint, surface: string, captures: array<struct<name: string, value: string>>>>"
_MATCH = pa.list_(pa.struct([("rule_id", pa.string()), ("start_pos", pa.int64()), ("width", pa.int64()), ("surface", pa.string()), ("captures", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))]))


@dataclass(frozen=True)
class Atom:
    """``words`` (None: any word), how often at least and at most, and the name of what is taken."""

    words: frozenset[str] | None
    least: int = 1
    most: int = 1
    name: str | None = None

    def __post_init__(self):
        if not 0 <= self.least <= self.most <= 8 or self.most == 0:
            raise ValueError("an atom repeats 0 to 8 times")


@dataclass(frozen=True)
class Rule:
    """``skip``: words that may stand between two atoms, ``skipped`` of them at most. ``follow``: a word of so many letters must come later in the sentence."""

    id: str
    atoms: tuple[Atom, ...]
    skip: frozenset[str] = frozenset()
    skipped: int = 0
    follow: int = 0

    def __post_init__(self):
        if not self.atoms or self.atoms[0].words is None or self.atoms[0].least == 0:
            raise ValueError(f"rule {self.id}: the first atom must be there and name words")


def atom(words: str | None, least: int = 1, most: int = 1, name: str | None = None) -> Atom:
    return Atom(frozenset(words.split()) if words else None, least, most, name)


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules of (rule_id, pattern): JSON like ``{"atoms": [{"words": ["a"], "least": 1, "most": 2, "name": "x"}], "skip": [], "skipped": 0}``."""
    size = table.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    if size > LIMIT:
        raise ValueError(f"patterns may have {LIMIT} characters together")
    out = []
    for rule_id, pattern in sorted(tuple(r) for r in table.select("rule_id", "pattern").collect()):
        p = json.loads(pattern)
        atoms = tuple(Atom(frozenset(a["words"]) if a.get("words") else None, a.get("least", 1), a.get("most", 1), a.get("name")) for a in p["atoms"])
        out.append(Rule(rule_id, atoms, frozenset(p.get("skip", ())), p.get("skipped", 0), p.get("follow", 0)))
    return out


def words_of(text: str | None) -> tuple[list[str], list[int]]:
    """Words in lower case, and the number of their sentence."""
    words, sentences, k = [], [], 0
    for s in PIECE.findall(text or ""):
        if s in ".!?\n":
            k += 1
        else:
            words.append(s.lower())
            sentences.append(k)
    return words, sentences


def ways(rule: Rule, words: list[str], at: int, stop: int, k: int = 0) -> Iterator[tuple[int, tuple[tuple[str, int, int], ...]]]:
    """(end, captures) of all ways in which the atoms from the k-th on fit at a place before ``stop``; more repetitions first."""
    if k == len(rule.atoms):
        yield at, ()
        return
    a = rule.atoms[k]
    n = 0
    while n < a.most and at + n < stop and (a.words is None or words[at + n] in a.words):
        n += 1
    for c in range(n, a.least - 1, -1):
        taken = ((a.name, at, at + c),) if a.name and c else ()
        end = at + c
        yield from ((e, taken + rest) for e, rest in ways(rule, words, end, stop, k + 1))
        if rule.skipped and c and k + 1 < len(rule.atoms):
            for s in range(1, rule.skipped + 1):
                if end + s > stop or words[end + s - 1] not in rule.skip:
                    break
                yield from ((e, taken + rest) for e, rest in ways(rule, words, end + s, stop, k + 1))


class Matcher:
    def __init__(self, rules: list[Rule]):
        self.index: dict[str, list[Rule]] = {}
        for r in rules:
            for w in r.atoms[0].words or ():
                self.index.setdefault(w, []).append(r)

    def __call__(self, words: list[str], sentences: list[int]) -> list[tuple[str, int, int, tuple[tuple[str, int, int], ...]]]:
        """(rule, start, end, captures), each (rule, start, end) once."""
        out = []
        index, stop, last = self.index, 0, -1
        for i, w in enumerate(words):
            own = index.get(w)
            if not own:
                continue
            if sentences[i] != last:
                last, stop = sentences[i], i
                while stop < len(words) and sentences[stop] == last:
                    stop += 1
            for r in own:
                seen = set()
                for end, captures in ways(r, words, i, stop):
                    if end not in seen and (not r.follow or any(len(x) >= r.follow for x in words[end:stop])):
                        seen.add(end)
                        out.append((r.id, i, end, captures))
        return out


def per_text(docs: DataFrame, kind: str, arrow: pa.DataType, make: Callable[[], Callable[[list[str], list[int]], list]], out: str, text: str = "text") -> DataFrame:
    """``docs``' ids with ``out``: what the function that ``make`` gives makes of the words and sentences of each text."""

    @F.arrow_udf(kind)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for b in batches:
            yield pa.array([f(*words_of(t.as_py())) for t in b], arrow)

    return docs.select("doc_id", made(F.col(text)).alias(out))


def matches(docs: DataFrame, rules: list[Rule], content: int = 0) -> DataFrame:
    """(doc_id, rule_id, start_pos, width, surface, captures) of all matches; with ``content``, shorter words aren't seen by the rules, and start_pos and width are still those of all words."""

    def make():
        find = Matcher(rules)

        def run(words: list[str], sentences: list[int]) -> list[dict]:
            places = [k for k, w in enumerate(words) if len(w) >= content] if content else None
            seen = [words[k] for k in places] if places is not None else words
            out = []
            for r, a, e, captures in find(seen, [sentences[k] for k in places] if places is not None else sentences):
                start, end = (places[a], places[e - 1] + 1) if places is not None else (a, e)
                out.append({"rule_id": r, "start_pos": start, "width": end - start, "surface": " ".join(seen[a:e]), "captures": [{"name": n, "value": " ".join(seen[x:y])} for n, x, y in captures]})
            return out

        return run

    found = per_text(docs, MATCH, _MATCH, make, "m")
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def nearest(docs: DataFrame, heads: frozenset[str], tails: frozenset[str], least: int, most: int, content: int = 0) -> DataFrame:
    """(doc_id, head_pos, tail_pos): each head with the nearest tail of its sentence, ``least`` to ``most`` words between (of those with ``content`` letters)."""

    def make():
        def run(words: list[str], sentences: list[int]) -> list[dict]:
            places = [k for k, w in enumerate(words) if len(w) >= content] if content else range(len(words))
            out = []
            for i, p in enumerate(places):
                if words[p] in heads:
                    for q in places[i + least + 1 : i + most + 2]:
                        if sentences[q] != sentences[p]:
                            break
                        if words[q] in tails:
                            out.append({"head_pos": p, "tail_pos": q})
                            break
            return out

        return run

    found = per_text(docs, "array<struct<head_pos: bigint, tail_pos: bigint>>", pa.list_(pa.struct([("head_pos", pa.int64()), ("tail_pos", pa.int64())])), make, "m")
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def windows(docs: DataFrame, entries: DataFrame, longest: int, claim: bool = False, least: int = 2) -> DataFrame:
    """(doc_id, pos, gram): windows of ``longest`` to ``least`` adjacent words of a sentence that are entries (gram); with ``claim`` longer ones first, and none within one that is taken.

    Entries travel as a set while they have up to LIMIT characters; beyond
    that windows are rows and are joined, and those within others dropped after.
    """
    entries = entries.select("gram").distinct()
    size = entries.agg(F.coalesce(F.sum(F.length("gram") + 50), F.lit(0))).first()[0]
    known = frozenset(r[0] for r in entries.toLocalIterator()) if size <= LIMIT else None
    lengths = range(longest, least - 1, -1)

    def make():
        firsts = {g.split(" ", 1)[0] for g in known} if known is not None else None

        def run(words: list[str], sentences: list[int]) -> list[dict]:
            out, taken = [], [0] * len(words)  # taken: where the longest window from here or before ends
            for n in lengths:
                for k in range(len(words) - n + 1):
                    if (firsts is not None and words[k] not in firsts) or sentences[k] != sentences[k + n - 1]:
                        continue
                    gram = " ".join(words[k : k + n])
                    if known is None or gram in known:
                        if claim and known is not None:
                            if taken[k] >= k + n:
                                continue
                            for j in range(k, k + n):
                                taken[j] = max(taken[j], k + n)
                        out.append({"pos": k, "n": n, "gram": gram})
            return out

        return run

    found = per_text(docs, "array<struct<pos: bigint, n: int, gram: string>>", pa.list_(pa.struct([("pos", pa.int64()), ("n", pa.int32()), ("gram", pa.string())])), make, "m")
    rows = found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
    if known is None:
        rows = rows.join(entries, "gram", "left_semi")
        if claim:
            from pyspark.sql import Window as W

            reach = F.max(F.col("pos") + F.col("n")).over(W.partitionBy("doc_id").orderBy("pos", F.desc("n")).rowsBetween(W.unboundedPreceding, -1))
            rows = rows.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < F.col("pos") + F.col("n")))
    return rows.select("doc_id", "pos", "gram")


def grams(docs: DataFrame, n: int, content: int = 0) -> DataFrame:
    """(gram): the distinct runs of n words of a sentence, of those with ``content`` letters."""

    def make():
        def run(words: list[str], sentences: list[int]) -> list[str]:
            places = [k for k, w in enumerate(words) if len(w) >= content]
            return sorted({" ".join(words[p] for p in places[k : k + n]) for k in range(len(places) - n + 1) if sentences[places[k]] == sentences[places[k + n - 1]]})

        return run

    found = per_text(docs, "array<string>", pa.list_(pa.string()), make, "g")
    return found.select(F.explode("g").alias("gram")).distinct()


def positions(found: DataFrame) -> DataFrame:
    """``found`` once for each word it covers, with ``pos`` and whether that's the start, middle, end or single word."""
    rows = found.withColumn("pos", F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + F.col("width") - 1)))
    at = F.col("pos") - F.col("start_pos")
    return rows.withColumn("position", F.when(F.col("width") == 1, "single").when(at == 0, "start").when(at == F.col("width") - 1, "end").otherwise("middle"))


def longest(found: DataFrame) -> DataFrame:
    """Of the matches that begin at one word the longest, and of equal ones that with the smallest rule id."""
    best = found.groupBy("doc_id", "start_pos").agg(F.min_by(F.struct("rule_id", "width"), F.struct(-F.col("width"), F.col("rule_id"))).alias("b"))
    return best.select("doc_id", "start_pos", "b.*")


def reranked(docs: DataFrame, known: int, n: int) -> DataFrame:
    """(doc_id, sent, cost, rank): of each text's sentences the n with the least cost, a word each, less the squared letters of words of ``known`` letters or more; then by cost and place."""

    def make():
        def run(words: list[str], sentences: list[int]) -> list[dict]:
            cost: dict[int, int] = {}
            gain: dict[int, int] = {}
            for w, s in zip(words, sentences):
                cost[s] = cost.get(s, 0) + 1
                if len(w) >= known:
                    gain[s] = gain.get(s, 0) + len(w) ** 2
            best = sorted(cost, key=lambda s: (cost[s] - gain.get(s, 0), cost[s], s))[:n]
            return [{"sent": s, "cost": cost[s], "rank": k + 1} for k, s in enumerate(best)]

        return run

    fields = ("sent", "cost", "rank")
    found = per_text(docs, "array<struct<sent: bigint, cost: bigint, rank: bigint>>", pa.list_(pa.struct([(n, pa.int64()) for n in fields])), make, "m")
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
