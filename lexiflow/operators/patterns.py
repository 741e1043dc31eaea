"""Sequence patterns over ordered tokens.

A pattern is a list of atoms; an atom is a set of words, or None for any word.
Contiguous patterns are equi-joins on consecutive places; repeated and
optional atoms are expanded into variants of fixed length when the rule is
compiled, so that matching stays a join on (document, place).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Atom = tuple[frozenset[str] | None, int, int]  # words (None: any), least and most times


def atom(words: str | None, least: int = 1, most: int = 1) -> Atom:
    """An atom over words separated by spaces; with least = 0 it's optional."""
    if not 0 <= least <= most <= 8 or most == 0:
        raise ValueError("an atom repeats 0 to 8 times")
    return frozenset(words.split()) if words else None, least, most


def variants(atoms: list[Atom]) -> list[list[frozenset[str] | None]]:
    """Fixed-length forms, those with more repetitions first."""
    if all(w is None for w, _, _ in atoms):
        raise ValueError("a pattern needs an atom with words")
    counts = product(*[range(most, least - 1, -1) for _, least, most in atoms])
    return [v for c in counts if (v := [w for (w, _, _), n in zip(atoms, c) for _ in range(n)])]


def contiguous(tokens: DataFrame, rules: dict[str, list[Atom]]) -> DataFrame:
    """(doc_id, rule_id, start_pos, width, surface) of all matches within sentences; of a rule's variants at one place, all count.

    One window pass looks ahead as far as the longest variant; each variant is
    then a filter on the words found there.
    """
    compiled = {r: variants(a) for r, a in rules.items()}
    longest = max(len(v) for vs in compiled.values() for v in vs)
    w = W.partitionBy("doc_id", "sent").orderBy("pos")
    rows = tokens.select("doc_id", "pos", F.array(F.col("w"), *[F.lead("w", k).over(w) for k in range(1, longest)]).alias("ahead"))
    found = []
    for rule, vs in compiled.items():
        for v in vs:
            fits = F.lit(True)
            for k, words in enumerate(v):
                word = F.col("ahead")[k]
                fits = fits & (word.isNotNull() if words is None else word.isin(sorted(words)))
            found.append(F.when(fits, F.struct(F.lit(rule).alias("rule_id"), F.lit(len(v)).cast("long").alias("width"), F.array_join(F.slice("ahead", 1, len(v)), " ").alias("surface"))))
    hits = rows.select("doc_id", "pos", F.explode(F.array_compact(F.array_distinct(F.array(*found)))).alias("m"))
    return hits.select("doc_id", "m.rule_id", F.col("pos").alias("start_pos"), "m.width", "m.surface")


def nearest_gap(tokens: DataFrame, head: str, tail: str, least: int, most: int) -> DataFrame:
    """(doc_id, head_pos, tail_pos): each head with the nearest tail of its sentence, ``least`` to ``most`` words between.

    The nearest tail at or after head + least + 1 is a window's minimum, so
    heads and tails are never joined.
    """
    w = W.partitionBy("doc_id", "sent").orderBy("pos").rangeBetween(least + 1, most + 1)
    rows = tokens.select("doc_id", "pos", "w", F.min(F.when(F.col("w") == tail, F.col("pos"))).over(w).alias("tail_pos"))
    return rows.where((F.col("w") == head) & F.col("tail_pos").isNotNull()).select("doc_id", F.col("pos").alias("head_pos"), "tail_pos")


def windows_in(tokens: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, gram): windows of n words of a sentence that are in ``entries`` (gram)."""
    w = W.partitionBy("doc_id", "sent").orderBy("pos")
    parts = [F.col("w"), *[F.lead("w", k).over(w) for k in range(1, n)]]
    grams = tokens.select("doc_id", "pos", F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts)).alias("gram")).where("gram is not null")
    return grams.join(entries.select("gram").distinct(), "gram", "left_semi").select("doc_id", "pos", "gram")
