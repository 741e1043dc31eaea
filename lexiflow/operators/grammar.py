"""Occurrences of rules: chains, deduplication, refinement, residuals, explanations; pairing of unmatched entities."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiflow.operators.groups import by_group


def chains(tokens: DataFrame, is_root: Column, is_auxiliary: Column) -> DataFrame:
    """(doc_id, sent, start_pos, n_aux, operators): each root with the unbroken run of auxiliaries after it, roots without any left out.

    One window pass: whatever is neither root nor auxiliary ends a chain.
    """
    w = W.partitionBy("doc_id", "sent").orderBy("pos")
    kind = F.when(is_auxiliary, 2).when(is_root, 1).otherwise(0)
    rows = tokens.withColumn("kind", kind).withColumn("chain", F.sum((F.col("kind") < 2).cast("long")).over(w))
    grouped = rows.where("kind > 0").groupBy("doc_id", "sent", "chain").agg(F.max(F.when(F.col("kind") == 1, F.col("pos"))).alias("start_pos"), F.sum((F.col("kind") == 2).cast("long")).alias("n_aux"), F.array_sort(F.collect_list(F.when(F.col("kind") == 2, F.struct("pos", "w")))).alias("aux"))
    rows = grouped.where("start_pos is not null and n_aux > 0")
    return rows.select("doc_id", "sent", "start_pos", "n_aux", F.array_join(F.transform("aux", lambda a: a["w"]), " ").alias("operators"))


def deduplicated(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence, priority, evidence, n): one row for each key with the largest confidence and priority and all its evidence in order."""
    return candidates.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"), F.count("*").alias("n"))


def refine(rows: list[dict]) -> list[str]:
    """Statuses after refinement, in the order of the rows; later rows see what earlier ones changed.

    An accepted occurrence with a higher priority that refines a concept
    rejects overlapping occurrences of it; in one conflict group the higher
    priority demotes overlapping ones to pending. Only occurrences that refine
    the same concept, or are of the same group, are looked at, in the order of
    their starts and no farther than an overlap can reach.
    """
    status = [r["status"] for r in rows]
    by: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for j, o in enumerate(rows):
        for kind in ("refines", "conflict_group"):
            if o[kind] is not None:
                by.setdefault((kind, o[kind]), []).append((o["start"], j))
    widest = {}
    for key, own in by.items():
        own.sort()
        widest[key] = max(rows[j]["end"] - rows[j]["start"] for _, j in own)

    def beaten(i: int, key: tuple[str, str | None]) -> bool:
        r, own = rows[i], by.get(key, [])
        low = bisect_left(own, (r["start"] - widest.get(key, 0), -1))
        for start, j in own[low:]:
            if start >= r["end"]:
                break
            o = rows[j]
            if j != i and status[j] == "accepted" and o["priority"] > r["priority"] and r["start"] < o["end"]:
                return True
        return False

    for i, r in enumerate(rows):
        if beaten(i, ("refines", r["concept"])):
            status[i] = "rejected"
        elif status[i] == "accepted" and r["conflict_group"] is not None and beaten(i, ("conflict_group", r["conflict_group"])):
            status[i] = "pending"
    return status


REFINED = "concept string, start long, `end` long, priority long, refines string, conflict_group string, status string, id long"


def refined(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """``occurrences`` (REFINED and keys) with ``resolved``; sequential within a group, whose rows are taken by priority, start and id."""

    columns = occurrences.columns
    names = [*keys, *(c for c in columns if c not in keys)]

    def run(group: list[tuple]) -> list[tuple]:
        rows = sorted((dict(zip(names, r)) for r in group), key=lambda r: (-r["priority"], r["start"], r["id"]))
        return [(*r.values(), s) for r, s in zip(rows, refine(rows))]

    schema = ", ".join(f"`{c}` {occurrences.schema[c].dataType.simpleString()}" for c in names) + ", resolved string"
    return by_group(occurrences, keys, [], schema, run).select(*columns, "resolved")


def pair(before: list[dict], after: list[dict]) -> list[tuple[int, int, int]]:
    """(before, after, cost): each before, in order of key, with the unused after that differs in the fewest fields; of equal ones the first.

    Afters wait in a queue for each choice of fields and their values, so a
    before looks at the heads of a few queues instead of at all afters.
    """
    if not before or not after:
        return []
    n = len(after[0]["fields"])
    kept = sorted((c for k in range(n + 1) for c in combinations(range(n), k)), key=lambda c: -len(c))
    queues: list[dict[tuple, deque[int]]] = []
    for c in kept:
        waiting: dict[tuple, deque[int]] = {}
        for k, a in enumerate(after):
            waiting.setdefault(tuple(a["fields"][f] for f in c), deque()).append(k)
        queues.append(waiting)
    used = [False] * len(after)
    out = []
    for b in before:
        found: tuple[int, int] | None = None
        for c, waiting in zip(kept, queues):
            if found and n - len(c) > found[0]:
                break
            queue = waiting.get(tuple(b["fields"][f] for f in c))
            while queue and used[queue[0]]:
                queue.popleft()
            if queue and (found is None or queue[0] < found[1]):
                found = (n - len(c), queue[0])
        if found:
            used[found[1]] = True
            out.append((b["key"], after[found[1]]["key"], found[0]))
    return out


def pair_unmatched(before: DataFrame, after: DataFrame, anchors: list[str]) -> DataFrame:
    """(before_key, after_key, cost) within each anchor, from (anchors, key, fields array<string>) of both sides; a small group for each anchor."""
    both = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1)))

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["key"])
        found = pair([r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1])
        return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("before_key", "after_key", "cost"))})

    return both.groupBy(*anchors).applyInArrow(run, "before_key long, after_key long, cost long")


def residuals(tokens: DataFrame, covered: DataFrame) -> DataFrame:
    """Tokens in no covered range (doc_id, start, end): points and ranges go through one sorted window instead of a range join."""
    starts = covered.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("end").alias("reach"), F.lit(None).cast("long").alias("pos"))
    points = tokens.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("reach"), "pos")
    w = W.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    return starts.unionByName(points).withColumn("open", F.max("reach").over(w)).where("kind = 1 and (open is null or open <= `at`)").select("doc_id", "pos")


def explained(occurrences: DataFrame, by_sense: DataFrame, by_concept: DataFrame) -> DataFrame:
    """``occurrences`` (concept, sense, explicit) with ``explanation``: its own, else its sense's, else its concept's."""
    rows = occurrences.join(by_sense.withColumnRenamed("explanation", "s"), "sense", "left").join(by_concept.withColumnRenamed("explanation", "c"), "concept", "left")
    return rows.withColumn("explanation", F.coalesce("explicit", "s", "c")).drop("s", "c")


def sense_confidence(candidates: DataFrame, by: list[str], confidence: str, step: int = 4) -> DataFrame:
    """``candidates`` with their confidence less ``step`` for each other sense of the same concept, and not under 0."""
    n = F.count("*").over(W.partitionBy(*by))
    return candidates.withColumn(confidence, F.greatest(F.col(confidence) - step * (n - 1), F.lit(0)).cast("long"))
