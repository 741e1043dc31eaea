"""Lattice segmentation over a lexicon with connection costs: the best path and the n best ones.

The lexicon and the cost table are the engine's own; any with this shape can be
given: (surface, left, right, cost, feature) and (right, left, cost). Both are
small tables of the driver, checked against ``LIMIT`` before they travel to the
executors. Characters that no entry covers become entries of one character.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2_000_000
UNKNOWN_COST, UNKNOWN = 10_000, "unknown"
_KIND = "array<struct<cost: long, morphemes: array<struct<surface: string, feature: string, start: int, end: int>>>>"
_ARROW = pa.list_(pa.struct([("cost", pa.int64()), ("morphemes", pa.list_(pa.struct([("surface", pa.string()), ("feature", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]))


class Lattice:
    def __init__(self, lexicon: list[tuple[str, int, int, int, str]], costs: dict[tuple[int, int], int]):
        self.entries: dict[str, list[tuple[int, int, int, str]]] = {}
        for surface, left, right, cost, feature in lexicon:
            self.entries.setdefault(surface, []).append((left, right, cost, feature))
        self.longest = max(map(len, self.entries), default=1)
        self.costs = costs

    def edges(self, text: str) -> list[list[tuple[int, int, int, int, str]]]:
        """By end: (start, left, right, cost, feature)."""
        out: list[list[tuple[int, int, int, int, str]]] = [[] for _ in range(len(text) + 1)]
        for a in range(len(text)):
            found = False
            for b in range(a + 1, min(len(text), a + self.longest) + 1):
                for left, right, cost, feature in self.entries.get(text[a:b], ()):
                    out[b].append((a, left, right, cost, feature))
                    found = True
            if not found:
                out[a + 1].append((a, 0, 0, UNKNOWN_COST, UNKNOWN))
        return out

    def best(self, text: str, n: int) -> list[tuple[int, list[tuple[str, str, int, int]]]]:
        """Up to n paths by cost, then by the order of their entries: forward costs by dynamic programming, then best-first from the end, for which they're exact."""
        if not text:
            return []
        edges = self.edges(text)
        join = lambda r, l: self.costs.get((r, l), 0)
        forward: list[list[int]] = [[] for _ in edges]
        for b in range(1, len(edges)):
            for a, left, _, cost, _ in edges[b]:
                before = join(0, left) if a == 0 else min((forward[a][k] + join(e[2], left) for k, e in enumerate(edges[a])), default=1 << 60)
                forward[b].append(before + cost)
        heap = [(forward[-1][k] + join(e[2], 0), ((len(text), k),), join(e[2], 0) + e[3]) for k, e in enumerate(edges[-1])]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < n:
            total, path, after = heapq.heappop(heap)  # after: cost of the path's entries and joins so far
            b, k = path[0]
            a, left = edges[b][k][:2]
            if a == 0:
                out.append((total, [(text[edges[e][j][0] : e], edges[e][j][4], edges[e][j][0], e) for e, j in path]))
                continue
            for j, e in enumerate(edges[a]):
                step = after + join(e[2], left)
                heapq.heappush(heap, (forward[a][j] + step, ((a, j), *path), step + e[3]))
        return out


def analysed(texts: DataFrame, lexicon: DataFrame, costs: DataFrame, n: int = 1, text: str = "text", out: str = "paths") -> DataFrame:
    """``texts`` with an array of up to n (cost, morphemes)."""
    if lexicon.count() > LIMIT or costs.count() > LIMIT:
        raise ValueError(f"a lexicon or cost table may have {LIMIT} rows")
    entries = [tuple(r) for r in lexicon.select("surface", "left", "right", "cost", "feature").collect()]
    joins = {(r[0], r[1]): r[2] for r in costs.select("right", "left", "cost").collect()}

    @F.arrow_udf(_KIND)
    def paths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = Lattice(entries, joins)
        for b in batches:
            yield pa.array([[{"cost": c, "morphemes": [dict(zip(("surface", "feature", "start", "end"), m)) for m in ms]} for c, ms in lattice.best(x or "", n)] for x in b.to_pylist()], _ARROW)

    return texts.withColumn(out, paths(F.col(text)))


def candidates(found: DataFrame, id_col: str, paths: str = "paths") -> DataFrame:
    """(id, rank, cost, relative_cost, morphemes): a row for each path, and how much it costs beyond the best one."""
    rows = found.select(id_col, F.array_min(F.transform(paths, lambda p: p["cost"])).alias("_best"), F.posexplode(paths).alias("_k", "_p"))
    return rows.select(id_col, (F.col("_k") + 1).cast("long").alias("rank"), F.col("_p.cost").alias("cost"), (F.col("_p.cost") - F.col("_best")).alias("relative_cost"), F.col("_p.morphemes").alias("morphemes"))
