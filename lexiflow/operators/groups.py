"""Work on one group of rows after another, in Python.

Groups are dealt to partitions and sorted by the engine; rows come in batches
of many groups, so that a group of a few rows costs no batch of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch of results, or else one group's.
BLOCK = 10_000


def by_group(rows: DataFrame, keys: list[str], order: list[str], schema: str, run: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Rows (schema) that ``run`` gives for the rows of each group, as tuples (keys, then the other columns) in their ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    arrow, n = to_arrow_schema(T._parse_datatype_string(schema)), len(keys)

    def block(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if group and r[:n] != group[0][:n]:
                    out += run(group)
                    group = []
                    if len(out) >= BLOCK:
                        yield block(out)
                        out = []
                group.append(r)
        if group:
            out += run(group)
        if out:
            yield block(out)

    dealt = rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(mapped, schema)


def earlier(before: Callable[[int], int], a: int, b: int) -> bool:
    """Whether the path of as many steps that ends at ``a`` has the earlier ends than the one at ``b``: both are followed back to where they meet."""
    first = False
    while a != b:
        first = a < b
        a, b = before(a), before(b)
    return first
