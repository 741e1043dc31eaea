"""Reader documents from Markdown: blocks with their places, and rows to show."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
IMAGE = re.compile(r"\s*!\[([^\]]*)\]\(([^)\s]*)[^)]*\)\s*$")
FENCE = re.compile(r"\s*(```|~~~)")
#: Headings of tables of contents, whose lists of links aren't shown.
CONTENTS = re.compile(r"(table of )?contents|toc|目次", re.IGNORECASE)
LINK_LINE = re.compile(r"\s*([-*+]|\d+\.)\s*\[[^\]]*\]\([^)]*\)\s*$")
_FIELDS = {"block_no": T.LongType(), "kind": T.StringType(), "level": T.IntegerType(), "start": T.LongType(), "text": T.StringType(), "src": T.StringType()}
BLOCK = T.ArrayType(T.StructType([T.StructField(n, kind) for n, kind in _FIELDS.items()]))
_BLOCK = pa.list_(pa.struct([("block_no", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("src", pa.string())]))


def compiled(text: str | None) -> list[dict]:
    """Blocks of a text: headings, paragraphs (a line each), code and images; ``start`` is the place in what is shown.

    Front matter at the top and the links under a heading of contents are left
    out; an image takes no place of its own. A fence that isn't closed ends with the text.
    """
    lines = (text or "").split("\n")
    if lines and lines[0].strip() == "---" and any(x.strip() == "---" for x in lines[1:]):
        lines = lines[1 + next(k for k, x in enumerate(lines[1:]) if x.strip() == "---") + 1 :]
    out: list[dict] = []
    at, skipping, fence, code = 0, False, "", []

    def add(kind: str, shown: str, level: int = 0, src: str | None = None) -> None:
        nonlocal at
        out.append({"block_no": len(out) + 1, "kind": kind, "level": level, "start": at, "text": shown, "src": src})
        at += len(shown) + 1 if kind != "image" else 0

    for line in lines:
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1] == fence:
                add("code", "\n".join(code))
                fence, code = "", []
            else:
                code.append(line)
            continue
        if mark:
            fence, skipping = mark[1], False
            continue
        if not line.strip():
            continue
        heading, image = HEADING.match(line), IMAGE.match(line)
        if heading:
            skipping = bool(CONTENTS.fullmatch(heading[2].strip()))
            if not skipping:
                add("heading", heading[2], len(heading[1]))
        elif skipping and LINK_LINE.match(line):
            continue
        elif image:
            skipping = False
            add("image", image[1], 0, image[2])
        else:
            skipping = False
            add("paragraph", line.strip(" \t"))
    if fence:
        add("code", "\n".join(code))
    return out


@F.arrow_udf(BLOCK)
def blocks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([compiled(x.as_py()) for x in b], _BLOCK)


def reader_document(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block_no, kind, level, start, text, src) of each text's blocks."""
    return docs.select("doc_id", F.explode(blocks_of(F.col(text))).alias("b")).select("doc_id", "b.*")


def reader_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` (keys, block_no, kind, portrait) with ``row_no``: two portrait images that follow each other share a row, all else has its own."""
    w = W.partitionBy(*keys).orderBy("block_no")
    page = (F.col("kind") == "image") & F.coalesce("portrait", F.lit(False))
    rows = blocks.withColumn("_page", page).withColumn("_new", F.coalesce(F.lag("_page").over(w) != F.col("_page"), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    k = F.row_number().over(W.partitionBy(*keys, "_run").orderBy("block_no"))
    rows = rows.withColumn("_first", (~F.col("_page") | (k % 2 == 1)).cast("int"))
    return rows.withColumn("row_no", F.sum("_first").over(w).cast("long")).drop("_page", "_new", "_run", "_first")
