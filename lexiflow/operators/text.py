"""Text preparation: segments, tokens, sentences, paragraphs, context.

Offsets are code points, half open. Tokens come from one Arrow pass over each
text, so that no row is shuffled to find its place in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexiflow.sources.tables import lines

WORD = "A-Za-zÀ-ÖØ-öø-ÿ0-9"
#: Pieces that leave Python at once, or else one text's, and bytes of text that are cut at once, or else one text.
BLOCK, BYTES = 20_000, 1 << 18
_FIELDS = {"i": T.LongType(), "kind": T.StringType(), "start": T.LongType(), "end": T.LongType(), "sent": T.LongType(), "line": T.LongType(), "surface": T.StringType()}
_PIECES = T.ArrayType(T.StructType([T.StructField(n, kind) for n, kind in _FIELDS.items()]))
# fixed values: kinds of characters, by their first byte in UTF-8
_WORD, _OTHER, _BREAK = 0, 1, 2


def _texts(b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, where each text begins in them, and their end) of consecutive texts; null is empty."""
    b = b.cast(pa.string()).fill_null("")
    if not len(b):
        return
    bounds = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1].astype(np.int64)
    data = np.frombuffer(b.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(b):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BYTES, "right")) - 1)
        yield data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray]:
    """Columns of the pieces of some texts, their surfaces, and the number of pieces before each text and in all.

    A piece is a run of letters and digits, a line break, or what lies between.
    All texts are cut at once in arrays of numbers; no piece is an object of
    Python, and surfaces are the texts' own bytes.
    """
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[x for x in range(128) if chr(x).isalnum()]] = _WORD
    kinds[10] = _BREAK
    kind = kinds[data]
    # U+00C0 to U+00FF but for the signs of multiplication and division
    latin = np.flatnonzero(data == 0xC3)
    kind[latin] = np.where(np.isin(data[latin + 1], (0x97, 0xB7)), _OTHER, _WORD)
    places = np.flatnonzero((data & 0xC0) != 0x80)  # bytes with which code points begin
    kind, first = kind[places], data[places]
    texts = np.searchsorted(places, bounds)
    fresh = np.ones(len(places), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _BREAK)
    fresh[texts[texts < len(places)]] = True
    begin = np.flatnonzero(fresh)
    before = np.searchsorted(begin, texts)
    text = np.repeat(np.arange(len(texts) - 1), np.diff(before))
    counted = lambda hit: np.concatenate([[0], np.cumsum(hit)])
    ends, breaks, kind = counted(np.isin(first, (33, 46, 63, 10))), counted(first == 10), kind[begin]
    words = counted(kind == _WORD)
    after = np.maximum.accumulate(np.concatenate([[0], np.where(kind == _BREAK, begin + 1, 0)]))[:-1]
    own = texts[text]
    columns = {
        "i": np.arange(len(begin)) - before[text] + 1, "kind": kind, "start": begin - own, "end": np.append(begin[1:], len(places))[: len(begin)] - own, "sent": ends[begin] - ends[own], "line": breaks[begin] - breaks[own],
        "pos": words[:-1] - words[before[text]], "column": begin - np.maximum(after, own),
    }
    offsets = np.append(places[begin], len(data)).astype(np.int32)
    return columns, pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data.tobytes())), before


def _lists(columns: dict[str, pa.Array], before: np.ndarray) -> Iterator[pa.Array]:
    """A list of rows for each text, as many texts at a time as have BLOCK rows."""
    at, n = 0, len(before) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(before, before[at] + BLOCK))))
        rows = pa.StructArray.from_arrays([pa.array(c).slice(before[at], before[to] - before[at]) for c in columns.values()], list(columns))
        yield pa.ListArray.from_arrays(pa.array(before[at : to + 1] - before[at], pa.int32()), rows)
        at = to


@F.arrow_udf(_PIECES)
def pieces_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pieces of each text, some texts at a time."""
    names = pa.array(["word", "other", "break"])
    for b in batches:
        for data, bounds in _texts(b):
            found, surface, before = _pieces(data, bounds)
            yield from _lists({n: surface if n == "surface" else names.take(pa.array(found[n])) if n == "kind" else pa.array(found[n]) for n in _FIELDS}, before)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, i, kind, start, end, sent, line, surface) of words, line breaks and what lies between."""
    return docs.select("doc_id", F.explode(pieces_of("text")).alias("p")).select("doc_id", "p.*")


_TOKEN = {"pos": T.LongType(), "surface": T.StringType(), "w": T.StringType(), "start": T.LongType(), "end": T.LongType(), "sent": T.LongType(), "line": T.LongType(), "column": T.LongType()}


def _words_of(least: int):
    """Arrow UDF: words of ``least`` letters or more of each text; others are counted, but never leave Python."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, kind) for n, kind in _TOKEN.items()])))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for data, bounds in _texts(b):
                pieces, surface, before = _pieces(data, bounds)
                hit = (pieces["kind"] == _WORD) & (pieces["end"] - pieces["start"] >= least)
                kept = np.flatnonzero(hit)
                surface = surface.take(pa.array(kept))
                strings = {"surface": surface, "w": pc.utf8_lower(surface)}
                yield from _lists({n: strings[n] if n in strings else pa.array(pieces[n][kept]) for n in _TOKEN}, np.concatenate([[0], np.cumsum(hit)])[before])

    return found


def tokens(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, pos, surface, w, start, end, sent, line, column): words of ``least`` letters or more, counted from 0 in each document among all words; w is lower case."""
    return docs.select("doc_id", F.explode(_words_of(least)("text")).alias("t")).select("doc_id", "t.*")


_PLACES = ("pos", "start", "end", "sent")
#: Words in a row, at most, that share their facts.
SHARED = 20_000


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some words in a row, SHARED at most, the different ones, as they're written and in lower case, and the places of all with the number of theirs."""
    for b in batches:
        at = 0
        for data, bounds in _texts(b.column(1)):
            pieces, surface, before = _pieces(data, bounds)
            kept = np.flatnonzero(pieces["kind"] == _WORD)
            text = np.searchsorted(before, kept, "right") - 1 + at
            at += len(bounds) - 1
            for k in range(0, len(kept), SHARED):
                own = kept[k : k + SHARED]
                coded = surface.take(pa.array(own)).dictionary_encode()
                columns = {"doc_id": b.column(0).take(pa.array(text[k : k + SHARED])), "v": coded.indices} | {n: pa.array(pieces[n][own]) for n in _PLACES}
                lists = [coded.dictionary, pc.utf8_lower(coded.dictionary), pa.StructArray.from_arrays(list(columns.values()), list(columns))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["surface", "w", "tokens"])


def explained(docs: DataFrame, facts: Column) -> DataFrame:
    """(doc_id, pos, start, end, sent, fact): words as in ``tokens``; ``facts`` makes an array from the columns ``surface`` and ``w``, arrays of different words, so that a fact is made once for thousands of words in a row.

    Facts are never null, else Spark infers a filter that makes them twice. What selects from these rows must be built-in functions without lambdas:
    it's one compiled step with the explosion then, else the facts of all words would be copied for each.
    """
    token = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("v", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in _PLACES]])
    found = T.StructType([T.StructField("surface", T.ArrayType(T.StringType())), T.StructField("w", T.ArrayType(T.StringType())), T.StructField("tokens", T.ArrayType(token))])
    rows = docs.select("doc_id", "text").mapInArrow(_vocabularies, found).select(F.coalesce(facts, F.array()).alias("facts"), "tokens").select("facts", F.explode("tokens").alias("t"))
    return rows.select("t.doc_id", *[f"t.{n}" for n in _PLACES], F.get("facts", F.col("t.v")).alias("fact"))


def words_in(text: Column) -> Column:
    """Array of (w, pos) of a text's words, in lower case and counted from 0: built-in functions only."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"([{WORD}]+)"), 1), lambda w, k: F.struct(F.lower(w).alias("w"), k.alias("pos")))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, w) for each word, without places: built-in functions only."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{WORD}]+)"), 1)).alias("w")).select("doc_id", F.lower("w").alias("w"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sentence), trimmed; blank ones are dropped."""
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit("([^.!?\n]+[.!?]*)"), 1), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(found).alias("n", "sentence")).select("doc_id", (F.col("n") + 1).cast("long").alias("sent_no"), "sentence")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para, n_lines, n_chars): runs of lines that aren't blank."""
    rows = lines(docs).withColumn("blank", F.trim("line") == "")
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("fresh", (~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))).cast("int"))
    rows = rows.withColumn("para", F.sum("fresh").over(w)).where(~F.col("blank"))
    return rows.groupBy("doc_id", F.col("para").cast("long").alias("para")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def context(docs: DataFrame, word: str, width: int) -> DataFrame:
    """(doc_id, at, shown): each place of ``word`` in each text, with what stands around it and the word in brackets."""
    pieces = F.split("text", "\\Q" + word + "\\E", -1)
    # places from the lengths of what lies between, in one fold
    places = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["next"] + F.length(p) + len(word)).alias("next"), F.concat(s["out"], F.array(s["next"] + F.length(p))).alias("out")), lambda s: s["out"])
    rows = docs.select("doc_id", "text", F.explode(places).alias("at"))
    begin = F.greatest(F.col("at") - width, F.lit(1))
    shown = F.concat(F.substring(F.col("text"), begin, F.col("at") - begin), F.lit("【" + word + "】"), F.substring(F.col("text"), F.col("at") + len(word), F.lit(width)))
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), shown.alias("shown"))
