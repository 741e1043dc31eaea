"""Dictionary bundles: compact binary files of entries, and the readers of other dictionary formats.

A bundle is ``MAGIC``, the length of its header in four bytes, the header (JSON:
id, entries, aliases, blocks as [offset, size] from the end of the header, and
the record stream as one more), then compressed blocks of about ``BLOCK`` bytes
of definitions and the compressed record stream, a JSON line for each entry or
alias. A definition is found by its block, place and length; nothing else is
decompressed for it.

A dictionary is dealt over ``parts`` bundles by the hash of its headwords, so
that no task holds a whole dictionary, however large it is.
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.sources.shared import removed

MAGIC, BLOCK = b"LXDICT1\n", 1 << 20
ENTRY = "headword string, reading string, definition string, target string"
READ = f"{ENTRY}, bundle_id string, block int, place int, length int"


def packed(rows: list[tuple[str, str | None, str | None, str | None]]) -> bytes:
    """The bundle of (headword, reading, definition, target); its id is the digest of its content, whatever the order of the rows."""
    blocks, current, records = [], bytearray(), []
    for headword, reading, definition, target in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        if target is not None:
            records.append({"alias": headword, "target": target})
            continue
        body = (definition or "").encode()
        records.append({"headword": headword, "reading": reading, "block": len(blocks), "place": len(current), "length": len(body)})
        current += body
        if len(current) >= BLOCK:
            blocks.append(bytes(current))
            current = bytearray()
    if current or not blocks:
        blocks.append(bytes(current))
    stream = "\n".join(json.dumps(r, ensure_ascii=False, sort_keys=True) for r in records).encode()
    digest = hashlib.sha256(stream + b"".join(hashlib.sha256(b).digest() for b in blocks)).hexdigest()
    parts = [zlib.compress(b, 9) for b in [*blocks, stream]]
    places, at = [], 0
    for p in parts:
        places.append([at, len(p)])
        at += len(p)
    header = json.dumps({"id": digest, "entries": sum("headword" in r for r in records), "aliases": sum("alias" in r for r in records), "blocks": places[:-1], "records": places[-1]}).encode()
    return MAGIC + len(header).to_bytes(4, "big") + header + b"".join(parts)


class Bundle:
    """An opened bundle; raises ValueError for what isn't one."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a bundle")
        n = int.from_bytes(data[len(MAGIC) : len(MAGIC) + 4], "big")
        self.body = len(MAGIC) + 4 + n
        self.header = json.loads(data[len(MAGIC) + 4 : self.body])
        self.data = data

    def part(self, place: list[int]) -> bytes:
        try:
            return zlib.decompress(self.data[self.body + place[0] : self.body + sum(place)])
        except zlib.error as e:
            raise ValueError(f"damaged bundle: {e}") from e

    def records(self) -> list[dict]:
        return [json.loads(x) for x in self.part(self.header["records"]).decode().split("\n") if x]

    def definition(self, block: int, place: int, length: int) -> str:
        """One definition, by its place; only its block is decompressed."""
        return self.part(self.header["blocks"][block])[place : place + length].decode()


def bundles(entries: DataFrame, parts: int = 1) -> DataFrame:
    """(dict, part, bundle_id, entries, aliases, bundle) of (dict, headword, reading, definition, target)."""

    def pack(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("headword", "reading", "definition", "target"))))
        data = packed(rows)
        header = Bundle(data).header
        return pa.table({"dict": group.column("dict")[:1], "part": group.column("part")[:1], "bundle_id": pa.array([header["id"]]), "entries": pa.array([header["entries"]], pa.int64()), "aliases": pa.array([header["aliases"]], pa.int64()), "bundle": pa.array([data], pa.binary())})

    rows = entries.select("dict", "headword", "reading", "definition", "target", F.pmod(F.xxhash64("headword"), F.lit(parts)).cast("int").alias("part"))
    return rows.groupBy("dict", "part").applyInArrow(pack, "dict string, part int, bundle_id string, entries long, aliases long, bundle binary")


def opened(files: DataFrame, keep: list[str], content: str = "bundle") -> DataFrame:
    """``keep`` and READ for each record of each bundle; a file that is none, or is damaged, gives one row with nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for k in range(len(b)):
                row = b.slice(k, 1)
                data = row.column(names.index(content))[0].as_py()
                try:
                    bundle = Bundle(data or b"")
                    found: list[dict] = []
                    held: tuple[int, bytes] = (-1, b"")
                    for r in bundle.records():
                        if "alias" in r:
                            found.append({"headword": r["alias"], "target": r["target"], "bundle_id": bundle.header["id"]})
                            continue
                        if held[0] != r["block"]:
                            held = (r["block"], bundle.part(bundle.header["blocks"][r["block"]]))
                        found.append({"headword": r["headword"], "reading": r["reading"], "definition": held[1][r["place"] : r["place"] + r["length"]].decode(), "bundle_id": bundle.header["id"], "block": r["block"], "place": r["place"], "length": r["length"]})
                except (ValueError, KeyError, UnicodeDecodeError):
                    found = [{}]
                kinds = {"block": pa.int32(), "place": pa.int32(), "length": pa.int32()}
                columns = [pa.array([row.column(names.index(c))[0].as_py()] * len(found), row.schema.field(c).type) for c in keep]
                columns += [pa.array([f.get(c.split()[0]) for f in found], kinds.get(c.split()[0], pa.string())) for c in READ.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *(c.split()[0] for c in READ.split(", "))])

    given = files.select(*keep, content)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema), *READ.split(", ")])
    return given.mapInArrow(run, schema)


def refreshed(made: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write the bundles of ``made`` whose id isn't the stored one, and give their (dict, part); unchanged ones stay as they are.

    New files are written beside the old ones first, so that a failure leaves the old bundles whole.
    """
    spark = made.sparkSession
    ids = made.select("dict", "part", "bundle_id").collect()  # one row for each file
    try:
        old = {(r["dict"], r["part"]): r["bundle_id"] for r in spark.read.parquet(folder).select("dict", "part", "bundle_id").collect()}
    except Exception as e:  # noqa: BLE001  (nothing stored yet)
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = {}
    stale = [(r["dict"], r["part"]) for r in ids if old.get((r["dict"], r["part"])) != r["bundle_id"]]
    if stale:
        made.write.mode("overwrite").parquet(folder + ".new")
        spark.read.parquet(folder + ".new").write.mode("overwrite").parquet(folder)
        removed(spark, folder + ".new")
    return sorted(stale)


def tab_records(spark: SparkSession, path: str) -> DataFrame:
    """(headword, reading, definition, target) of lines ``headword<TAB>reading<TAB>definition``; two fields have no reading, and other lines aren't records."""
    parts = F.split("value", "\t", 3)
    rows = spark.read.text(path).where(F.size(parts) >= 2)
    return rows.select(parts[0].alias("headword"), F.when(F.size(parts) == 3, parts[1]).alias("reading"), F.element_at(parts, -1).alias("definition"), F.lit(None).cast("string").alias("target")).where("trim(headword) <> ''")


def sqlite_records(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY of SQLite files (through ``binaryFile``): from each file's table that has a headword (or word, key, title) and a definition (or content, value, paraphrase) column; a file without one gives nothing."""
    heads, bodies = ("headword", "word", "key", "title"), ("definition", "content", "value", "paraphrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # of this task alone; SQLite needs a file
                    f.write(data)
                    f.flush()
                    c = sqlite3.connect(f.name)
                    try:
                        for (name,) in c.execute("select name from sqlite_master where type = 'table' order by name").fetchall():
                            columns = [r[1].lower() for r in c.execute(f'pragma table_info("{name}")')]
                            head, body = next((x for x in heads if x in columns), None), next((x for x in bodies if x in columns), None)
                            if head and body:
                                reading = '"reading"' if "reading" in columns else "null"
                                rows = c.execute(f'select "{head}", {reading}, "{body}" from "{name}"').fetchall()
                                break
                    except sqlite3.DatabaseError:
                        rows = []
                    finally:
                        c.close()
                yield pa.RecordBatch.from_arrays([pa.array([None if r[k] is None else str(r[k]) for r in rows], pa.string()) for k in range(3)] + [pa.nulls(len(rows), pa.string())], ["headword", "reading", "definition", "target"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ENTRY)


def database(entries: DataFrame, folder: str, version: int) -> dict[str, int]:
    """Entries, aliases and keys of (dict, headword, reading, definition, target) as tables under ``folder``, and their counts, checked against what was given.

    Duplicate entries stay apart by their number in the dictionary.
    """
    spark = entries.sparkSession
    given = entries.groupBy().agg(F.count_if(F.col("target").isNull()).alias("e"), F.count_if(F.col("target").isNotNull()).alias("a")).first()
    real = entries.where("target is null").select("dict", "headword", "reading", "definition")
    real = real.withColumn("entry_id", F.sha2(F.concat_ws("\x01", "dict", "headword", F.coalesce("reading", F.lit("")), F.coalesce("definition", F.lit(""))), 256))
    real.write.mode("overwrite").partitionBy("dict").parquet(f"{folder}/entries")
    entries.where("target is not null").select("dict", F.col("headword").alias("alias"), "target").write.mode("overwrite").partitionBy("dict").parquet(f"{folder}/aliases")
    keys = real.select("dict", "entry_id", F.explode(F.array_compact(F.array(F.struct(F.lit("form").alias("kind"), F.col("headword").alias("value")), F.when(F.col("reading").isNotNull(), F.struct(F.lit("reading").alias("kind"), F.col("reading").alias("value")))))).alias("k"))
    keys.select("dict", "entry_id", "k.kind", "k.value").distinct().write.mode("overwrite").partitionBy("dict").parquet(f"{folder}/keys")
    counts = {"entries": _count(spark, f"{folder}/entries"), "aliases": _count(spark, f"{folder}/aliases")}
    if counts != {"entries": given["e"], "aliases": given["a"]}:
        raise ValueError(f"{counts} were written of {given}")
    spark.createDataFrame([(version, counts["entries"], counts["aliases"])], "version int, entries long, aliases long").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    return counts


def _count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as e:  # noqa: BLE001  (an empty partitioned table has no file)
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return 0
        raise


def databases(spark: SparkSession, folders: list[str], version: int) -> DataFrame:
    """(dict, entry_id, headword, reading, definition) of the databases of that version, in the order of their names; others are skipped."""
    out = spark.createDataFrame([], "headword string, reading string, definition string, entry_id string, dict string")
    for folder in sorted(folders):
        if spark.read.json(f"{folder}/meta").first()["version"] == version:
            out = out.unionByName(spark.read.parquet(f"{folder}/entries"))
    return out


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def report(rows: DataFrame, path: str) -> None:
    """Write a report as JSON lines, its columns in order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
