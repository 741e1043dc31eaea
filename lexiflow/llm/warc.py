"""WARC derivative builder.

From each response record come two records that refer to it: a metadata record
(application/warc-fields, with all of the source's WARC and HTTP headers,
repeated ones too, and what its page says) and a plain-text conversion record.
Both keep the response's target and date, name it in WARC-Refers-To, and carry
digests of their own; the metadata repeats the source's block and payload
digests. Ids are derived from the source's id, so a rerun gives the same records.

Records are parsed from bytes, gzipped by record or as a whole, or not at all;
gzip members are read piece by piece. Header names count without regard to
case. Of damaged files the sound records are kept: a record in which a member
breaks off, or before whose end it does, is left out, and reading goes on at
the next member. Transfer codings (chunked) and content codings (gzip,
deflate) of payloads are undone; payloads in other codings have an empty
conversion and say so in the metadata. Records of other types are skipped.

A null url gives records without a target, null or empty HTML an empty
conversion; long pages are converted whole. Pages get the same source id only
if id, url and HTML are the same, as repeated rows have; they give repeated
records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import table

VERSION = "WARC/1.1"
#: Date of responses whose table has none.
DATE = "2024-01-01T00:00:00Z"
DROPPED = re.compile(r"<!--(?:.*?-->|.*\Z)|<(script|style|noscript|template|svg)\b[^<>]*>(?:.*?</\1\s*>|.*\Z)", re.IGNORECASE | re.DOTALL)
BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.IGNORECASE)
TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
GZIP = b"\x1f\x8b\x08"
BEGIN = re.compile(rb"(?:\A|(?<=\n))WARC/\d")
#: Bytes that are decompressed at a time.
PIECE = 1 << 20


class Headers(list):
    """(name, value) pairs in their order; names are looked up without regard to case, and of repeated ones the first counts."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def __contains__(self, name: object) -> bool:
        return self.get(str(name)) is not None

    def __getitem__(self, name: str) -> str:  # type: ignore[override]
        found = self.get(name)
        if found is None:
            raise KeyError(name)
        return found


def headers_of(lines: list[str]) -> Headers:
    """Headers of lines; lines that begin with white space go on from the one before."""
    found: list[list[str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and found:
            found[-1][1] += " " + x.strip()
        elif ":" in x:
            found.append([y.strip() for y in x.split(":", 1)])
    return Headers((k, v) for k, v in found)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record's bytes; line ends within header values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(source: str, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record around a page."""
    payload = (page or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", source)}
    if url is not None:
        headers["WARC-Target-URI"] = url
    headers |= {"WARC-Date": date, "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response"}
    return record(headers, block)


def pieces(data: bytes) -> Iterator[bytes | None]:
    """The decompressed bytes, piece by piece; an empty piece where a gzip member ends, None where it breaks off. Data that isn't gzipped is one piece."""
    if data[:2] != GZIP[:2]:
        yield data
        return
    at = 0
    while 0 <= at < len(data):
        unzip = zlib.decompressobj(31)
        rest: bytes | memoryview = memoryview(data)[at:]
        try:
            while not unzip.eof:
                piece = unzip.decompress(rest, PIECE)
                rest = unzip.unconsumed_tail
                if piece:
                    yield piece
                elif not rest and not unzip.eof:
                    raise zlib.error("ends too early")
            yield b""
            at = len(data) - len(unzip.unused_data)
            if data[at : at + 2] != GZIP[:2]:
                at = data.find(GZIP, at)
        except zlib.error:
            yield None
            at = data.find(GZIP, at + 1)


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each sound record."""
    held: tuple[Headers, bytes] | None = None  # a record is sure when its member goes on or ends well
    buffer, need = bytearray(), 0
    source = pieces(data)
    while True:
        try:
            piece = next(source)
            ended = False
        except StopIteration:
            piece, ended = b"", True
        if piece is None:
            held, need = None, 0
            buffer.clear()
            continue
        if not piece and not ended and held:
            yield held
            held = None
        buffer += piece
        if len(buffer) < need and not ended:
            continue
        at = need = 0
        while start := BEGIN.search(buffer, at):
            end = buffer.find(b"\r\n\r\n", start.start())
            if end < 0:
                at = start.start()
                break
            headers = headers_of(buffer[start.start() : end].decode("utf-8", "replace").split("\r\n")[1:])
            length = headers.get("Content-Length", "")
            if not length.isdigit():
                at = end + 4
                continue
            stop = end + 4 + int(length)
            if stop > len(buffer):
                if not ended:
                    at, need = start.start(), stop - start.start()
                    break
                at = end + 4
                continue
            if held:
                yield held
            held = headers, bytes(buffer[end + 4 : stop])
            at = stop
        else:
            at = max(at, len(buffer) - 8)  # what may be the start of a record's first line
        del buffer[:at]
        if ended:
            break
    if held:
        yield held


def unchunked(payload: bytes) -> bytes:
    """A payload without its chunks; of a broken one what's there."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            return b"".join(out) if out else payload
        if n == 0:
            break
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def decoded(payload: bytes, codings: str) -> bytes | None:
    """A payload without its content codings, of a broken one what can be read; None for a coding that isn't known."""
    for coding in reversed([c.strip().lower() for c in codings.split(",") if c.strip()]):
        if coding in ("identity", "none"):
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None
        # deflate is found with and without a zlib header
        kinds = (31,) if coding != "deflate" else (15, -15)
        for kind in kinds:
            unzip, out = zlib.decompressobj(kind), b""
            try:
                out = unzip.decompress(payload)
                break
            except zlib.error:
                continue
        else:
            return b""
        payload = out
    return payload


def http_parts(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload as it was sent."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        return "", Headers(), block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], headers_of(lines[1:]), payload


def plain_text(page: str) -> str:
    """The page's text, a line for each block."""
    text = html.unescape(TAG.sub("", BLOCK.sub("\n", DROPPED.sub(" ", page))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def derive(headers: Headers, block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Metadata and conversion records of a response."""
    source = headers.get("WARC-Record-ID") or record_id("unnamed", digest(block))
    status, http, payload = http_parts(block)
    if "chunked" in (http.get("transfer-encoding") or "").lower():
        payload = unchunked(payload)
    content = decoded(payload, http.get("content-encoding") or "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", http.get("content-type") or "", re.IGNORECASE)
    try:
        page = (content or b"").decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = (content or b"").decode("utf-8", "replace")
    text = plain_text(page)
    ids = {k: record_id(k, source) for k in ("metadata", "conversion")}
    title = re.search(r"<title[^<>]*>([^<]*)", page, re.IGNORECASE)
    lang = re.search(r"<html[^<>]*\blang=[\"']?([\w-]+)", page, re.IGNORECASE)
    fields = [
        ("source-record-id", source),
        ("source-block-digest", headers.get("WARC-Block-Digest") or digest(block)),
        ("source-payload-digest", headers.get("WARC-Payload-Digest") or digest(payload)),
        ("source-status", status),
        *((f"source-{k.lower()}", v) for k, v in headers),
        *((f"source-http-{k.lower()}", v) for k, v in http),
        ("conversion-record-id", ids["conversion"]),
        ("title", " ".join(html.unescape(title[1]).split()) if title else ""),
        ("language", lang[1] if lang else ""),
        ("links", str(len(re.findall(r"<a\s[^<>]*\bhref=", page, re.IGNORECASE)))),
        ("text-characters", str(len(text))),
        *([("conversion", "content coding not known")] if content is None else []),
    ]
    blocks = {"metadata": "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace"), "conversion": text.encode("utf-8", "replace")}
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for k, b in blocks.items():
        own = {"WARC-Type": k, "WARC-Record-ID": ids[k], "WARC-Refers-To": source}
        if "WARC-Target-URI" in headers:
            own |= {"WARC-Target-URI": headers["WARC-Target-URI"], "WARC-Refers-To-Target-URI": headers["WARC-Target-URI"]}
        if "WARC-Date" in headers:
            own |= {"WARC-Date": headers["WARC-Date"], "WARC-Refers-To-Date": headers["WARC-Date"]}
        own |= {"WARC-Concurrent-To": ids["conversion" if k == "metadata" else "metadata"], "WARC-Block-Digest": digest(b), "WARC-Payload-Digest": digest(b), "Content-Type": kinds[k]}
        out.append((own, b))
    return out


COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "concurrent_to": "WARC-Concurrent-To", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}


def derivatives(responses: DataFrame, id_col: str, warc: str = "warc") -> DataFrame:
    """(id, the columns above, content_length, record) for each derived record of each response in the WARC bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                rows = [(i, h, x) for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for head, block in parse(data or b"") if (head.get("WARC-Type") or "").lower() == "response" for h, x in derive(head, block)]
                own = [pa.array([h.get(name) for _, h, _ in rows], pa.string()) for name in COLUMNS.values()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *own, pa.array([len(x) for _, _, x in rows], pa.int64()), pa.array([record(h, x) for _, h, x in rows], pa.binary())], [id_col, *COLUMNS, "content_length", "record"])

    schema = ", ".join([f"`{id_col}` long", *(f"{c} string" for c in COLUMNS), "content_length long", "record binary"])
    return responses.select(F.col(id_col).cast("long"), F.col(warc)).mapInArrow(run, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, warc): a response record for each page; its id comes from the page's id, url and HTML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                made = [response(f"{i}:{u}:{digest((p or '').encode('utf-8', 'replace'))}", u, p) for i, u, p in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], [id_col, "warc"])

    given = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url).cast("string"), F.col(page).cast("string"))
    return given.mapInArrow(run, f"`{id_col}` long, warc binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, warc) of WARC files, gzipped or not, for ``derivatives``; a file is one task's work, so files should be of the usual size."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").alias("warc"), F.xxhash64("path").alias("file_id"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derivatives(responses(table(spark, sf_dir, "pages")), "page_id")
