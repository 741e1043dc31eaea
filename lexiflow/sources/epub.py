"""EPUB files as rows: metadata, chapters in reading order, images.

Each file is one task's work; chapters come out as rows. Damaged files give one
row with an error and no chapter.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexiflow.operators.html import _blocks

#: Bytes of one image, and of all images of a book, at most.
IMAGE, IMAGES = 32 << 20, 256 << 20
SCHEMA = "path string, book_id string, title string, author string, language string, chapter_no int, href string, chapter_title string, kind string, n_chars int, text string, n_images int, error string"


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(root, name: str) -> list:
    return [e for e in root.iter() if _local(e) == name]


class Book:
    """One opened book."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = {n.lower(): n for n in self.zip.namelist()}
        opf = self._package_path()
        self.base = posixpath.dirname(opf)
        self.root = ElementTree.fromstring(self.read(opf))
        self.items = {e.get("id"): e for e in _all(self.root, "item")}

    def read(self, name: str) -> bytes:
        found = self.names.get(posixpath.normpath(unquote(name)).lower())
        if found is None:
            raise KeyError(name)
        return self.zip.read(found)

    def _package_path(self) -> str:
        try:
            return next(e.get("full-path") for e in _all(ElementTree.fromstring(self.read("META-INF/container.xml")), "rootfile"))
        except (KeyError, StopIteration, ElementTree.ParseError):
            return min(n for n in self.names.values() if n.lower().endswith(".opf"))

    def meta(self, name: str) -> str:
        return next((" ".join("".join(e.itertext()).split()) for e in _all(self.root, name)), "")

    def author(self) -> str:
        """The creator whose role is ``aut``, else the first one."""
        creators = _all(self.root, "creator")
        roles = {(e.get("refines") or "").lstrip("#"): "".join(e.itertext()).strip() for e in _all(self.root, "meta") if e.get("property") == "role"}
        for e in creators:
            role = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "role"), roles.get(e.get("id")))
            if role == "aut":
                return "".join(e.itertext()).strip()
        return "".join(creators[0].itertext()).strip() if creators else ""

    def titles(self) -> dict[str, str]:
        """path -> title, from the navigation document, else from the NCX."""
        nav = next((e for e in self.items.values() if "nav" in (e.get("properties") or "").split()), None)
        ncx = next((e for e in self.items.values() if e.get("media-type") == "application/x-dtbncx+xml"), None)
        out: dict[str, str] = {}
        for item in (nav, ncx):
            if item is None or out:
                continue
            folder = posixpath.dirname(posixpath.join(self.base, item.get("href")))
            try:
                root = ElementTree.fromstring(self.read(posixpath.join(self.base, item.get("href"))))
            except (KeyError, ElementTree.ParseError):
                continue
            for e in _all(root, "a"):
                if item is nav and e.get("href"):
                    out.setdefault(posixpath.normpath(posixpath.join(folder, unquote(e.get("href").split("#")[0]))), " ".join("".join(e.itertext()).split()))
            for e in _all(root, "navPoint"):
                src = next((c.get("src") for c in _all(e, "content")), None)
                if src:
                    out.setdefault(posixpath.normpath(posixpath.join(folder, unquote(src.split("#")[0]))), " ".join("".join(next(iter(_all(e, "text"))).itertext()).split()))
        return out

    def spine(self) -> list[str]:
        return [posixpath.normpath(posixpath.join(self.base, unquote(self.items[r.get("idref")].get("href")))) for r in _all(self.root, "itemref") if r.get("idref") in self.items]

    def images(self) -> list[tuple[str, str, int, str | None]]:
        """(name, media type, size, warning) in the order of the manifest; what is missing or over a budget has a warning and isn't taken."""
        total, out = 0, []
        for e in self.items.values():
            if (e.get("media-type") or "").startswith("image/"):
                href = posixpath.normpath(posixpath.join(self.base, unquote(e.get("href") or "")))
                name = self.names.get(href.lower())
                size = self.zip.getinfo(name).file_size if name else 0
                warning = "missing" if not name else "image too large" if size > IMAGE else "images too large" if total + size > IMAGES else None
                total += 0 if warning else size
                out.append((href, e.get("media-type"), size, warning))
        return out


def kind_of(href: str, title: str, text: str, page: str) -> str:
    """Cover, toc, notice, titlepage, backmatter, illustration, blank or content: by names where the text is short, then by what the page is made of."""
    name = f"{posixpath.basename(href)} {title}".lower()
    images, links = len(re.findall(r"<(?:img|image|svg)\b", page, re.IGNORECASE)), len(re.findall(r"<a\b", page, re.IGNORECASE))
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return "illustration" if images else "blank"
    for kind, words in (("cover", "cover"), ("toc", r"toc|contents|nav\b"), ("notice", "copyright|colophon|notice"), ("titlepage", "title-?page"), ("backmatter", "afterword|appendix|about the author|backmatter")):
        if re.search(words, name) and len(text) < 4000:
            return kind
    if links >= 5 and links >= 0.8 * len(lines):
        return "toc"
    if images and len(text) < 40 * images:
        return "illustration"
    return "content"


def rows_of(path: str, data: bytes) -> list[tuple]:
    try:
        book = Book(data)
        head = (path, hashlib.sha256(data).hexdigest()[:32], book.meta("title"), book.author(), book.meta("language"))
        titles, images, out = book.titles(), sum(w is None for *_, w in book.images()), []
        for k, href in enumerate(book.spine()):
            try:
                page = book.read(href).decode("utf-8", "replace")
            except KeyError:
                out.append((*head, k + 1, href, "", "missing", 0, "", images, f"missing: {href}"))
                continue
            lines = [t if not re.fullmatch("h[1-6]", kind) else "#" * int(kind[1]) + " " + t for kind, t in _blocks(page)]
            text, title = "\n".join(lines), titles.get(href, "")
            out.append((*head, k + 1, href, title, kind_of(href, title, text, page), len(text), text, images, None))
        return out
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError) as e:
        return [(path, hashlib.sha256(data).hexdigest()[:32], None, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the EPUB files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA for the EPUB files of a folder."""
    return chapters(files(spark, path))


def chapters(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for EPUB files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()] + [pa.string()] * 3 + [pa.int32(), pa.string(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = rows_of(p, data)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


IMAGE_ROWS = "path string, name string, media_type string, size long, warning string, content binary"


def images(files: DataFrame) -> DataFrame:
    """IMAGE_ROWS of all images of EPUB files (path, content); those with a warning have no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in IMAGE_ROWS.split(", ")]
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    book = Book(data)
                    rows = [(p, n, m, size, w, None if w else book.read(n)) for n, m, size, w in book.images()]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError):
                    rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, IMAGE_ROWS)
