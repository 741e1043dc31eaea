"""Pages: tag census, links, text, sanitising, and reader blocks."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG_NAME = r"<\s*/?\s*([a-zA-Z][A-Za-z0-9_:-]*)"
# fixed values: elements
BLOCKS = frozenset("address article aside blockquote body dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul br".split())
HIDDEN = frozenset("script style template noscript title".split())
ALLOWED = frozenset("a b blockquote br code div em h1 h2 h3 h4 h5 h6 i li ol p pre ruby rb rt rp span strong sub sup table tbody td th tr ul".split())
VOID = frozenset("br hr img input link meta".split())
#: Bytes of sanitised HTML at most.
LIMIT = 512 * 1024


def tag_census(pages: DataFrame) -> DataFrame:
    """(tag, n, pages): how often each tag is opened or closed, and on how many pages."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(TAG_NAME), 1)).alias("tag")).select("page_id", F.lower("tag").alias("tag"))
    by_page = tags.groupBy("tag", "page_id").agg(F.count("*").alias("k"))
    return by_page.groupBy("tag").agg(F.sum("k").alias("n"), F.count("*").alias("pages"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target, n): distinct link targets of each page and how often they occur."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count("*").alias("n"))


class Blocks(HTMLParser):
    """Kinds and texts of the page's blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.kind, self.parts, self.hidden = "body", [], 0

    def flush(self, kind: str) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.rows.append((self.kind, text))
        self.kind, self.parts = kind, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.flush(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.flush("body")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


class Cleaner(HTMLParser):
    """Allowed elements without attributes but for safe link targets; the rest keeps its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in ALLOWED and not self.hidden:
            href = next((v for k, v in attrs if k == "href" and v), None) if tag == "a" else None
            safe = href and re.match(r"(?i)(https?:|/|#|entry:)", href)
            self.out.append(f'<{tag} href="{entities.escape(href)}">' if safe else f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ALLOWED and tag not in VOID and not self.hidden:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(entities.escape(data, quote=False))


def _blocks(page: str | None) -> list[tuple[str, str]]:
    parser = Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush("body")
    return parser.rows


def _clean(page: str | None) -> str:
    parser = Cleaner()
    parser.feed(page or "")
    parser.close()
    return "".join(parser.out).encode()[:LIMIT].decode("utf-8", "ignore")


_BLOCK = T.ArrayType(T.StructType([T.StructField("block_no", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("text", T.StringType())]))


def _placed(page: str | None) -> list[dict]:
    at, out = 0, []
    for k, (kind, text) in enumerate(_blocks(page)):
        out.append({"block_no": k + 1, "kind": kind, "start": at, "text": text})
        at += len(text) + 1
    return out


@F.arrow_udf(_BLOCK)
def blocks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Visible blocks of each page and where they lie in the joined text."""
    kind = pa.list_(pa.struct([("block_no", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("text", pa.string())]))
    for b in batches:
        yield pa.array([_placed(x.as_py()) for x in b], kind)


@F.arrow_udf(T.StringType())
def sanitized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([_clean(x.as_py()) for x in b], pa.string())


def reader_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, kind, start, text): visible blocks with the place of their first code point in the joined text."""
    return pages.select("page_id", F.explode(blocks_of("html")).alias("p")).select("page_id", "p.*")


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): the blocks' texts, a line for each."""
    return pages.select("page_id", F.array_join(F.transform(blocks_of("html"), lambda b: b["text"]), "\n").alias("text"))


_ELEMENT = {"path": T.StringType(), "parent": T.StringType(), "name": T.StringType(), "classes": T.ArrayType(T.StringType()), "href": T.StringType(), "text": T.StringType()}
# fixed values: elements that end an open one of the same kind
CLOSING = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Tree(HTMLParser):
    """All elements of a page in document order, with their place in the tree and their visible text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.children = [0]

    def handle_starttag(self, tag, attrs):
        ends = CLOSING.get(tag, set())
        while self.open and self.open[-1]["name"] in ends:
            self.close_last()
        given = dict(attrs)
        parent = self.open[-1]["path"] if self.open else ""
        row = {"path": f"{parent}.{self.children[-1]}".lstrip("."), "parent": parent, "name": tag, "classes": (given.get("class") or "").split(), "href": given.get("href"), "text": []}
        self.children[-1] += 1
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)
            self.children.append(0)

    def close_last(self):
        self.open.pop()
        self.children.pop()

    def handle_endtag(self, tag):
        if any(r["name"] == tag for r in self.open):
            while self.open[-1]["name"] != tag:
                self.close_last()
            self.close_last()

    def handle_data(self, data):
        if not any(r["name"] in HIDDEN - {"title"} for r in self.open):
            for r in self.open:
                r["text"].append(data)


def _tree(page: str | None) -> list[dict]:
    parser = Tree()
    parser.feed(page or "")
    parser.close()
    for r in parser.rows:
        r["text"] = " ".join("".join(r["text"]).split())
    return parser.rows


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, kind) for n, kind in _ELEMENT.items()])))
def elements_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([(n, pa.list_(pa.string()) if n == "classes" else pa.string()) for n in _ELEMENT]))
    for b in batches:
        yield pa.array([_tree(x.as_py()) for x in b], kind)


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, n, path, parent, name, classes, href, text): a row for each element, in document order."""
    return pages.select("page_id", F.posexplode(elements_of("html")).alias("n", "e")).select("page_id", "n", "e.*")


def selected(selector: str):
    """A condition on element structs: ``name``, ``.class``, or ``name.class``."""
    name, _, cls = selector.partition(".")

    def test(e):
        out = F.lit(True)
        if name:
            out = out & (e["name"] == name)
        if cls:
            out = out & F.array_contains(e["classes"], cls)
        return out

    return test


def adapted(pages: DataFrame, config: dict[str, str]) -> DataFrame:
    """(page_id, header, senses, sections, links) by the selectors of ``config``: the first header, and the texts or targets of all others, each target once.

    One adapter for all kinds of pages; what a dictionary's pages look like is in the config.
    """
    rows = pages.select("page_id", elements_of("html").alias("e"))
    texts = lambda key: F.filter(F.transform(F.filter("e", selected(config[key])), lambda x: x["text"]), lambda x: x != "") if key in config else F.array().cast("array<string>")
    links = F.array_distinct(F.array_compact(F.transform(F.filter("e", selected(config.get("links", "a"))), lambda x: x["href"])))
    return rows.select("page_id", F.get(texts("header"), F.lit(0)).alias("header"), texts("senses").alias("senses"), texts("sections").alias("sections"), links.alias("links"))
