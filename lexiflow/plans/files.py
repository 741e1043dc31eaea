"""Queries of file formats: bundles, books and Markdown are made from the tables and read again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F

from lexiflow.operators import markdown
from lexiflow.plans.registry import query
from lexiflow.sources import bundles, epub

_ENTRIES = "e as (select p_brand as dict, p_name || ' ' || p_partkey as headword, case when p_partkey % 3 = 0 then p_type end as reading, case when p_partkey % 10 <> 7 then p_name || ' is ' || p_type end as definition, case when p_partkey % 10 = 7 then p_name || ' ' || (p_partkey - 1) end as target from part)"


def _entries(t):
    k = F.col("p_partkey")
    word = lambda n: F.concat("p_name", F.lit(" "), n.cast("string"))
    return t("part").select(F.col("p_brand").alias("dict"), word(k).alias("headword"), F.when(k % 3 == 0, F.col("p_type")).alias("reading"), F.when(k % 10 != 7, F.concat("p_name", F.lit(" is "), "p_type")).alias("definition"), F.when(k % 10 == 7, word(k - 1)).alias("target"))


@query(f"with {_ENTRIES} select dict, headword, case when target is null then reading end as reading, definition, target from e")
def bundle_round_trip(t):
    """SRC-13, SRC-16, SNK-4: bundles of each dictionary, written as bytes and opened again."""
    return bundles.opened(bundles.bundles(_entries(t), 4), ["dict"]).select("dict", "headword", "reading", "definition", "target")


@query(f"with {_ENTRIES} select dict, count(*) filter (target is null) as entries, count(*) filter (target is not null) as aliases from e group by 1")
def bundle_counts(t):
    """SNK-4: what the bundles' headers say."""
    return bundles.bundles(_entries(t), 3).groupBy("dict").agg(F.sum("entries").alias("entries"), F.sum("aliases").alias("aliases"))


def _book(doc_id: int | None, text: str | None) -> bytes:
    """An EPUB of one document: its lines as paragraphs, in two chapters."""
    lines = (text or "").split("\n")
    halves = [lines[: len(lines) // 2], lines[len(lines) // 2 :]]
    page = lambda own: "<html xmlns='http://www.w3.org/1999/xhtml'><body>" + "".join(f"<p>{escape(x)}</p>" for x in own) + "</body></html>"
    manifest = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in (0, 1)) + '<item id="i" href="i.png" media-type="image/png"/><item id="gone" href="gone.png" media-type="image/png"/>'
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {doc_id}</dc:title><dc:creator>Author {doc_id}</dc:creator></metadata><manifest>{manifest}</manifest><spine><itemref idref="c0"/><itemref idref="c1"/></spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/x.opf"/></rootfiles></container>'), ("o/x.opf", opf), ("o/c0.xhtml", page(halves[0])), ("o/c1.xhtml", page(halves[1])), ("o/i.png", "x" * ((doc_id or 0) % 50))):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _books(t):
    """(path, content) of an EPUB for each document."""

    @F.arrow_udf("binary")
    def made(ids: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in ids:
            yield pa.array([_book(i, x) for i, x in zip(a.to_pylist(), b.to_pylist())], pa.binary())

    return t("documents").select(F.col("doc_id").cast("string").alias("path"), made("doc_id", "text").alias("content"))


_LINE = "trim(regexp_replace(line, '[\\s\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g'))"


@query(f"""with l as (select doc_id, line_no, n, {_LINE} as line from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_no, len(l) as n from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
c as (select doc_id, case when line_no <= n // 2 then 1 else 2 end as chapter_no, string_agg(line, chr(10) order by line_no) filter (line <> '') as text from l group by 1, 2)
select cast(d.doc_id as varchar) as path, k::int as chapter_no, 'Book ' || d.doc_id as title, 'Author ' || d.doc_id as author, coalesce(c.text, '') as text, length(coalesce(c.text, ''))::int as n_chars, 1 as n_images from documents d cross join (values (1), (2)) v(k) left join c on c.doc_id = d.doc_id and c.chapter_no = k""")
def epub_chapters(t):
    """SRC-6 to SRC-10: EPUB files read as chapters."""
    return epub.chapters(_books(t)).select("path", "chapter_no", "title", "author", "text", "n_chars", "n_images")


@query("select cast(doc_id as varchar) as path, 'o/i.png' as name, doc_id % 50 as size, null as warning, doc_id % 50 as bytes from documents union all select cast(doc_id as varchar), 'o/gone.png', 0, 'missing', null from documents")
def epub_images(t):
    """SRC-11: images of EPUB files, within their budgets."""
    return epub.images(_books(t)).select("path", "name", "size", "warning", F.octet_length("content").cast("long").alias("bytes"))


@query("""with t as (select doc_id, string_split('---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# Title ' || doc_id || ' #' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '![alt](a.png)' || chr(10) || '## Contents' || chr(10) || '- [a](b)' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || 'end', chr(10)) as l from documents),
x as (select doc_id, i, line from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i, len(l) as n from t) where i > 3 and i not in (n - 5, n - 4, n - 3, n - 1) and trim(line, ' ' || chr(9)) <> ''),
b as (select doc_id, i, case when line = '![alt](a.png)' then 'image' when line = '# no heading' then 'code' when regexp_matches(line, '^#{1,6}\\s') then 'heading' else 'paragraph' end as kind, case when line = '![alt](a.png)' then 'alt' when line = '# no heading' then line when regexp_matches(line, '^#{1,6}\\s') then regexp_extract(line, '^#{1,6}\\s+(.*?)\\s*#*\\s*$', 1) else trim(line, ' ' || chr(9)) end as text, line from x)
select doc_id, row_number() over w as block_no, kind, cast(case when kind = 'heading' then length(regexp_extract(line, '^#+')) else 0 end as int) as level, cast(coalesce(sum(case when kind = 'image' then 0 else length(text) + 1 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as start, text from b window w as (partition by doc_id order by i)""")
def reader_document(t):
    """SRC-24, PRJ-30: blocks of Markdown with their places."""
    lines = [F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit(" #")), F.coalesce("text", F.lit(""))]
    text = F.concat_ws("\n", F.lit("---"), F.lit("title: x"), F.lit("---"), *lines, F.lit(""), F.lit("![alt](a.png)"), F.lit("## Contents"), F.lit("- [a](b)"), F.lit("```"), F.lit("# no heading"), F.lit("```"), F.lit("end"))
    return markdown.reader_document(t("documents").select("doc_id", text.alias("text"))).drop("src")


@query("""with b as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as block_no, l_returnflag in ('R', 'A') and l_linestatus = 'F' as page from lineitem), r as (select *, sum(fresh) over (partition by l_orderkey order by block_no) as run from (select *, case when lag(page) over (partition by l_orderkey order by block_no) = page then 0 else 1 end as fresh from b)),
k as (select *, row_number() over (partition by l_orderkey, run order by block_no) as k from r) select l_orderkey, block_no, cast(sum(case when not page or k % 2 = 1 then 1 else 0 end) over (partition by l_orderkey order by block_no) as bigint) as row_no from k""")
def reader_rows(t):
    """PRJ-29: two portrait images in a row."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    blocks = t("lineitem").select("l_orderkey", n.alias("block_no"), F.when(F.col("l_returnflag").isin("R", "A"), "image").otherwise("paragraph").alias("kind"), (F.col("l_linestatus") == "F").alias("portrait"))
    return markdown.reader_rows(blocks, ["l_orderkey"]).select("l_orderkey", "block_no", "row_no")
