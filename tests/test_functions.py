"""Scalar functions, the lattice, and EPUB files."""

import io
import itertools
import json
import random
import zipfile

from pyspark.sql import functions as F

from lexiflow.functions import scalars as S
from lexiflow.operators import lattice
from lexiflow.sources import epub


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_forms_and_readings(spark):
    assert one(spark, S.to_katakana(F.col("s")), s="ひらがなー") == "ヒラガナー"
    assert one(spark, S.form_identity(F.col("s")), s="カナ") == "かな" and one(spark, S.form_identity(F.col("s")), s="漢カ") == "漢カ"
    assert one(spark, S.morae(F.col("s")), s="キョウト") == ["キョ", "ウ", "ト"]


def test_kanji_readings(spark):
    pairs = lambda w, r: [tuple(x) for x in one(spark, S.kanji_readings(F.col("w"), F.col("r")), w=w, r=r)]
    assert pairs("山", "ヤマ") == [("山", "ヤマ")] and pairs("学校", "ガッコウ") == [("学", "ガッ"), ("校", "コウ")]
    assert pairs("東京", "トウキョウ") == [("東", "トウ"), ("京", "キョウ")] and pairs("今日", "キョウ") == [] and pairs("食べ", "タベ") == []


def test_text_helpers(spark):
    assert one(spark, S.slug(F.col("s")), s=" Héllo,  Wörld! ") == "héllo-wörld"
    assert one(spark, S.inline_spaces(F.col("s")), s="a  b 漢 字…") == "a b漢字..."
    assert one(spark, S.tags(F.col("s")), s=["#Ab", " ab", "", "##c", "x" * 30]) == ["Ab", "c", "x" * 24]
    assert one(spark, S.bound_template(F.lit("{{a}}-{{b}}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))) == "1-2"
    assert one(spark, S.bound_template(F.lit("{{a}}-{{c}}"), F.create_map(F.lit("a"), F.lit("1")))) is None
    assert one(spark, S.without_images(F.col("s")), s="a![x](y)b![z") == "ab![z"


def test_json(spark):
    assert one(spark, S.canonical_json(F.col("s")), s='{"b": 1, "a": [true]}') == '{"a":[true],"b":1}' and one(spark, S.canonical_json(F.col("s")), s="{") is None
    a, b = {"x/y": 1, "l": [{"id": 1, "v": 1}, {"id": 2}], "p": [1, 2]}, {"l": [{"id": 2}, {"id": 1, "v": True}], "p": [2, 1], "n": None}
    got = {r.path: (r.before, r.after) for r in one(spark, S.json_diff(F.col("a"), F.col("b")), a=json.dumps(a), b=json.dumps(b))}
    assert got == {"/x~1y": ("1", None), "/l/1/v": ("1", "true"), "/p": ("[1,2]", "[2,1]"), "/n": (None, "null")}
    assert [tuple(r) for r in one(spark, S.opcodes(F.col("a"), F.col("b")), a=["a", "b"], b=["a", "c"])] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2)]


def test_ruby(spark):
    given = "𠮷野家《よしのや》へ行《い》く《x》 山《"
    out = one(spark, S.prepared(F.col("s")), s=given)
    assert out.text == "𠮷野家へ行く《x》 山《"
    assert [(r.base, r.reading, r.start, r.end) for r in out.ruby] == [("𠮷野家", "よしのや", 0, 3), ("行", "い", 4, 5)]
    assert all(out.text[r.start : r.end] == r.base for r in out.ruby)


def test_lattice_equals_enumeration():
    r = random.Random(3)
    for _ in range(60):
        lexicon = [("".join(r.choice("ab") for _ in range(r.randint(1, 3))), r.randint(0, 2), r.randint(0, 2), r.randint(1, 60), f"f{k}") for k in range(8)]
        costs = {(x, y): r.randint(0, 30) for x in range(3) for y in range(3)}
        t = "".join(r.choice("abc") for _ in range(6))
        lat = lattice.Lattice(lexicon, costs)
        edges = lat.edges(t)

        def walk(b, edges=edges):
            if b == 0:
                yield []
            for e in edges[b]:
                for p in walk(e[0]):
                    yield [*p, e]

        want = sorted(sum(e[3] for e in p) + sum(costs[x, y] for x, y in zip([0, *(e[2] for e in p)], [*(e[1] for e in p), 0])) for p in walk(len(t)))
        got = lat.best(t, 10)
        assert [c for c, _ in got] == want[:10]
        assert all("".join(m[0] for m in ms) == t for _, ms in got)


def test_lattice_in_spark(spark):
    lex = spark.createDataFrame([("new", 1, 1, 10, "adj"), ("york", 1, 1, 10, "noun"), ("newyork", 1, 1, 5, "place")], "surface string, left int, right int, cost long, feature string")
    costs = spark.createDataFrame([(1, 1, 3)], "right int, left int, cost long")
    df = spark.createDataFrame([("newyork",), ("",), (None,)], "text string")
    rows = lattice.analysed(df, lex, costs, 2).collect()
    assert [[m.surface for m in p.morphemes] for p in rows[0].paths] == [["newyork"], ["new", "york"]] and rows[0].paths[1].cost == 23 and rows[1].paths == rows[2].paths == []


def book(nav: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        extra = '<item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>' if nav else '<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        z.writestr("O/p.opf", f'<package xmlns="urn:o" xmlns:dc="urn:dc"><metadata><dc:title>T</dc:title><dc:creator id="e">Ed</dc:creator><dc:creator id="a">Au</dc:creator><meta refines="#a" property="role">aut</meta><dc:language>en</dc:language></metadata><manifest>{extra}<item id="c0" href="cover.xhtml"/><item id="c1" href="a%20b.xhtml"/><item id="c2" href="gone.xhtml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="c0"/><itemref idref="c1"/><itemref idref="c2"/></spine></package>')
        z.writestr("O/nav.xhtml", '<html xmlns="urn:h"><body><nav><a href="a%20b.xhtml#x">One</a></nav></body></html>')
        z.writestr("O/toc.ncx", '<ncx xmlns="urn:n"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a%20b.xhtml"/></navPoint></navMap></ncx>')
        z.writestr("O/cover.xhtml", "<html><body><img src='i.png'/></body></html>")
        z.writestr("O/A b.xhtml", "<html><body><h2>Head</h2><p>Text &amp; more</p></body></html>")
        z.writestr("O/i.png", b"x")
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book(True))
    (tmp_path / "b.epub").write_bytes(book(False))
    (tmp_path / "c.epub").write_bytes(b"no zip")
    rows = epub.read(spark, str(tmp_path)).collect()
    for name in "ab":
        own = sorted((r for r in rows if r.path.endswith(f"{name}.epub")), key=lambda r: r.chapter_no)
        assert [(r.kind, r.chapter_title, r.text) for r in own] == [("illustration", "", ""), ("content", "One", "## Head\nText & more"), ("missing", "", "")]
        assert {(r.title, r.author, r.language, r.n_images) for r in own} == {("T", "Au", "en", 1)}
    assert [r.error.split(":")[0] for r in rows if r.path.endswith("c.epub")] == ["BadZipFile"]


def test_all_kinds_of_normal_forms(spark):
    assert one(spark, S.normalized_form(F.col("s")), s="Ａ・b‐ c") == "Abc"
    assert list(itertools.islice(S.HIRAGANA, 2)) == ["ぁ", "あ"]


def test_blocks_of_prepared_texts_are_bounded():
    import pyarrow as pa

    batch = pa.array(["一二《あい》x三《う》"] * 100_000 + [None])
    out = list(S.prepared.func(iter([batch])))
    assert sum(map(len, out)) == len(batch) and max(map(len, out)) <= S.PREPARED // 11 + 1
    assert out[0][0].as_py() == {"text": "一二x三", "ruby": [{"base": "一二", "reading": "あい", "start": 0, "end": 2}, {"base": "三", "reading": "う", "start": 3, "end": 4}]} and out[-1][-1].as_py() == {"text": "", "ruby": []}
