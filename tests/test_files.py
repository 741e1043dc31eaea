"""Files and folders: bundles, databases, caches, catalogues, histories; and the engine's façade."""

import glob
import json
import os
import sqlite3

import pytest

from lexiflow.engine import Engine
from lexiflow.operators import catalog, markdown, matching, quality
from lexiflow.sources import bundles, cache
from lexiflow.streaming import session

ENTRY = "dict string, headword string, reading string, definition string, target string"


def entries(spark, n=50, changed=()):
    rows = [(f"d{k % 2}", f"w{k}", None if k % 3 else "r", f"definition {k}{' new' if k in changed else ''} 字", None) for k in range(n)] + [("d0", "alias", None, None, "w0"), ("d0", "w0", None, "another one", None), ("d1", "empty", None, None, None)]
    return spark.createDataFrame(rows, ENTRY)


def test_bundle_blocks_are_read_one_by_one():
    rows = [(f"h{k}", None, "x" * 300_000 + str(k), None) for k in range(10)]
    b = bundles.Bundle(bundles.packed(rows))
    assert len(b.header["blocks"]) > 2 and b.header["entries"] == 10
    for r in b.records():
        assert b.definition(r["block"], r["place"], r["length"]).endswith(r["headword"][1:])
    assert bundles.packed(rows) == bundles.packed(rows[::-1])
    for bad in (b"", b"nothing", bundles.MAGIC + b"\0\0\0\2{}"):
        with pytest.raises((ValueError, KeyError)):
            bundles.Bundle(bad).records()


def test_bundles_are_rebuilt_only_if_they_changed(spark, tmp_path):
    folder = str(tmp_path / "b")
    assert len(bundles.refreshed(bundles.bundles(entries(spark), 2), folder)) == 4
    assert bundles.refreshed(bundles.bundles(entries(spark).orderBy("definition"), 2), folder) == []
    assert len(bundles.refreshed(bundles.bundles(entries(spark, changed=(4,)), 2), folder)) == 1
    found = bundles.opened(spark.read.parquet(folder), ["dict"])
    want = {tuple(r) for r in entries(spark, changed=(4,)).selectExpr("dict", "headword", "reading", "coalesce(definition, if(target is null, '', null))", "target").collect()}
    assert {(r["dict"], r.headword, r.reading, r.definition, r.target) for r in found.collect()} == want
    broken = spark.createDataFrame([("d", b"junk"), ("e", None)], "dict string, bundle binary")
    assert [(r["dict"], r.headword) for r in bundles.opened(broken, ["dict"]).collect()] == [("d", None), ("e", None)]


def test_database_counts_and_versions(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert bundles.database(entries(spark), a, 4) == {"entries": 52, "aliases": 1}
    assert bundles.database(entries(spark).where("target is null"), b, 3) == {"entries": 52, "aliases": 0}
    assert bundles.databases(spark, [b, a], 4).count() == 52 and bundles.databases(spark, [a, b], 9).count() == 0
    assert spark.read.parquet(f"{a}/keys").where("kind = 'reading'").count() == 17


def test_other_dictionary_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\tr\tdef a\nb\tdef b\nno record\n\tx\n")
    assert sorted((r.headword, r.reading, r.definition) for r in bundles.tab_records(spark, str(tmp_path / "t.txt")).collect()) == [("a", "r", "def a"), ("b", None, "def b")]
    (tmp_path / "s").mkdir()
    c = sqlite3.connect(tmp_path / "s" / "x.db")
    c.execute("create table other (n int)")
    c.execute("create table words (id int, word text, paraphrase text)")
    c.executemany("insert into words values (?, ?, ?)", [(1, "a", "A"), (2, "b", None)])
    c.commit()
    c.close()
    (tmp_path / "s" / "y.db").write_bytes(b"not a database at all")
    assert sorted((r.headword, r.definition) for r in bundles.sqlite_records(spark, str(tmp_path / "s")).collect()) == [("a", "A"), ("b", None)]


def test_texts_and_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (row,) = bundles.whole_text(spark, str(tmp_path / "a.txt")).collect()
    assert row.text == "one\ntwo\n" and row.path.endswith("a.txt")
    bundles.report(spark.createDataFrame([(2, None), (1, "x")], "n int, a string"), str(tmp_path / "r"))
    rows = [json.loads(x) for f in glob.glob(f"{tmp_path}/r/*.json") for x in open(f)]
    assert sorted(rows, key=lambda r: r["n"]) == [{"a": "x", "n": 1}, {"a": None, "n": 2}] and list(rows[0]) == ["a", "n"]


def test_damaged_cache_is_replaced(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5).toDF("n")

    folder = str(tmp_path)
    assert cache.cached(spark, folder, "text", "v1", compute, ["n"]).count() == 5 and len(calls) == 1
    assert cache.cached(spark, folder, "text", "v1", compute, ["n"]).count() == 5 and len(calls) == 1
    for f in glob.glob(f"{folder}/key=*/*.parquet"):
        with open(f, "r+b") as g:
            g.seek(0)
            g.write(b"broken" * 10)
            g.truncate(40)
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert cache.cached(spark, folder, "text", "v1", compute, ["n"]).count() == 5 and len(calls) == 2
    assert cache.cached(spark, folder, "text", "v1", compute, ["m"]).count() == 5 and len(calls) == 3, "other fields are asked for"
    cache.cached(spark, folder, "text", "v2", compute)
    assert len(cache.pruned(spark, folder, 1)) == 1 and len(glob.glob(f"{folder}/key=*")) == 1


def test_catalogue_is_compiled_once(spark, tmp_path):
    bundle = {"id": "b", "defaults": {"level": 2, "status": "verified"}, "concepts": [{"id": "c1", "label": "One", "senses": [{"id": "s1", "text": "first"}], "rules": [{"id": "r1", "priority": 5, "captures": ["head"], "template": "{{head}}", "examples": ["e"], "counter_examples": ["x"]}]}, {"id": "c2", "label": "Old", "senses": [{"id": "s2", "text": "t"}], "rules": []}], "redirects": [{"source": "c2", "target": "c1"}]}
    t = catalog.expanded(spark.createDataFrame([(json.dumps(bundle),)], "bundle string"))
    assert catalog.violations(t).collect() == []
    folder = str(tmp_path / "c")
    assert not catalog.compile_catalog(t, folder, check=True) and not catalog.compile_catalog(t, folder) and catalog.compile_catalog(t, folder) and catalog.compile_catalog(t, folder, check=True)
    assert [(r.rule_id, r.status) for r in spark.read.parquet(f"{folder}/rules").collect()] == [("r1", "accepted")]
    assert sorted(r.concept_id for r in catalog.search(catalog.search_index(t), "old").collect()) == ["c1", "c2"]


def test_history_of_complete_runs(spark, tmp_path):
    for name, files in (("a/run1", ("manifest.json", "summary.json")), ("b/c/run2", ("manifest.json", "summary.json")), ("run3", ("manifest.json",))):
        d = tmp_path / name
        d.mkdir(parents=True)
        for f in files:
            (d / f).write_text("{}")
    assert sorted(os.path.basename(r.path) for r in quality.completed_runs(spark, str(tmp_path)).collect()) == ["run1", "run2"]


def test_diff_bundle(spark, tmp_path):
    kind = "document long, stage string, key long, start long, end long, value string, status string"
    before = spark.createDataFrame([(1, "lines", 1, 0, 9, "a", "ok"), (1, "words", 2, 2, 5, "b", "ok"), (1, "words", 3, 20, 25, "c", "ok")], kind)
    after = spark.createDataFrame([(1, "lines", 1, 0, 9, "z", "ok"), (1, "words", 2, 2, 5, "y", "ok")], kind)
    needs = spark.createDataFrame([("words", "lines", 1)], "stage string, ancestor string, place int")
    caused = quality.causes(quality.changes(before, after, guarded=("words",)), needs)
    assert sorted((r.stage, r.key, r.operation, r.severity, r.causal_status, r.causes) for r in caused.collect()) == [("lines", 1, "modified", "medium", "root", None), ("words", 2, "modified", "medium", "propagated_candidate", [1]), ("words", 3, "removed", "high", "root", None)]
    stages = spark.createDataFrame([("lines", 1), ("words", 2)], "stage string, place int")
    summary = quality.stage_summary(stages, before, after, caused, spark.createDataFrame([("words",)], "stage string"))
    assert {r.stage: r.coverage for r in summary.collect()} == {"lines": "comparable", "words": "contract_mismatch"}
    quality.write_bundle(caused, summary, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d" / "manifest")).first().asDict() == {"changes": 3, "stages": 2}
    assert quality.conclusion(summary, ("source",)).first().asDict() == {"comparable": True, "conclusion": "partial"}


def test_markdown_blocks():
    found = markdown.compiled("# A #\n\ntext *x*\n![p](q.png \"t\")\n~~~\n# code\n```\n~~~\n## Table of contents\n1. [a](b)\nafter")
    assert [(b["kind"], b["text"], b["src"]) for b in found] == [("heading", "A", None), ("paragraph", "text *x*", None), ("image", "p", "q.png"), ("code", "# code\n```", None), ("paragraph", "after", None)]
    assert markdown.compiled(None) == markdown.compiled("") == [] and [b["kind"] for b in markdown.compiled("```\nopen")] == ["code"]


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("r", json.dumps({"atoms": [{"words": ["a"], "name": "x"}, {"least": 0, "most": 2}, {"words": ["b"]}], "skip": ["the"], "skipped": 1}))], "rule_id string, pattern string")
    docs = spark.createDataFrame([(1, "a the x y b. a. b"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.start_pos, r.width, r.surface) for r in matching.matches(docs, matching.rules_of(table)).collect()) == [(0, 5, "a the x y b")]
    with pytest.raises(ValueError):
        matching.Rule("bad", (matching.atom(None),))
    with pytest.MonkeyPatch.context() as m:
        grams = spark.createDataFrame([("a the",), ("the x",), ("a the x",)], "gram string")
        held = sorted(map(tuple, matching.windows(docs, grams, 3, claim=True).collect()))
        m.setattr(matching, "LIMIT", 3)
        assert sorted(map(tuple, matching.windows(docs, grams, 3, claim=True).collect())) == held == [(1, 0, "a the x")], "joined instead of carried"
        with pytest.raises(ValueError):
            matching.rules_of(table)


def test_session_laws(spark):
    """Batches tile the chunks that aren't done; patches turn the old rows into the new ones; a replay records nothing."""
    docs = spark.createDataFrame([(1, "\n".join(f"line {k} " + "x" * (k * 7 % 40) for k in range(40))), (2, ""), (3, None)], "doc_id long, text string")
    parts = session.chunks(docs, 2)
    rows = sorted((r.doc_id, r.batch, r.chunk) for r in session.batches(parts, 100).collect())
    sizes = {(r.doc_id, r.chunk): len(r.text or "") for r in parts.collect()}
    one = [b for d, b, _ in rows if d == 1]
    assert one == sorted(one) and sum(d == 1 for d, *_ in rows) == 20
    for b in range(max(one)):
        own = [sizes[d, c] for d, x, c in rows if d == 1 and x == b]
        assert sum(own) >= 100 > sum(own[:-1])
    flags = spark.createDataFrame([(2,)], "doc_id long")
    cover = session.coverage(parts, parts)
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, w string")
    first, after = session.recorded_once(cover, tokens, flags)
    again, _ = session.recorded_once(cover, tokens, after)
    assert [(r.w, r.n) for r in first.collect()] == [("a", 2)] and again.collect() == []
    session.run_group(spark, "g")
    session.cancel(spark, "g")


def test_engine_and_sql_functions(spark):
    engine = Engine(spark, [matching.Rule("ab", (matching.atom("a"), matching.atom("b")))])
    docs = spark.createDataFrame([(1, "A b c. a b")], "doc_id long, text string")
    found = engine.analyse(docs)
    assert found["tokens"].count() == 5 and found["expressions"].count() == 2
    assert engine.open(docs, 1, 10).select("batch").distinct().count() == 1
    assert [tuple(r) for r in spark.sql("select * from lex_words('One two. Three')").collect()] == [(0, 0, "one"), (1, 0, "two"), (2, 1, "three")]
    assert spark.sql("select lex_nfkc('ﬁ') as x, lex_canonical_json('{\"b\": 1, \"a\": 2}') as j").first() == ("fi", '{"a":2,"b":1}')


def test_snapshots_are_captured_by_content(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "n long, v string")
    a = quality.capture({"words": rows, "none": rows.where("false")}, str(tmp_path))
    assert quality.capture({"none": rows.where("false"), "words": rows.orderBy("v").repartition(3)}, str(tmp_path)) == a
    assert quality.capture({"words": rows.where("n > 0"), "none": rows.where("false")}, str(tmp_path)) != a
    assert spark.read.parquet(f"{tmp_path}/run_id={a}/stage=words").count() == 20 and len(os.listdir(tmp_path)) == 2
    runs = spark.createDataFrame([("p/1", '{"run_id": "a"}', '{"changes": 3, "status": "changed"}'), ("p/2", '{"run_id": "b"}', "{}"), ("p/3", "{}", "broken")], "path string, manifest string, summary string")
    assert [tuple(r) for r in quality.history_index(runs).orderBy("place").collect()] == [(1, "p/2", "b", None, None), (2, "p/1", "a", 3, "changed"), (3, "p/3", None, None, None)]


def test_lines_are_aligned(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "k long, lines array<string>")
    b = spark.createDataFrame([(1, ["a", "B", "c", "d"]), (3, ["y", "z"])], "k long, lines array<string>")
    found = sorted(tuple(r) for r in quality.aligned_lines(a, b, "k").collect())
    assert found == [(1, "equal", 0, 1, 0, 1), (1, "equal", 2, 3, 2, 3), (1, "insert", 3, 3, 3, 4), (1, "replace", 1, 2, 1, 2), (2, "delete", 0, 1, 0, 0), (3, "insert", 0, 0, 0, 2)]


def test_elements_and_selectors(spark):
    from lexiflow.operators import html

    page = '<div class="a b"><p>one<p>two<ul><li>x<li>y <b>z</b></ul></div><script>no</script><img src="q"><a href="/l">t</a><a href="/l">u</a></span>'
    rows = html.elements(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("n").collect()
    assert [(r.path, r.name, r.text) for r in rows][:4] == [("0", "div", "onetwoxy z"), ("0.0", "p", "one"), ("0.1", "p", "twoxy z"), ("0.1.0", "ul", "xy z")]
    assert [r.path for r in rows if r.name == "li"] == ["0.1.0.0", "0.1.0.1"] and [r.text for r in rows if r.name == "script"] == [""]
    (x,) = html.adapted(spark.createDataFrame([(1, page)], "page_id long, html string"), {"header": "p", "senses": "li", "sections": ".b"}).collect()
    assert (x.header, x.senses, x.sections, x.links) == ("one", ["x", "y z"], ["onetwoxy z"], ["/l"])


def test_profile_tables(spark, tmp_path):
    from lexiflow.sources import profile

    folder = str(tmp_path)
    assert all(profile.read(spark, folder, n).count() == 0 for n in profile.TABLES)
    profile.write(spark.createDataFrame([("d", 1)], profile.TABLES["dictionary_order"]), folder, "dictionary_order")
    more = profile.read(spark, folder, "dictionary_order").union(spark.createDataFrame([("e", 2)], profile.TABLES["dictionary_order"]))
    profile.write(more, folder, "dictionary_order")
    assert profile.read(spark, folder, "dictionary_order").count() == 2
    spark.range(1).write.parquet(f"{folder}/rules")
    with pytest.raises(ValueError):
        profile.read(spark, folder, "rules")


def test_readings_and_compatible_aliases(spark):
    """Inflected readings, kana queries, and aliases that count only where nothing else does."""
    from lexiflow.functions import scalars
    from lexiflow.operators import lookup
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("書く", "カキ"), ("書く", "カク"), ("食べる", "タベ"), ("本", "ホン"), ("読む", "ヨン")], "h string, r string")
    assert [r.c for r in rows.select(lookup.reading_candidates(F.col("h"), F.col("r")).alias("c")).collect()] == [["カキ", "カク"], ["カク"], ["タベ", "タベル"], ["ホン"], ["ヨン", "ヨム"]]
    entries = spark.createDataFrame([("d", "e1", 1, "ださい", "ダサイ", "word", ["形"], ["ださい"], True), ("d", "e2", 2, "書く", "カク", "word", ["動五"], ["書く"], True)], "dict string, entry_id string, record_index int, headword string, reading string, kind string, labels array<string>, forms array<string>, content boolean")
    keys = spark.createDataFrame([("d", "e1", "form", "ださい", 0), ("d", "e1", "reading", "ダサイ", 0), ("d", "e2", "form", "書く", 0), ("d", "e2", "reading", "カク", 0)], "dict string, entry_id string, kind string, value string, rank int")
    queries = spark.createDataFrame([(1, "だっせえ", None, None, None), (2, "かく", None, "動詞", None), (3, "ない", None, None, None), (4, "", None, None, None), (5, None, None, None, None), (6, "だ さ い", None, None, None)], "query_id long, headword string, reading string, pos string, observed string")
    none = spark.createDataFrame([], "dict string, alias string, target string")
    old = spark.createDataFrame([("だっせえ", "ださい"), ("かく", "ださい")], "alias string, target string")
    found = {(r.query_id, r.entry_id): r.match_type for r in lookup.discovered(queries, entries, keys, none, old).collect()}
    assert found == {(1, "e1"): "compatibility_alias", (2, "e2"): "reading_fallback", (6, "e1"): "exact_form"}
    words = spark.createDataFrame([("漢",), ("々",), ("かナ",), ("カー・",), ("a",), ("ㇰ",)], "w string")
    rules = [[getattr(scalars, f)(F.col("w")).alias(f) for f in ("is_han", "has_kanji", "is_kana", "is_kana_form", "is_kana_query")]]
    assert [tuple(r) for r in words.select(*rules[0]).collect()] == [(True, True, False, False, False), (False, True, False, False, False), (False, False, True, True, True), (False, False, True, True, True), (False, False, False, False, False), (False, False, False, True, False)]


def test_rules_of_one_place_in_the_order_keep_it(spark):
    from lexiflow.operators import catalog

    frame = spark.createDataFrame
    concepts = frame([("c1", "x", "verified"), ("c2", "y", "verified")], "concept_id string, label string, status string")
    senses, redirects = frame([("c1", "text")], "concept_id string, text string"), frame([("c2", "c1")], "source string, target string")
    for way in (1, -1):
        rules = frame([("r1", "c1", 5, "pending"), ("r1", "c2", 5, "verified")][::way], "rule_id string, concept_id string, priority int, status string").coalesce(1)
        rows = catalog.published({"concepts": concepts, "senses": senses, "rules": rules, "redirects": redirects}, ("rule_id", "concept_id", "label")).collect()
        assert sorted((r.place, r.status) for r in rows) == [(1, "accepted"), (2, "pending")]


def test_compiled_rules_that_tie_are_in_the_order_of_the_sql(spark, tmp_path):
    import pandas as pd
    from compare import connect, differences

    from lexiflow.plans import catalogue

    # every 1010th rule has the id of the one before, to whose concept its own redirects; DuckDB gives such rows the moved one first in tables as large as this
    n = 12_000
    pd.DataFrame({"p_partkey": range(n), "p_name": "ring", "p_brand": [f"b{k % 5}" for k in range(n)], "p_type": "T", "p_size": 7}).to_parquet(f"{tmp_path}/part.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view part as select * from read_parquet('{tmp_path}/part.parquet')")
    assert differences(spark, catalogue.QUERIES["catalog_compiled"], catalogue.ORACLES["catalog_compiled"], str(tmp_path), con) == ""
