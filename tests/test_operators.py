"""Operators against brute force on small cases."""

import random
import re
from itertools import combinations

import pytest

from lexiflow.operators import dictionary, grammar, html, intervals, patterns, snapshots, text
from lexiflow.sources import cache, tables
from lexiflow.streaming import session


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_segments_tile_the_text(spark):
    given = ["", "a\r\nb", "𠮷 one.Two\n\n", "x", None]
    rows = text.segments(docs(spark, *given)).collect()
    for k, t in enumerate(given):
        own = sorted((r.i, r.start, r.end, r.surface) for r in rows if r.doc_id == k)
        assert "".join(r[3] for r in own) == (t or "")
        assert all((t or "")[a:b] == s for _, a, b, s in own)


def test_tokens_have_places_sentences_and_lines(spark):
    rows = text.tokens(docs(spark, "One two. Three\nfour")).orderBy("pos").collect()
    assert [(r.w, r.pos, r.sent, r.line) for r in rows] == [("one", 0, 0, 0), ("two", 1, 0, 0), ("three", 2, 1, 0), ("four", 3, 2, 1)]


def test_chapter(spark):
    d = docs(spark, "x\n## A\none\ntwo\n## B\nthree")
    assert [r.line for r in tables.chapter(d, "A").orderBy("line_no").collect()] == ["one", "two"]


def test_dictionary_records(spark, tmp_path):
    (tmp_path / "d.txt").write_text("head\tread\nmeaning\nmore\n</>\nalias\n@@@LINK=head\n</>\n")
    rows = {r.headword: r for r in tables.dictionary_records(spark, str(tmp_path / "d.txt")).collect()}
    assert rows["head"].reading == "read" and rows["head"].definition == "meaning\nmore" and rows["alias"].target == "head"


def test_repeats_and_optional_atoms(spark):
    d = text.tokens(docs(spark, "a a b. a. b a"))
    found = {(r.start_pos, r.width) for r in patterns.contiguous(d, {"r": [patterns.atom("a", 1, 2), patterns.atom("b", 0, 1)]}).collect()}
    assert found == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (3, 1), (5, 1)}
    with pytest.raises(ValueError):
        patterns.variants([patterns.atom(None)])
    with pytest.raises(ValueError):
        patterns.atom("a", 2, 1)


def test_gap_ends_at_sentences(spark):
    d = text.tokens(docs(spark, "a x b b. a. b"))
    assert [(r.head_pos, r.tail_pos) for r in patterns.nearest_gap(d, "a", "b", 1, 2).collect()] == [(0, 2)]


def brute_weighted(rows):
    best = (0, [], [])
    for n in range(len(rows) + 1):
        for c in combinations(range(len(rows)), n):
            if all(rows[a][1] <= rows[b][0] or rows[b][1] <= rows[a][0] for a, b in combinations(c, 2)):
                v = sum(100 * rows[k][2] + 10 * (rows[k][1] - rows[k][0]) for k in c)
                best = max(best, (v, [], list(c)), key=lambda x: x[0])
    return best[0]


def test_weighted_and_greedy_on_random_cases():
    r = random.Random(3)
    for _ in range(200):
        rows = []
        for k in range(r.randint(0, 8)):
            a = r.randint(0, 12)
            rows.append((a, a + r.randint(1, 5), r.randint(0, 3), f"r{k}"))
        picked = intervals.weighted(rows)
        assert sum(100 * rows[k][2] + 10 * (rows[k][1] - rows[k][0]) for k in picked) == brute_weighted(rows)
        taken = list(intervals.greedy(rows))
        for group in (picked, taken):
            assert all(rows[a][1] <= rows[b][0] or rows[b][1] <= rows[a][0] for a, b in combinations(group, 2))


def test_range_operators_on_random_cases(spark):
    r = random.Random(5)
    rows = [(g, (a := r.randint(0, 30)), a + r.randint(1, 8), k) for g in range(6) for k in range(r.randint(1, 8))]
    df = spark.createDataFrame(rows, "g int, start int, `end` int, id int")
    kept = {(x.g, x.id) for x in intervals.not_contained(df, ["g"]).collect()}
    flags = {(x.g, x.id): x.overlaps for x in intervals.overlap_flags(df, ["g"]).collect()}
    merged = {(x.g, x.start, x.end) for x in intervals.merged(df, ["g"]).collect()}
    for g, a, b, k in rows:
        others = [x for x in rows if x[0] == g and x[3] != k]
        assert ((g, k) in kept) == (not any(x[1] <= a and x[2] >= b and (x[1] < a or x[2] > b or x[3] < k) for x in others))
        assert flags[g, k] == any(x[1] < b and x[2] > a for x in others)
        assert sum(m[0] == g and m[1] <= a and b <= m[2] for m in merged) == 1


def test_best_path_prefers_entries(spark):
    d = text.tokens(docs(spark, "new york city"))
    known = spark.createDataFrame([("new york",)], "gram string")
    row = intervals.best_path(d, 2, known).first()
    assert (row.n_spans, row.score, row.spans) == (2, 40, "2,3")


def test_cascade(spark):
    q = spark.createDataFrame([("été",), ("ete",), ("abcdefg",), ("zz",)], "w string")
    e = spark.createDataFrame([("ete",), ("abcdexx",)], "w string")
    assert {r.w: (r.stage, r.target) for r in dictionary.cascade(q, e).collect()} == {"été": (2, "ete"), "ete": (1, "ete"), "abcdefg": (3, "abcdexx"), "zz": (4, None)}


def test_wilson_of_nothing_and_all(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0)], "k double, n double")
    low, high = snapshots.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("l"), high.alias("h")).collect()
    assert tuple(rows[0]) == (0.0, 0.0) and rows[1].h == 1.0 and 0.56 < rows[1].l < 0.57


def test_diff_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert {r.k: (r.operation, r.changed) for r in snapshots.diff(a, b, "k", ["v"]).collect()} == {1: ("stable", ""), 2: ("modified", "v"), 3: ("removed", ""), 4: ("added", "")}


def test_html_traps(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><p>One<b>two</b><p>Three &amp; four<br><a href="javascript:x" onclick="y">go</a></body></html>'
    d = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert {r.page_id: r.text for r in html.page_text(d).collect()} == {1: "Onetwo\nThree & four\ngo", 2: "", 3: ""}
    clean = {r.page_id: r.c for r in d.select("page_id", html.sanitized("html").alias("c")).collect()}
    assert clean[1] == "<p>One<b>two</b><p>Three &amp; four<br><a>go</a>" and clean[2] == ""
    rows = html.reader_blocks(d).orderBy("block_no").collect()
    assert [(r.block_no, r.start, r.text) for r in rows] == [(1, 0, "Onetwo"), (2, 7, "Three & four"), (3, 20, "go")]


def test_progressive_equals_full(spark):
    d = docs(spark, "a b\n\nc 𠮷 d\ne", "", "x\ny\nz\nw v")
    full = sorted((r.doc_id, r.start, r.end, r.w) for r in text.tokens(d).collect())
    for size in (1, 2, 5):
        assert sorted((r.doc_id, r.start, r.end, r.w) for r in session.progressive(session.chunks(d, size), 3).collect()) == full


def test_stream_replays_and_duplicates(spark, tmp_path):
    d = docs(spark, "a b\nc d\ne", "x\ny")
    parts = session.chunks(d, 1)
    for k in range(2):
        parts.where(f"chunk % 2 = {1 - k}").write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(parts.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    session.stream(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.start, r.w) for r in found.collect()) == sorted((r.doc_id, r.start, r.w) for r in text.tokens(d).collect())


def test_refinement_is_sequential():
    row = lambda c, p, r=None, g=None, s=0, e=5: {"concept": c, "priority": p, "refines": r, "conflict_group": g, "start": s, "end": e, "status": "accepted"}
    assert grammar.refine([row("a", 3, "b"), row("b", 2, "c"), row("c", 1)]) == ["accepted", "rejected", "accepted"]
    assert grammar.refine([row("a", 3, g="x"), row("b", 2, g="x"), row("c", 1, g="x", s=7, e=9)]) == ["accepted", "pending", "accepted"]


def test_pairing_uses_each_side_once():
    side = lambda *f: [{"key": k, "fields": x} for k, x in enumerate(f)]
    assert grammar.pair(side("ab", "aa"), side("aa", "ab", "cc")) == [(0, 1, 0), (1, 0, 0)]
    assert grammar.pair(side("ab"), []) == []


def test_explanations_fall_back(spark):
    o = spark.createDataFrame([(1, "c", "s", "own"), (2, "c", "s", None), (3, "c", None, None), (4, "z", None, None)], "id int, concept string, sense string, explicit string")
    s, c = spark.createDataFrame([("s", "S")], "sense string, explanation string"), spark.createDataFrame([("c", "C")], "concept string, explanation string")
    assert {r.id: r.explanation for r in grammar.explained(o, s, c).collect()} == {1: "own", 2: "S", 3: "C", 4: None}


def test_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "text", "v1", compute).count() == 3
    assert len(calls) == 1 and cache.cached(spark, str(tmp_path), "text", "v2", compute).count() == 3 and len(calls) == 2


def test_interning_of_many_partitions(spark, tmp_path):
    """Codes are the ranks whatever the number of partitions, written out or not."""
    from lexiflow.operators import dictionary

    words = spark.range(20_000).selectExpr("concat('w', hex(xxhash64(id))) as w", "id as n")
    want = {w: k + 1 for k, w in enumerate(sorted(r.w for r in words.collect()))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            dictionary.interned(words, "w", "code").write.parquet(f"{tmp_path}/{n}")
            assert {r.w: r.code for r in spark.read.parquet(f"{tmp_path}/{n}").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_closure_of_long_chains_and_cycles(spark):
    from lexiflow.operators import snapshots

    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 102), (102, 100), (5, None)], "child long, parent long")
    rows = {(r.child, r.ancestor): r.distance for r in snapshots.closure(edges).collect()}
    want = {(a, b): b - a for a in range(51) for b in range(a + 1, 51)} | {(100 + a, 100 + (a + d) % 3): d for a in range(3) for d in (1, 2, 3)}
    assert rows == want
    assert snapshots.closure(edges.where("false")).collect() == []


def test_blocks_of_pieces_and_tokens_are_bounded():
    import pyarrow as pa

    batch = pa.array(["One two. Three\nfour"] * 10_000 + [None, ""])
    for f, each in ((text.pieces_of, 7), (text._words_of(1), 4)):
        sizes = [(len(x), len(x.flatten())) for x in f.func(iter([batch, batch[:0], batch]))]
        assert sum(n for n, _ in sizes) == 2 * len(batch) and sum(k for _, k in sizes) == 2 * 10_000 * each
        assert max(k for _, k in sizes) < text.BLOCK + 9


def test_best_path_of_many_sentences_with_a_set_and_with_a_join(spark, monkeypatch):
    d = text.tokens(docs(spark, *["a b c. b c a b. " * 40 + "x" * (k % 3) for k in range(30)]))
    known = spark.createDataFrame([("a b",), ("b c",), ("c a b",)], "gram string")
    rows = sorted(map(tuple, intervals.best_path(d, 3, known).collect()))
    monkeypatch.setattr(intervals, "LIMIT", 0)
    assert rows == sorted(map(tuple, intervals.best_path(d, 3, known).collect())) and len(rows) == 30 * 80 + 20


def test_sentences_are_no_batches_of_their_own(spark):
    from lexiflow.plans import catalogue

    for name in ("best_path_segmentation", "refine_conflicts", "phrase_paths"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan


def test_merged_phrases_are_found_without_joins(spark):
    from lexiflow.operators import ruby

    phrases = spark.createDataFrame([(1, k + 1, k, k + 1, "abcdefghij"[k]) for k in range(10)] + [(2, 1, 0, 3, "abc"), (2, 2, 3, 5, "de")], "doc_id long, phrase long, start long, end long, surface string")
    # two phrases; one phrase; the whole rest; one that begins and one that ends within a phrase; a document without phrases
    found = spark.createDataFrame([(1, 0, 2, "AB", "r1"), (1, 2, 3, "C", "r2"), (1, 5, 10, "F-J", "r3"), (2, 1, 5, "bcde", "r4"), (3, 0, 2, "x", "r5")], "doc_id long, start long, end long, base string, reading string")
    rows = ruby.merged_phrases(phrases, found)
    want = [(1, 0, 2, "AB", "r1", 2), (1, 2, 3, "c", None, 1), (1, 3, 4, "d", None, 1), (1, 4, 5, "e", None, 1), (1, 5, 10, "F-J", "r3", 5), (2, 0, 3, "abc", None, 1), (2, 3, 5, "de", None, 1)]
    assert sorted(map(tuple, rows.collect())) == want
    one = ruby.merged_phrases(phrases.where("doc_id = 1"), spark.createDataFrame([(1, 3, 5, "DE", "r"), (1, 8, 11, "IJ-", "r")], found.schema))
    assert [tuple(r) for r in one.orderBy("start").collect() if r.parts > 1 or r.start > 7] == [(1, 3, 5, "DE", "r", 2), (1, 8, 9, "i", None, 1), (1, 9, 10, "j", None, 1)]
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_readings_of_documents_are_not_broadcast(spark):
    from lexiflow.operators import ruby

    heads = spark.createDataFrame([(1, "ab", "a", "no"), (1, "x", "a", "no"), (2, "ab", "a", "no")], "doc_id long, surface string, base string, reading string")
    rows = ruby.with_map(heads, spark.createDataFrame([(1, "ab", "r1"), (1, "a", "r2")], "doc_id long, base string, reading string"))
    assert sorted((r.doc_id, r.surface, r.reading) for r in rows.collect()) == [(1, "ab", "r1"), (1, "x", "r2"), (2, "ab", "no")]
    assert "BroadcastHashJoin" not in ruby.with_map(heads, heads.select("doc_id", "base", "reading"))._jdf.queryExecution().executedPlan().toString()


def test_comparisons_read_the_texts_a_few_times(spark):
    from conftest import SF

    from lexiflow.plans import catalogue

    for n in ("stage_summary", "gate_rules", "gate_verdict"):
        assert "ArrowEvalPython" not in catalogue.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert catalogue.QUERIES["change_causes"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0


def test_pieces_and_tokens_of_odd_texts():
    import pyarrow as pa

    given = [None, "", "\n\n", "Aé×ß÷ÿ. 漢a字\nb-😀ÀB!?c", "x" * text.BYTES + "\ny", "z"]
    cut = re.compile(f"[{text.WORD}]+|\n|[^{text.WORD}\n]+")
    for batch in (pa.array(given), pa.array(["q", *given]).slice(1)):
        pieces, tokens, longer = (pa.concat_arrays(list(f.func(iter([batch])))).to_pylist() for f in (text.pieces_of, text._words_of(1), text._words_of(2)))
        for t, ps, ws, ls in zip(given, pieces, tokens, longer):
            t = t or ""
            found = [(m[0], m.start(), m.end()) for m in cut.finditer(t)]
            facts = lambda a: {"start": a, "sent": sum(t[:a].count(c) for c in ".!?\n"), "line": t[:a].count("\n")}
            assert ps == [{"i": i, "kind": "break" if s == "\n" else "word" if re.match(f"[{text.WORD}]", s) else "other", "end": b, "surface": s, **facts(a)} for i, (s, a, b) in enumerate(found, 1)]
            own = [x for x in found if re.match(f"[{text.WORD}]", x[0])]
            assert ws == [{"pos": k, "surface": s, "w": s.lower(), "end": b, "column": a - t.rfind("\n", 0, a) - 1, **facts(a)} for k, (s, a, b) in enumerate(own)]
            assert ls == [x for x in ws if len(x["surface"]) > 1]


def test_pieces_are_no_objects_of_python():
    import sys

    import pyarrow as pa

    batch = pa.array(["One two. Three\nfour " * 20_000])
    for f in (text.pieces_of, text._words_of(1)):
        found = f.func(iter([batch]))
        before = sys.getallocatedblocks()
        assert len(next(found).flatten()) >= 80_000
        assert sys.getallocatedblocks() - before < 10_000


def test_texts_with_ruby_are_made_without_an_exchange(spark):
    from lexiflow.plans import catalogue

    for name in ("ruby_texts", "ruby_annotations"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_features_are_taken_apart_once_for_the_words_in_a_row(spark, monkeypatch):
    from conftest import SF
    from pyspark.sql import functions as F

    from lexiflow.operators import phrases, text
    from lexiflow.plans import catalogue

    monkeypatch.setattr(text, "SHARED", 3)
    docs = spark.createDataFrame([(1, "Aa bb. aa\nCC dd Aa"), (2, None), (None, "x, "), (3, ""), (4, "Éa 12 bb Éa")], "doc_id long, text string")
    want = text.tokens(docs).select("doc_id", "sent", "pos", phrases.morpheme(F.col("surface"), F.expr("concat('v,', w)"), F.col("start"), F.col("end")).alias("m"))
    got = phrases.morphemes(docs, "concat('v,', w)")
    key = lambda r: (r.doc_id or 0, r.pos)
    assert got.columns == want.columns and sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.count() == 11
    # features in the plan of a query that filters by them
    plan = catalogue.QUERIES["anchor_forms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(CASE WHEN") == 1
