"""The pipeline's stages on a small table with planted cases."""

import random

import pytest

import corpus_pipeline as c
from lexiflow.llm import minhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    words = [f"{a}{b}{d}" for a in ("la", "me", "so", "ti") for b in ("n", "r", "s", "l") for d in ("o", "a", "ik", "um", "er", "est")]
    text = lambda n=60: " ".join(r.choice(words) for _ in range(n)) + "."
    bad = ["vilething", "nastyword"]
    rows, labels = [], []
    for k in range(300):
        t = text()
        if k % 5 == 0:
            t = t.split()
            for _ in range(5):
                t.insert(r.randrange(len(t)), r.choice(bad))
            t = " ".join(t)
        rows.append((k, t, "en", "s", len(t)))
        if k % 2 == 0:
            labels.append((k, 1, int(k % 5 == 0)))
    item = text(30)
    copy = rows[1][1]
    rows += [(1000, copy, "en", "s", 1), (1001, copy.replace(" ", "  ").upper(), "en", "s", 1), (1002, f"{text(20)} {item}", "en", "s", 1), (1003, text(20) + " token = abcdef0123456789abcdef", "en", "s", 1), (None, text(40), None, None, None), (1004, None, None, None, None), (1005, "", None, None, 0)]
    d = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_run(spark, folder):
    out = c.run(spark, folder)
    rows = {x.doc_id: x for x in out.collect()}
    ids = set(rows)
    assert not any(k in ids for k in range(0, 300, 5)), "toxic documents go"
    assert 1 in ids and not ids & {1000, 1001}, "one of each group stays"
    assert 1002 not in ids, "contaminated documents go"
    assert rows[1003].text.endswith("[SECRET]") and rows[1003].n_chars == len(rows[1003].text)
    clean = {k for k in range(300) if k % 5}
    assert clean <= ids and {None, 1004, 1005} <= ids, "clean documents stay"
    assert all(x.round_trip and x.n_tokens == len(x.token_ids) for x in rows.values())
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as _tagged", "2 as _dropped", "3 as secrets", "4 as score", "5 as kept", "6 as node")
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    empty = docs.where("false")
    for _, stage in c.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_near_duplicate_stage_uses_five_words(spark):
    base = [f"w{k}" for k in range(40)]
    near = [*base[:20], "x", *base[21:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(["y", *base[1:]]))], "doc_id long, text string")
    rows = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, 5, 80).collect()}
    # 36 shingles each: 2 shares 31 of 41 with 1, and 3 shares 35 of 37
    assert rows == {1: 1, 2: 2, 3: 1}
    assert sorted(x.doc_id for x in c.drop_near_duplicates(spark, docs, "").collect()) == [1, 2]
