"""Operators of the llm subpackage: brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from compare import differences
from conftest import SF

from lexiflow.llm import audio, decontaminate, language, minhash, quality, queries, secrets, sentencepiece_bpe, toxicity, url_rules, warc
from pyspark.sql import functions as F

KINDS = secrets.KINDS
LONG = "long words " * 20_000


def documents(spark, texts, ids=None, extra=True):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [((k if ids is None else ids[k]), t, None, 1.5, "x", True) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, score double, label string, kept boolean"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# SentencePiece ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.read_model(sentencepiece_bpe.default_model_path())


def test_sentencepiece_equals_the_library(spark, model):
    r = random.Random(1)
    letters = " ▁  \n\tabcdeéèﬁＡ한𠮷🙂\x01<s>thing"
    texts = [None, "", " ", "a", "▁", "x" * 3000, "ab" * 500, LONG] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = sentencepiece_bpe.encode(documents(spark, texts), model).collect()
    library = sentencepiece_bpe.Vocabulary(model).library
    for x in rows:
        want = library.encode(x.text or "")
        assert list(x.token_ids) == want and x.decoded == library.decode(want) and x.mismatches == 0
    assert len(rows) == len(texts)


def test_sentencepiece_query_on_documents(spark, model):
    library = sentencepiece_bpe.Vocabulary(model).library
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sentencepiece_bpe.op8_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for x in rows:
        ids = library.encode(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_sentencepiece_of_an_empty_table(spark, model):
    assert sentencepiece_bpe.encode(documents(spark, []), model).collect() == []


# MinHash ------------------------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def near_copies(r, groups, size):
    """Groups whose members differ by 0 to 5 replaced words, short texts, and unrelated ones."""
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice([5, 12, 40, 120]))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own))
    return texts + ["", None, " \t", "one", "One", "two words", "TWO  words", LONG]


@pytest.mark.parametrize("words", [4, 5])
def test_minhash_equals_brute_force(spark, words):
    texts = near_copies(random.Random(words), 8, 20)
    random.Random(2).shuffle(texts)
    want = brute_classes(enumerate(texts), words, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(documents(spark, texts), words, 80).collect()}
    assert got == want


def test_minhash_compares_the_rest_in_blocks(spark):
    """compared() alone finds each class that a text is similar to."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(120)] = f"x{r.random()}"
        texts.append(" ".join(own))
    sets = minhash.shingle_sets(documents(spark, texts), 4)
    s = minhash.Shingler(4)
    rows = [(7, (bytearray(s.digest(s.words(t))), k, len(s.set_of(s.words(t)))), k, True) for k, t in enumerate(texts)]
    named = spark.createDataFrame(rows, "top long, it struct<digest: binary, node: long, size: long>, label long, asks boolean")
    links = {tuple(sorted(x)) for x in minhash.compared(named, sets.dropDuplicates(["digest"]), 80).collect()}
    found = {k: set(s.set_of(s.words(t)).tolist()) for k, t in enumerate(texts)}
    want = {(a, b) for a in found for b in found if a < b and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b]) and texts[a] != texts[b]}
    same = {(a, b) for a in found for b in found if a < b and texts[a] == texts[b]}
    assert links - same == want


def test_minhash_of_awkward_rows(spark):
    text = "a b c d e f g h"
    rows = minhash.near_duplicates(documents(spark, [text, text, text, "other words stand here now", None], ids=[3, None, 3, 3, None])).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in rows if x.doc_id is not None) == [(3, 3, True)] * 3
    assert [(x.component_id, x.kept) for x in rows if x.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {x.node: x.label for x in minhash.components(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# decontamination ----------------------------------------------------------------------------------------------------


def test_components_of_a_crowded_star(spark):
    """More edges at one node, and more nodes with one label, than one task should join."""
    edges = spark.createDataFrame([(5, 10 + k) for k in range(3 * minhash.HOT)] + [(1, 2)], "a long, b long")
    found = {x.node: x.label for x in minhash.components(edges).collect()}
    assert found == {10 + k: 5 for k in range(3 * minhash.HOT)} | {5: 5, 1: 1, 2: 1}


def test_overlaps_tolerate_substitutions(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (40, 20, 14, 7, 4)]
    fill = lambda n: " ".join(r.choice(words) for _ in range(n))
    broken = items[0].split()
    for k in range(4, 40, 9):
        broken[k] = "replaced"
    texts = [f"{fill(30)} {items[0]} {fill(5)}", f"{fill(3)} {' '.join(broken)}", items[1].upper().replace(" ", ", "), f"{fill(9)}. {items[3]}! {fill(9)}", f"{fill(9)} {items[4]} {fill(9)}", fill(300), "", None, f"{fill(8)} {' '.join(items[0].split()[10:24])} {fill(8)}", " ".join(items[0].split()[:6])]
    bench = spark.createDataFrame([*enumerate(items), (9, items[1]), (None, None)], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in decontaminate.overlaps(documents(spark, texts), bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (2, 1), (3, 3), (8, 0)}
    assert found[0, 0].doc_start == 30 and found[0, 0].matched == 40 and found[2, 1].copies == 2
    assert found[1, 0].matched == 36 and (found[8, 0].item_start, found[8, 0].item_end) == (10, 24)


def test_overlaps_equal_brute_force_on_documents(spark):
    rows = decontaminate.op7_decontamination(spark, SF).collect()
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {x.item_id: split(x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {x.doc_id: split(x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, w in docs.items() for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    assert want <= {(x.doc_id, x.item_id) for x in rows}
    for x in rows:
        a, b = docs[x.doc_id][x.doc_start : x.doc_end], items[x.item_id][x.item_start : x.item_end]
        assert len(a) == len(b) and sum(p == q for p, q in zip(a, b)) == x.matched and x.score == x.matched - 2 * (len(a) - x.matched)


@pytest.mark.parametrize("n", range(decontaminate.FEWEST, decontaminate.SPAN))
def test_overlaps_find_all_that_short_items_allow(spark, n):
    """Every choice of replaced words of a short item, against the best run by brute force."""
    item = [f"w{k}" for k in range(n)]
    texts, want = [], set()
    for d in range(2**n):
        same = [d >> k & 1 for k in range(n)]
        texts.append(" ".join(["before", *(w if x else f"x{k}" for k, (w, x) in enumerate(zip(item, same))), "after"]))
        if max(sum(1 if x else decontaminate.MISMATCH for x in same[a:b]) for a in range(n) for b in range(a + 1, n + 1)) >= decontaminate.SHARE * n:
            want.add(d)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.overlaps(documents(spark, texts), bench).collect()} == want and len(want) > 1


@pytest.mark.parametrize("share", [0.05, 0.15, 0.25])
def test_overlaps_find_replaced_words_at_random(spark, share):
    """Items of 12 to 60 words with words replaced at random, against the best run by brute force: nearly all overlaps are found, and no others."""
    r = random.Random(int(share * 100))
    items = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (12, 15, 20, 30, 60) for _ in range(60)]
    texts, want = [], set()
    for k, item in enumerate(items):
        same = [r.random() >= share for _ in item]
        texts.append(" ".join(["before", *(w if x else f"x{r.randrange(10**9)}" for w, x in zip(item, same)), "after"]))
        best = run = 0
        for x in same:
            run = max(0, run) + (1 if x else decontaminate.MISMATCH)
            best = max(best, run)
        if best >= min(decontaminate.LEAST, decontaminate.SHARE * len(item)):
            want.add((k, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        if share == 0.15:
            m.setattr(decontaminate, "BYTES", 100)  # shuffled instead of broadcast
            m.setattr(decontaminate, "BLOCK", 10_000)  # several passes
        found = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(documents(spark, texts), bench).collect()}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) > 100


def test_overlaps_report_items_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (None, a), (None, b), (5, c), (None, c)], "item_id long, text string")
    found = decontaminate.overlaps(documents(spark, [a, f"{a} {b}", c, "none of these"]), bench).collect()
    assert sorted((x.doc_id, x.item_id or -1, x.copies, x.matched) for x in found) == [(0, -1, 2, 12), (1, -1, 1, 12), (1, -1, 2, 12), (2, 5, 2, 12)]


def test_overlaps_with_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.overlaps(documents(spark, []), bench).collect() == []
    assert decontaminate.overlaps(documents(spark, ["a"]), bench.where("false")).collect() == []
    rows = decontaminate.overlaps(documents(spark, ["one two three four five six"] * 3, ids=[None, None, 1]), bench).collect()
    assert sorted((x.doc_id or -1) for x in rows) == [-1, 1]


# secrets ------------------------------------------------------------------------------------------------------------


def test_fixed_spans_equal_the_base(spark):
    r = random.Random(8)
    parts = ["token", "PassWord", "api_key", "apikey", " : ", "=", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", " ", "\n", "é", "𠮷", "ſecret", "abcdefghijkl", "secret=password:", "x.y/z+"]
    base = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in base.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert secrets.fixed_spans(t) == sorted(want)


def test_novelty_and_redaction(spark):
    given = ["key: Zx9+Qk2mPv7LsW0bTnY4 end", "key: user_session_password_token_1 end", None, "", "token=abcdefghijkl01 0123456789abcdef 𠮷", LONG]
    rows = secrets.scan(documents(spark, given)).withColumn("r", secrets.redacted(F.col("text"), F.col("secrets"))).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in x.secrets] for x in rows] == [[("novel", 5, 25)], [], [], [], [("assign", 0, 20), ("hex", 21, 37)], []]
    assert [x.r for x in rows] == ["key: [SECRET] end", given[1], None, "", "[SECRET] [SECRET] 𠮷", LONG]
    assert secrets.scan(documents(spark, [])).collect() == []


@pytest.mark.parametrize("length", [64, 96, 128, 256])
@pytest.mark.parametrize("letters", ["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_novelty_finds_long_and_small_alphabet_secrets(letters, length):
    r = random.Random(5)
    code = ("def fetch(url):\n    headers = {'Authorization: Bearer ", "'}\n    return requests.get(url, headers=headers, timeout=30).json()\n")
    prose = ("The committee met in the old town hall and talked about bread, weather and roads. " * 6 + "Authorization: Bearer ", " was read aloud and nobody in the room knew what it meant.")
    for before, after in (code, prose):
        for _ in range(10):
            s = "".join(r.choice(letters) for _ in range(length - 1)) + letters[5]
            assert secrets.Novelty().spans(before + s + after, []) == [(len(before), 3, len(before) + length)]
        for plain in ("org.springframework.security.oauth2.client.registration.ClientRegistrationRepository", "session_token_" * 10 + "1", "A1" * 60):
            assert secrets.Novelty().spans(before + plain + after, []) == []


# classifiers --------------------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        score, moves = r.normal(size=n), r.normal(size=3)
        weights = {}
        for tags in np.ndindex(*[2] * n):
            s = sum(score[k] for k in range(n) if tags[k])
            s += sum({(0, 1): moves[0], (1, 1): moves[1], (1, 0): moves[2], (0, 0): 0}[tags[k], tags[k + 1]] for k in range(n - 1))
            weights[tags] = np.exp(s)
        total = sum(weights.values())
        want = [sum(v for t, v in weights.items() if t[k]) / total for k in range(n)]
        pairs = [sum(v * sum((t[k], t[k + 1]) == p for k in range(n - 1)) for t, v in weights.items()) / total for p in ((0, 1), (1, 1), (1, 0))]
        got, moved = toxicity.marginals(score, np.array([0]), np.array([n]), moves, np.ones(n))
        assert np.allclose(got, want) and np.allclose(moved, pairs)


def test_chains_and_offsets():
    ends = np.array([1, 0, 0, 1, 0] + [0] * 450, bool)
    starts, lengths = toxicity.chains_of(ends)
    assert starts.tolist() == [1, 4, 204, 404] and lengths.tolist() == [2, 200, 200, 51]
    assert toxicity.offsets("İa bad word", np.array([0, 0, 0.9, 0.8])) == [(3, 11, 0.9)]  # İ becomes two characters, the second no letter


def auc(score, y):
    order = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


def test_classifiers_on_held_out_rows(spark, sf01):
    y = {x.doc_id: x for x in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    rows = [x for x in quality.op4_quality(spark, sf01).collect()]
    assert len(rows) == len(lang) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in rows)
    own = [(x.score, y[x.doc_id].quality) for x in rows if x.held_out and x.doc_id in y]
    assert auc(np.array([a for a, _ in own]), np.array([b for _, b in own])) > 0.97
    rows = toxicity.op5_toxicity(spark, sf01).collect()
    assert len(rows) == len(lang) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    own = [(x.score, y[x.doc_id].toxic) for x in rows if x.held_out and x.doc_id in y]
    assert auc(np.array([a for a, _ in own]), np.array([b for _, b in own])) > 0.8
    rows = language.op1_language(spark, sf01).collect()
    own = [x.lang_pred == lang[x.doc_id] for x in rows if x.held_out and lang[x.doc_id]]
    assert len(rows) == len(lang) and sum(own) / len(own) > 0.98


def test_toxicity_is_alike_whatever_the_sample(spark):
    """Samples with the mix of classes of all labels and with as many of both mark as few clean documents."""
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = ~toxicity.held_out("doc_id", 4, 2)
    rates = []
    for n in (330, 2000):
        field = toxicity.fit(docs, known, learn, n, n)
        rows = toxicity.score(docs.join(known, "doc_id").where(~learn), field, score_col="s").groupBy("toxic").agg(F.avg((F.col("s") >= 0.3).cast("int")), F.count("*")).collect()
        rates.append({r[0]: r[1] for r in rows})
    assert all(r[0] < 0.03 for r in rates) and abs(rates[0][0] - rates[1][0]) < 0.02
    assert rates[1][1] > 0.85 and rates[0][1] > 0.5


def awkward(spark, good, bad=None):
    """Labelled texts with null, empty, long and repeated rows, null ids and extra columns."""
    texts = good + [None, "", " \n", LONG, good[0], good[0]] + (bad or [])
    ids = [*range(len(texts))]
    ids[1], ids[2] = None, 0
    return documents(spark, texts, ids)


def test_fitted_classifiers_on_awkward_rows(spark):
    r = random.Random(6)
    fill = lambda n, kind: " ".join(r.choice("aeiou") + r.choice("bdfgk") + kind + r.choice("aeiou") for _ in range(n))
    texts = [fill(30, "l") + (" vilething " + fill(4, "m") + " vilething" if k % 3 == 0 else "") for k in range(150)]
    docs = awkward(spark, texts)
    known = labels(spark, [*((k, int(k % 2), int(k % 3 == 0)) for k in range(150)), (None, 1, 1), (7, None, None), (3, 1, 1), (9999, 1, 1)])
    for module, name in ((toxicity, "s"), (quality, "s")):
        model = module.fit(docs, known, F.lit(True))
        assert model is not None
        rows = module.score(docs, model, score_col=name).collect()
        assert len(rows) == 156 and all(0 <= x.s <= 1 for x in rows)
        by_text = {}
        for x in rows:
            by_text.setdefault(x.text, set()).add(x.s)
        assert all(len(v) == 1 for v in by_text.values()), "repeated rows score alike"
        assert module.score(docs.where("false"), model).collect() == []
        assert {"score", "label", "kept"} <= set(module.score(docs, model, score_col="s").columns)
    field = toxicity.fit(docs, known, F.lit(True))
    found = {x.text: x for x in toxicity.score(docs, field, score_col="s").collect()}
    for t in texts:
        want = [(m.start(), m.end()) for m in re.finditer("vilething", t)]
        assert [(s.start, s.end) for s in found[t].toxic_spans] == want
    whole = LONG + " vilething"
    x = toxicity.score(documents(spark, [whole]), field, score_col="s").first()
    assert [(s.start, s.end) for s in x.toxic_spans] == [(len(whole) - 9, len(whole))], "whole texts are read"


def test_fitted_languages_on_awkward_rows(spark):
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "the bird and the fish"] * 3
    docs = spark.createDataFrame([*((k, t, lang, 0.5, "x") for k, (t, lang) in enumerate(zip(texts, ["en", "de", "fr", "en"] * 3))), (None, "the man and the sea", "en", None, None), (0, "le monde", "fr", None, None), (50, None, "en", None, None), (51, "", "de", None, None), (52, "the sea and " * 40_000, None, None, None), (53, "123 ...", None, None, None)], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.fit(docs, F.lit(True))
    rows = language.predict(docs, model).collect()
    assert len(rows) == 18 and all(0 <= x.score <= 1 for x in rows)
    found = {x.doc_id: x.lang_pred for x in rows}
    assert [found[k] for k in (1, 2, 3, 50, 51, 52, 53)] == ["de", "fr", "en", "und", "und", "en", "und"]
    assert language.predict(docs.where("false"), model).collect() == []


def test_classifiers_with_nothing_to_learn(spark):
    docs = documents(spark, ["a b", None, "", LONG], ids=[1, 1, None, 4])
    assert toxicity.fit(docs, labels(spark), F.lit(True)) is None and quality.fit(docs, labels(spark), F.lit(True)) is None
    assert [x.s for x in toxicity.score(docs, None, score_col="s").collect()] == [0.0] * 4
    assert [x.s for x in quality.score(docs, None, score_col="s").collect()] == [0.5] * 4
    model = language.fit(docs, F.lit(True))
    assert [x.lang_pred for x in language.predict(docs, model).collect()] == ["und"] * 4
    assert toxicity.score(documents(spark, []), None).collect() == [] and quality.score(documents(spark, []), None).collect() == []


def test_languages_equal_trying_every_centroid(spark, sf01):
    """The query against cosines with all centroids by plain sums over n-grams of one to three letters."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    model = language.fit(docs, ~language.held_out("doc_id", 4, 2) & F.col("doc_id").isNotNull())
    rows = {x.doc_id: x for x in language.op1_language(spark, sf01).collect()}
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert set(rows) == set(texts) and len(model.languages) > len(set(model.languages)), "several centroids a language"
    letter = language.letters()
    for k in sorted(texts)[::7]:
        counts = language.ngrams(texts[k], letter)
        if counts is None:
            assert (rows[k].lang_pred, rows[k].score) == ("und", 0)
            continue
        v = {i: np.log1p(float(c)) * model.idf[i] for i, c in enumerate(counts.tolist()) if c}
        norm = sum(x * x for x in v.values()) ** 0.5
        cosines = [sum(x * float(model.vectors[i, j]) for i, x in v.items()) / norm for j in range(len(model.languages))]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert rows[k].lang_pred == model.languages[best] or cosines[best] - max(c for c, n in zip(cosines, model.languages) if n == rows[k].lang_pred) < 1e-6
        assert abs(rows[k].score - min(1, max(0, cosines[best]))) < 1e-5
        assert rows[k].accepted == (1 - cosines[best] <= model.reach[best]) or abs(1 - cosines[best] - model.reach[best]) < 1e-5


def test_attention_equals_plain_sums(spark):
    """Scores of a fitted network against the formulas written out passage by passage."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["good text here", "1234 5678", "AB|CD", "and so on"]) for _ in range(r.randrange(1, 150))) for _ in range(60)]
    known = labels(spark, [(k, int("1234" not in t[: len(t) // 2]), 0) for k, t in enumerate(texts)] + [(k, k % 2, 0) for k in range(0, 60, 3)])
    network = quality.fit(documents(spark, texts), known, F.lit(True))
    rows = {x.doc_id: x.s for x in quality.score(documents(spark, texts + [LONG]), network, score_col="s").collect()}
    table, w = quality.classes(), network.weights
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for k, t in enumerate(texts + [LONG]):
        encoded, weights = [], []
        for passage in quality.passages(t, table):
            x = np.clip((passage - network.mean) / network.scale, -8, 8)
            e = np.tanh(x @ w["encode"] + w["encode0"])
            encoded.append(e)
            weights.append(float((np.tanh(e @ w["tanh"]) * logistic(e @ w["gate"])) @ w["attend"]))
        share = np.exp(weights) / np.exp(weights).sum()
        z = sum(a * e for a, e in zip(share, encoded))
        assert abs(rows[k] - logistic(float(z @ w["out"] + w["out0"][0]))) < 1e-4


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, "the and of", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "12 !", None), (5, "𝒶", None)], "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and out[5].lang_pred in ("en", "de") and out[4].score == 0


def test_passages_cover_the_text():
    kinds = quality.classes()
    for n in (0, 1, 399, 400, 401, 5000):
        rows = quality.passages("ab" * n, kinds)[:, : quality.CLASSES]
        assert len(rows) == max(1, -(-2 * n // quality.PASSAGE)) and np.isclose(rows.sum(1), 1).all() == (n > 0)


# urls, audio, WARC --------------------------------------------------------------------------------------------------


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [r for r, _ in url_rules.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_urls_equal_brute_force(spark):
    given = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "x://com/en/", "http://com", "http://xcom/en/1", "ftp://b.net/de/8", "http://example.net/de/8#f", "http://example.org?x=/es/", "a://b://c/en/", "http://ÄB.com/en/\n1", "://net/de/"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(given)], "page_id long, url string, host string")
    rows = {x.page_id: x for x in url_rules.judge_urls(df, labels(spark)).collect()}
    verdicts = dict(url_rules.RULES)
    for k, u in enumerate(given):
        host, path, rule = brute_url(u)
        assert (rows[k].host, rows[k].path, rows[k].rule) == (host, path, rule)
        assert rows[k].verdict == verdicts.get(rule, "allow")
    assert url_rules.judge_urls(df.where("false"), labels(spark)).collect() == []


def test_mined_rules_equal_counting(spark):
    r = random.Random(6)
    rows = [([f"h:{r.choice('abc')}", f"p:{r.choice('xyz')}", f"q:{r.choice('mn')}"], None) for _ in range(400)]
    rows = [(x, "block" if "h:a" in x and "p:x" in x or r.random() < 0.02 else "allow") for x, _ in rows]
    mined = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string"))
    got = {(tuple(r.x), r.y): (r.confidence, r.freq) for r in mined.collect()}
    sets = {tuple(sorted(c)) for x, _ in rows for n in (1, 2, 3) for c in __import__("itertools").combinations(x, n)}
    all_rules = {}
    for s in sets:
        base = [y for x, y in rows if set(s) <= set(x)]
        for y in ("block", "allow"):
            if base.count(y) >= url_rules.FEWEST and base.count(y) / len(base) >= url_rules.CONFIDENCE:
                all_rules[s, y] = (base.count(y) / len(base), base.count(y))
    needless = {(s, y) for s, y in all_rules for t in s if all_rules.get((tuple(x for x in s if x != t), y), (0,))[0] >= all_rules[s, y][0]}
    assert got == {k: v for k, v in all_rules.items() if k not in needless}
    assert (("h:a", "p:x"), "block") in got


def test_mined_rules_judge_urls_that_were_not_labelled(spark):
    """Labels of the documents that urls name; spam hosts with a tracking path are bad, others mostly good. Repeated rows, null ids and a clashing column."""
    r = random.Random(12)
    rows, known, bad = [], [], {}
    for k in range(1200):
        spam, track = r.random() < 0.3, r.random() < 0.5
        url = f"https://{'win-now' if spam else 'news' + str(k % 40)}.example.edu/{'out' if track else 'read'}/{k}{r.choice(['', '/', '.html', '?a=1'])}"
        rows.append((k + 5000, url, "x"))
        bad[k + 5000] = spam and track
        if k % 2:
            known.append((k, int(not (spam and track)), 0))
    rows += [(None, rows[0][1], "x"), rows[1], (99, "https://win-now.example.edu/out/" + "p/" * 30_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = url_rules.judge_urls(df, labels(spark, known)).collect()
    assert len(found) == 1203
    new = [x for x in found if x.page_id is not None and x.page_id % 2 == 0 and x.page_id >= 5000]
    assert sum((x.verdict == "block") == bad[x.page_id] for x in new) > 0.97 * len(new)
    assert all(x.mined == "h:win-now p:out" for x in found if x.page_id and bad.get(x.page_id))
    assert next(x for x in found if x.page_id == 99).verdict == "block", "whole urls are read"
    with pytest.MonkeyPatch.context() as m:
        m.setattr(url_rules, "BLOCK", 2)  # many blocks of rules
        assert sorted(map(str, url_rules.judge_urls(df, labels(spark, known)).collect())) == sorted(map(str, found))


def test_audio_aligns_shifted_noisy_copies(spark):
    r = np.random.default_rng(2)

    def tune(seed):
        q = np.random.default_rng(seed)
        t = np.arange(500) / 2000
        return np.concatenate([sum(a * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k, a in enumerate(q.dirichlet(np.ones(12) * 0.4))) for _ in range(40)])

    a, b = tune(1), tune(2)
    pcm = lambda x: (x / np.abs(x).max() * 30000).astype("<i2").tobytes()
    rows = [(20, pcm(a)), (1, pcm(a + r.normal(0, 0.005, len(a)))), (2, pcm(a[128 * 20 :])), (3, pcm(b)), (4, None), (5, b""), (6, b"RIFFbroken"), (None, pcm(a)), (7, pcm(a))]
    df = spark.createDataFrame(rows, "id long, pcm binary")
    prints = audio.fingerprints(df, "pcm", 2000, "id")
    queries = prints.where("id % 20 = 0")
    found = {x.id: x for x in audio.search(prints, queries, "id").collect()}
    assert set(found) == {20, 1, 2, 7} and found[7].bit_error == found[20].bit_error == 0 and found[7].offset == 0 and found[2].offset == -20
    assert audio.search(prints.where("false"), queries, "id").collect() == [] and audio.search(prints, queries.where("false"), "id").collect() == []


def expanded(rows, id_col):
    """Sorted pairs (query, recording, offset, votes, bit error) of the rows of audio.links, by their stated rule."""
    members = [x for x in rows if x[id_col] is not None]
    return sorted(
        (q[id_col], m[id_col], x.offset, x.votes, x.bit_error)
        for x in rows
        if x.query_class is not None
        for q in members
        if q.is_query and q.class_id == x.query_class
        for m in members
        if not m.is_query and m.class_id == x.class_id
    )


def test_audio_links_hold_all_pairs_of_the_search(spark):
    r = np.random.default_rng(4)
    base = [r.integers(-(2**31), 2**31, 60).astype(np.int32) for _ in range(3)]
    near = lambda f, k: [int(x) ^ (1 if n % 20 == k else 0) for n, x in enumerate(f)]
    a, b, c = ([int(x) for x in f] for f in base)
    rows = [(0, a), (20, a), (40, near(a, 1)), (60, near(a, 2)), (1, a), (2, a), (2, a), (3, near(a, 3)), (4, near(a, 3)), (80, b), (5, b), (6, c), (7, []), (100, []), (None, a), (9, c), (9, b)]
    prints = spark.createDataFrame(rows, "id long, fingerprint array<int>")
    queries = prints.where("id % 20 = 0")
    found = audio.links(prints, queries, "id").collect()
    want = sorted(map(tuple, audio.search(prints, queries, "id").select("query_id", "id", "offset", "votes", "bit_error").collect()))
    assert expanded(found, "id") == want and sum(m == 3 for _, m, *_ in want) == 4
    assert sorted(x.id for x in found if x.id is not None and not x.is_query) == sorted(i for i, _ in rows if i is not None)
    assert sorted(x.id for x in found if x.is_query) == [0, 20, 40, 60, 80, 100]
    assert audio.links(prints.where("false"), queries.where("false"), "id").collect() == []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(audio, "FRAMES", 100)  # several blocks of queries
        assert sorted(map(tuple, audio.search(prints, queries, "id").select("query_id", "id", "offset", "votes", "bit_error").collect())) == want


def all_offsets(q, f):
    """(share of wrong bits, offset) of the best of all offsets with enough overlap, by trying each; None without one."""
    found = []
    for s in range(-len(q) + 1, len(f)):
        a, b = max(0, -s), min(len(q), len(f) - s)
        if b - a >= max(1, min(audio.OVERLAP, len(q), len(f))):
            found.append((int(np.bitwise_count((q[a:b] ^ f[a + s : b + s]).view(np.uint32)).sum()) / (32 * (b - a)), s))
    return min(found, default=None)


def test_op3_against_all_offsets(spark):
    """All links of the query on the smallest table, against every offset of every pair of a query's second recording and a tune."""
    vectors = audio.table(spark, SF, "embeddings")
    tunes = {x.vec_id: np.array(x.fingerprint, np.int32) for x in audio.fingerprints(vectors, audio.rendered("embedding"), audio.RATE, "vec_id").collect()}
    asked = {x.vec_id: np.array(x.fingerprint, np.int32) for x in audio.fingerprints(vectors.where("vec_id % 20 = 0"), audio.rendered("embedding", audio.LATE, audio.EARLY, audio.NOISE), audio.RATE, "vec_id").collect()}
    want = {(k, i): best for k, q in asked.items() for i, f in tunes.items() if (best := all_offsets(q, f)) and best[0] <= audio.ERRORS}
    found = {(q, i): (e, o) for q, i, o, _, e in expanded(audio.op3_audio(spark, SF).collect(), "vec_id")}
    assert {(k, k) for k in asked} <= set(want), "each second recording is near its tune"
    assert set(found) <= set(want) and sum(found.get(k) == v for k, v in want.items()) >= 0.9 * len(want)
    assert all(abs(o - audio.LATE / audio.HOP) < 1 for (a, b), (_, o) in found.items() if a == b), "at the place where it begins"


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 0.12, audio.ERRORS])
def test_audio_search_equals_trying_all_offsets(share):
    """Recall of the index at each rate of wrong bits up to ERRORS, against all pairs and offsets."""
    r = np.random.default_rng(7)
    queries = [r.integers(-(2**31), 2**31, 75).astype(np.int32) for _ in range(60)]
    index = audio.Index([(k, q.tobytes()) for k, q in enumerate(queries)])
    given = []
    for q in queries:
        flips = np.zeros(75 * 32, bool)
        flips[r.permutation(len(flips))[: int(share * len(flips))]] = True
        flips = np.packbits(flips.reshape(75, 32), axis=1).view(np.uint32).ravel()
        given.append(np.r_[r.integers(-(2**31), 2**31, 9).astype(np.int32), (q.view(np.uint32) ^ flips).view(np.int32)])
    found = [{m[0]: (m[3], m[1]) for m in ms} for ms in index.matches(given)]
    want = [{k: best for k, q in enumerate(queries) if (best := all_offsets(q, f)) and best[0] <= audio.ERRORS} for f in given]
    assert sum(map(len, want)) >= 60 and all(w[k] == (pytest.approx(w[k][0]), 9) for k, w in enumerate(want))
    assert sum(f.get(k) == v for f, w in zip(found, want) for k, v in w.items()) >= 0.9 * sum(map(len, want))


def test_warc_round_trip(spark):
    page = '<html lang="de"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><p>Eins<br>zwei</p><!-- weg --><a href="/x">drei</a></body></html>'
    df = spark.createDataFrame([(1, "http://a/ö", page, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, warc string")
    rows = warc.derivatives(warc.responses(df), "page_id").collect()
    assert len(rows) == 8
    for x in rows:
        ((headers, block),) = warc.parse(bytes(x.record))
        assert headers["WARC-Block-Digest"] == warc.digest(block) == x.block_digest and int(headers["Content-Length"]) == len(block) == x.content_length
        assert headers["WARC-Refers-To"] == x.refers_to and headers["WARC-Type"] == x.record_type
    first = {x.record_type: x for x in rows if x.page_id == 1}
    ((source, block),) = warc.parse(warc.response(f"1:http://a/ö:{warc.digest(page.encode())}", "http://a/ö", page))
    ((_, text),) = warc.parse(bytes(first["conversion"].record))
    ((_, fields),) = warc.parse(bytes(first["metadata"].record))
    assert text.decode() == "A & B\nEins\nzwei\ndrei" and first["conversion"].refers_to == source["WARC-Record-ID"]
    for line in (f"source-block-digest: {source['WARC-Block-Digest']}", f"source-payload-digest: {warc.digest(page.encode())}", "language: de", "title: A & B", "source-http-content-type: text/html; charset=utf-8", f"conversion-record-id: {first['conversion'].record_id}"):
        assert line in fields.decode()
    assert warc.responses(df.where("false")).collect() == []


def test_warc_parser_survives_damage(tmp_path, spark):
    import gzip

    good = warc.response("s", "http://a", "<p>x")
    data = good + b"WARC/1.1\r\nContent-Length: many\r\n\r\n" + good
    assert len(list(warc.parse(data))) == 2 and len(list(warc.parse(gzip.compress(good) + gzip.compress(good)))) == 2
    assert list(warc.parse(good[:-60])) == [] and list(warc.parse(gzip.compress(good)[:-9])) == [] and list(warc.parse(b"")) == []
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good))
    assert warc.derivatives(warc.read(spark, str(tmp_path)), "file_id").count() == 4


def test_warc_of_real_servers():
    """Header names in any case, repeated headers, codings, members one by one, and what is kept of damaged files."""
    import gzip
    import zlib

    def page(head, payload, kind="warc-type"):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + payload
        return f"WARC/1.0\r\n{kind}: Response\r\nwarc-record-id: <urn:x:{len(payload)}>\r\nWARC-IP-Address: 1.2.3.4\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"<title>T</title><p>some text here"
    chunked = b"".join(f"{len(body[k : k + 7]):x};x=1\r\n".encode() + body[k : k + 7] + b"\r\n" for k in range(0, len(body), 7)) + b"0\r\n\r\n"
    cases = [
        (b"Content-Type: text/html", body),
        (b"Transfer-Encoding: Chunked", chunked),
        (b"content-encoding: GZIP", gzip.compress(body)),
        (b"Content-Encoding: deflate", zlib.compress(body)),
        (b"Content-Encoding: deflate", zlib.compress(body, wbits=-15)),
        (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"".join([b"%x\r\n" % len(gzip.compress(body)), gzip.compress(body), b"\r\n0\r\n\r\n"])),
    ]
    for head, payload in cases:
        ((headers, block),) = warc.parse(page(head + b"\r\nSet-Cookie: a\r\nset-cookie: b\r\n c", payload))
        (_, meta), (own, text) = warc.derive(headers, block)
        assert text.decode() == "T\nsome text here" and own["WARC-Refers-To"] == f"<urn:x:{len(payload)}>"
        for line in ("source-http-set-cookie: a", "source-http-set-cookie: b c", "source-warc-ip-address: 1.2.3.4"):
            assert line in meta.decode().split("\r\n")
    ((headers, block),) = warc.parse(page(b"Content-Encoding: br", b"\x8b\x02"))
    (_, meta), (_, text) = warc.derive(headers, block)
    assert text == b"" and b"content coding not known" in meta

    good = [page(b"Content-Type: text/html", body + b"x" * k) for k in range(6)]
    lengths = lambda data: [len(b) for _, b in warc.parse(data)]
    want = lengths(b"".join(good))
    assert len(want) == 6 and lengths(gzip.compress(b"".join(good))) == want
    zipped = [gzip.compress(x) for x in good]
    assert lengths(b"".join(zipped)) == want
    broken = bytearray(zipped[2])
    broken[30:40] = bytes(10)
    assert lengths(b"".join([*zipped[:2], bytes(broken), *zipped[3:]])) == want[:2] + want[3:]
    assert lengths(b"".join([*zipped[:5], zipped[5][:-12]])) == want[:5]
    big = page(b"Content-Type: text/html", random.Random(1).randbytes(3 * warc.PIECE))
    assert lengths(gzip.compress(good[0] + big + good[1])) == [want[0], len(big) - len(big.split(b"\r\n\r\n")[0]) - 8, want[1]]
    cut = gzip.compress(b"".join(good[:3]) + big)
    assert want[:2] == lengths(cut[: len(cut) // 2])[:2], "of a whole file in one member, what lies before the damage"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_results_leave_python_some_texts_at_a_time(spark):
    """A batch of Spark has 10,000 texts; their results aren't held together."""
    import pyarrow as pa

    batch = pa.array(["a b c password = abcdefghijklmnop", None, ""] * 700)
    model = sentencepiece_bpe.read_model(sentencepiece_bpe.default_model_path())
    for f in (sentencepiece_bpe.coder(model), secrets.scanner(), toxicity.tagger(None)):
        sizes = [len(x) for x in f.func(iter([batch, batch[:0]]))]
        assert sum(sizes) == len(batch) and max(sizes) <= 500
