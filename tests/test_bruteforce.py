"""Queries that SQL can't express, on the smallest tables, against plain Python over the same rows."""

import re
from html.parser import HTMLParser
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from conftest import SF

from lexiflow.operators import grammar, intervals
from lexiflow.plans import catalogue

WORD = "A-Za-zÀ-ÖØ-öø-ÿ0-9"


@pytest.fixture(scope="module")
def tokens():
    """(doc, sentence) -> [(pos, w, start, end)]."""
    out = {}
    for doc, text in zip(*(pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))):
        sent = pos = 0
        for m in re.finditer(f"[{WORD}]+|[.!?\n]", text or ""):
            if m[0] in ".!?\n":
                sent += 1
            else:
                out.setdefault((doc, sent), []).append((pos, m[0].lower(), m.start(), m.end()))
                pos += 1
    return out


def ranges(own):
    return [(max(a - len(w), 0), b + pos % 7 * 3, pos % 5, f"r{pos}") for pos, w, a, b in own if len(w) >= 9]


def rows_of(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalogue.QUERIES[name](spark, SF).collect())


def test_greedy_claim(spark, tokens):
    want = []
    for key, own in tokens.items():
        taken = set()
        for a, b, p, i in sorted(ranges(own), key=lambda r: (-r[2], r[0] - r[1], r[3], r[0])):
            free = not taken & set(range(a, b))
            if free:
                taken |= set(range(a, b))
            want.append((*key, i, free))
    assert rows_of(spark, "greedy_claim", "doc_id", "sent", "id", "accepted") == sorted(want)


def test_weighted_interval(spark, tokens):
    """The best sum by trying all disjoint sets, and of those the smallest ids."""
    found = {}
    for doc, sent, i, a, b, p, kept in rows_of(spark, "weighted_interval", "doc_id", "sent", "id", "start", "end", "priority", "accepted"):
        found.setdefault((doc, sent), []).append((a, b, p, i, kept))
    assert set(found) == {k for k, own in tokens.items() if ranges(own)}
    tried = 0
    for key, own in found.items():
        rs = sorted(r[:4] for r in own)
        assert rs == sorted(ranges(tokens[key]))
        picked = [r[:4] for r in own if r[4]]
        assert all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(picked, 2))
        if len(rs) <= 10:
            tried += 1
            sets = [c for n in range(len(rs) + 1) for c in combinations(rs, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2))]
            value = lambda c: sum(100 * r[2] + 10 * (r[1] - r[0]) for r in c)
            most = max(map(value, sets))
            assert value(picked) == most and sorted(r[3] for r in picked) == min(sorted(r[3] for r in c) for c in sets if value(c) == most)
    assert tried > 50


def test_greedy_and_weighted_of_many_ranges():
    """Long lists: disjoint, and for greedy equal to claiming place by place."""
    rows = [(k * 7919 % 5000, k * 7919 % 5000 + 1 + k % 13, k % 4, f"i{k:05}") for k in range(3000)]
    taken, want = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k][2], rows[k][0] - rows[k][1], rows[k][3], rows[k][0])):
        if not taken & set(range(*rows[k][:2])):
            taken |= set(range(*rows[k][:2]))
            want.append(k)
    assert list(intervals.greedy(rows)) == want
    best = sorted(rows[k] for k in intervals.weighted(rows))
    assert all(x[1] <= y[0] for x, y in zip(best, best[1:]))
    assert sum(100 * r[2] + 10 * (r[1] - r[0]) for r in best) >= sum(100 * rows[k][2] + 10 * (rows[k][1] - rows[k][0]) for k in want)


def test_best_path_segmentation(spark, tokens):
    grams = set()
    for text in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist():
        for s in re.split("[.!?\n]", text or ""):
            w = [x.lower() for x in re.findall(f"[{WORD}]+", s)]
            grams |= {f"{a} {b}" for a, b in zip(w, w[1:])}
    found = {(r[0], r[1]): r[2:] for r in rows_of(spark, "best_path_segmentation", "doc_id", "sent", "n_spans", "score", "spans")}
    assert set(found) == set(tokens)
    for key, own in tokens.items():
        first, words = own[0][0], [t[1] for t in own]
        best = {0: (0, 0, ())}
        for e in range(1, len(words) + 1):
            steps = [(best[e - 1][0], best[e - 1][1] - 1, (*best[e - 1][2], -(first + e)))]
            if e > 1:
                steps.append((best[e - 2][0] + (40 if f"{words[e - 2]} {words[e - 1]}" in grams else -80), best[e - 2][1] - 1, (*best[e - 2][2], -(first + e))))
            best[e] = max(steps)
        score, n, ends = best[len(words)]
        assert found[key] == (-n, score, ",".join(str(-e) for e in ends))


def test_refine_conflicts(spark, tokens):
    got = {(r[0], r[1], r[2]): r[3] for r in rows_of(spark, "refine_conflicts", "doc_id", "sent", "id", "resolved")}
    n = 0
    for key, own in tokens.items():
        rows = [{"concept": f"c{pos % 3}", "start": a, "end": b, "priority": p, "refines": "c1" if pos % 4 == 0 else None, "conflict_group": "g" if pos % 2 == 0 else None, "status": "accepted", "id": pos} for (a, b, p, i), pos in zip(ranges(own), [t[0] for t in own if len(t[1]) >= 9])]
        rows.sort(key=lambda r: (-r["priority"], r["start"], r["id"]))
        for i, s in enumerate(every_pair(rows)):
            assert got[(*key, rows[i]["id"])] == s
            n += 1
    assert n == len(got) > 100 and len(set(got.values())) == 3


def every_pair(rows):
    """Refinement by comparing each occurrence with all others, in their order."""
    status = [r["status"] for r in rows]
    for i, r in enumerate(rows):
        above = [o for j, o in enumerate(rows) if j != i and status[j] == "accepted" and o["priority"] > r["priority"] and o["start"] < r["end"] and r["start"] < o["end"]]
        if any(o["refines"] == r["concept"] for o in above):
            status[i] = "rejected"
        elif status[i] == "accepted" and any(o["conflict_group"] is not None and o["conflict_group"] == r["conflict_group"] for o in above):
            status[i] = "pending"
    return status


def test_refine_of_random_occurrences():
    import random

    r = random.Random(3)
    for _ in range(300):
        rows = [{"concept": r.choice("abc"), "start": (a := r.randrange(40)), "end": a + r.randrange(1, 12), "priority": r.randrange(4), "refines": r.choice(["a", "b", None]), "conflict_group": r.choice(["x", "y", None]), "status": r.choice(["accepted", "accepted", "pending"])} for _ in range(r.randrange(12))]
        assert grammar.refine(rows) == every_pair(rows)


def test_pair_of_random_fields():
    import random

    r = random.Random(4)
    for _ in range(300):
        side = lambda n: [{"key": k, "fields": [r.choice("ab"), r.choice("cd"), r.choice(["e", None])]} for k in range(n)]
        before, after = side(r.randrange(9)), side(r.randrange(9))
        used, want = set(), []
        for b in before:
            costs = [(sum(x != y for x, y in zip(b["fields"], a["fields"])), k) for k, a in enumerate(after) if k not in used]
            if costs:
                cost, k = min(costs)
                used.add(k)
                want.append((b["key"], after[k]["key"], cost))
        assert grammar.pair(before, after) == want


def test_pair_unmatched_query(spark):
    orders = {}
    t = pq.read_table(f"{SF}/orders.parquet")
    for key, customer, status, priority in zip(*(t.column(c).to_pylist() for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))):
        orders.setdefault(customer, []).append((key, (status, priority)))
    want = []
    for own in orders.values():
        own.sort()
        after = [o for o in own if o[0] % 2]
        used = set()
        for key, fields in own:
            if key % 2 == 0:
                costs = [(sum(x != y for x, y in zip(fields, a[1])), k) for k, a in enumerate(after) if k not in used]
                if costs:
                    used.add(min(costs)[1])
                    want.append((key, after[min(costs)[1]][0], min(costs)[0]))
    assert rows_of(spark, "pair_unmatched", "before_key", "after_key", "cost") == sorted(want)


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = "", 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template", "noscript", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template", "noscript", "title") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out += data


def test_pages(spark):
    """Blocks hold the page's visible letters in their order, and tile the page's text; cleaned pages have them too, and only allowed tags."""
    pages = dict(zip(*(pq.read_table(f"{SF}/pages.parquet").column(c).to_pylist() for c in ("page_id", "html"))))
    squeeze = lambda s: re.sub(r"\s", "", s)
    seen = {}
    for k, page in pages.items():
        v = Visible()
        v.feed(page or "")
        v.close()
        seen[k] = squeeze(v.out)
    texts = {r.page_id: r.text for r in catalogue.QUERIES["html_text"](spark, SF).collect()}
    assert {k: squeeze(t) for k, t in texts.items()} == seen
    blocks = {}
    for k, n, start, text in rows_of(spark, "reader_blocks", "page_id", "block_no", "start", "text"):
        assert texts[k][start : start + len(text)] == text and (start == 0 or texts[k][start - 1] == "\n")
        blocks.setdefault(k, []).append(text)
    assert {k: "\n".join(b) for k, b in blocks.items()} == {k: t for k, t in texts.items() if t}
    for r in catalogue.QUERIES["html_sanitize"](spark, SF).collect():
        assert set(re.findall(r"</?([a-z0-9]+)", r.clean)) <= set("a b blockquote br code div em h1 h2 h3 h4 h5 h6 i li ol p pre ruby rb rt rp span strong sub sup table tbody td th tr ul".split())
        assert not re.search(r"<[^>]*\s(on\w+|style|class)=", r.clean) and "javascript:" not in r.clean


def cuts(n):
    """All ways to cut n morphemes, as lists of ends."""
    for mask in range(2 ** (n - 1)):
        yield [k + 1 for k in range(n - 1) if mask >> k & 1] + [n]


def worth_of(ms, ends, rules):
    """(score, unresolved) of a cut by looking at each boundary of each span; None if a hard rule is broken."""
    from lexiflow.operators import phrases as p

    score = unresolved = start = 0
    for end in ends:
        for at in range(start + 1, min(end, len(ms) - 1) + 1):
            span = ms[start:at]
            before, current = ms[at - 1], ms[at]
            for r in rules:
                formal = [k for k, m in enumerate(span) if m["base"] in r.formal]
                fits = {
                    "symbol": "記号" in (before["major"], current["major"]),
                    "after_predicate": current["base"] in r.words and any(m["major"] in ("動詞", "形容詞", "助動詞") for m in span),
                    "after_no": before["base"] == "の" and current["base"] in r.words,
                    "do_after_noun": current["base"] == "する" and [m["major"] for m in span if m["major"] != "記号"][-1:] == ["名詞"],
                    "negated": current["base"] in r.words and bool(formal) and not any(p._independent(m) for m in span[formal[-1] + 1 :]),
                    "functional": current["major"] in ("助詞", "助動詞") or current["sub1"] in ("非自立", "接尾"),
                    "after_prefix": before["major"] == "接頭詞",
                    "core": p._independent(current),
                    "default": True,
                }[r.kind]
                if fits:
                    break
            decision = "split" if at == end else "join"
            if decision == r.decision:
                score += p.WEIGHTS[r.weight]
            elif r.weight == "hard":
                return None
            unresolved += p.WEIGHTS[r.weight] == 0
        start = end
    return score, unresolved


def test_best_phrases_of_random_sentences():
    """Against all cuts: score, then open boundaries, then fewer phrases, then earlier ends."""
    import random

    from lexiflow.operators import phrases as p
    from lexiflow.plans.morphemes import BOUNDARIES

    r = random.Random(11)
    kinds = [("動詞", "自立"), ("名詞", "一般"), ("名詞", "接尾"), ("助詞", "格助詞"), ("助動詞", "*"), ("接頭詞", "名詞接続"), ("形容詞", "自立"), ("記号", "一般")]
    rules = [p.BoundaryRule("s", "symbol", "split", "hard"), *BOUNDARIES]
    for _ in range(400):
        ms = []
        for _ in range(r.randrange(1, 9)):
            major, sub1 = r.choice(kinds)
            ms.append({"major": major, "sub1": sub1, "base": r.choice(["x", "with", "の", "thing", "する", "for"])})
        own = r.choice([rules, BOUNDARIES])
        tried = [(-w[0], w[1], len(c), c) for c in cuts(len(ms)) if (w := worth_of(ms, c, own))]
        score, unresolved, ends = p.best_phrases(ms, own)
        assert (-score, unresolved, len(ends), ends) == min(tried)


def test_phrase_paths_query(spark):
    rows = catalogue.QUERIES["phrase_paths"](spark, SF).collect()
    sentences = {(r.doc_id, r.sent): r.n for r in catalogue.QUERIES["morpheme_features"](spark, SF).join(catalogue.QUERIES["boundary_features"](spark, SF).select("doc_id", "pos", "sent"), ["doc_id", "pos"]).groupBy("doc_id", "sent").count().withColumnRenamed("count", "n").collect()}
    assert {(r.doc_id, r.sent) for r in rows} == set(sentences)
    for r in rows:
        ends = [int(x) for x in r.ends.split(",")]
        assert ends == sorted(set(ends)) and ends[-1] == sentences[r.doc_id, r.sent] and ends[0] > 0
