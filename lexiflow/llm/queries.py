"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lexiflow.llm import audio, decontaminate, language, minhash, quality, secrets, sentencepiece_bpe, toxicity, url_rules, warc

QUERIES = {
    "op1_language": language.op1_language,
    "op2_url_rules": url_rules.op2_url_rules,
    "op3_audio": audio.op3_audio,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secrets": secrets.op6_secrets,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sentencepiece": sentencepiece_bpe.op8_sentencepiece,
    "op9_warc": warc.op9_warc,
    "op10_minhash": minhash.op10_minhash,
}

def _care(mask: str, alias: str) -> str:
    """The words of a window that count under a mask, joined."""
    return " || ' ' || ".join(f"{alias}[p + {k + 1}]" for k, c in enumerate(mask) if c == "1")


def _seeds(table: str, key: str) -> str:
    parts = [f"select {key}, p, {n} as mask, {_care(m, 'l')} as seed from (select {key}, l, unnest(range(0, greatest(len(l) - {decontaminate.SPAN - 1}, 0))) as p from {table} where len(l) >= {decontaminate.SPAN})" for n, m in enumerate(decontaminate.MASKS)]
    return " union all ".join(parts)


#: Expects items of at least SPAN words or of less than FEWEST, which the driver's tables have.
OP7 = f"""with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as l from documents),
i as (select l, min(item_id) as item_id, count(*) as copies from (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as l from benchmark) where len(l) >= {decontaminate.FEWEST} group by l),
ds as ({_seeds("d", "doc_id")}), bs as ({_seeds("i", "item_id")}),
c as (select distinct doc_id, item_id, ds.p - bs.p as shift from ds join bs using (mask, seed)),
a as (select c.*, len(i.l) as item_words, copies, k, case when d.l[k + shift] = i.l[k] then 1 else {decontaminate.MISMATCH} end as v
  from (select *, unnest(range(1, (select max(len(l)) from i) + 1)) as k from c) c join i using (item_id) join d using (doc_id) where k <= len(i.l) and k + shift between 1 and len(d.l)),
p as (select *, sum(v) over w as s, sum(v) over w - v as s0 from a window w as (partition by doc_id, item_id, shift order by k)),
m as (select *, min(s0) over (partition by doc_id, item_id, shift order by k) as low from p),
t as (select doc_id, item_id, shift, item_words, copies, arg_max(struct_pack(e := k, low := low, score := s - low), struct_pack(a := s - low, b := -k)) as x from m group by all),
r as (select t.doc_id, t.item_id, t.shift, t.item_words, t.copies, x.score as score, x.e as item_end, max(m.k) - 1 as item_start from t join m on m.doc_id = t.doc_id and m.item_id = t.item_id and m.shift = t.shift and m.k <= x.e and m.s0 = x.low group by all),
q as (select *, (score + 2 * (item_end - item_start)) // 3 as matched from r where score >= least({decontaminate.LEAST}, item_words * {decontaminate.SHARE})),
b as (select doc_id, item_id, copies, item_words, max(struct_pack(score := score, matched := matched, back := -shift, width := item_end - item_start, start := item_start)) as b from q group by all)
select doc_id, item_id, copies, cast(item_words as int) as item_words, cast(b.score as int) as score, cast(b.matched as int) as matched, cast(b.start as int) as item_start, cast(b.start + b.width as int) as item_end, cast(b.start - b.back as int) as doc_start, cast(b.start - b.back + b.width as int) as doc_end from b"""

OP10 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\\x20\\x09-\\x0D]+') as l from documents),
t as (select doc_id, unnest(l) as w, generate_subscripts(l, 1) as i from w where len(l) >= 4),
g as (select distinct doc_id, w || ' ' || w1 || ' ' || w2 || ' ' || w3 as g from (select *, lead(w, 1) over p as w1, lead(w, 2) over p as w2, lead(w, 3) over p as w3 from t window p as (partition by doc_id order by i)) where w3 is not null
  union all select doc_id, array_to_string(l, ' ') from w where len(l) between 1 and 3),
s as (select w.doc_id, count(g) as n from w left join g using (doc_id) group by w.doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as n from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
k as (select a, b from c join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
r as (select doc_id, doc_id as other from s union select r.doc_id, k.b from r join k on k.a = r.other)
select s.doc_id, s.n as n_shingles, m.component_id, s.doc_id = m.component_id as kept from s join (select doc_id, min(other) as component_id from r group by doc_id) m using (doc_id)"""

# the models of the other operators, their novelty, records and token ids are beyond SQL; their tests use brute force, round trips and held-out rows
ORACLES: dict[str, str] = {"op7_decontamination": OP7, "op10_minhash": OP10}
