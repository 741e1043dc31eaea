"""Queries of morphemes and phrases: each word of ``documents`` gets features by rule, as a lexicon would give them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import grammar, lattice, phrases, text
from lexiflow.plans.registry import query
from lexiflow.plans.sql import PIECES, TOKENS, with_

#: Features of a word w, the same text for both engines.
FEATURES = """case when w in ('of', 'der', 'la', 'el') then '助詞,格助詞,一般,*,*,*,' || w || ',' || w when w in ('and', 'und', 'et', 'y') then '助詞,接続助詞' when w in ('the', 'die', 'le', 'los') then '助詞,連体化,*,*,*,*,の,ノ' when w in ('is', 'ist', 'est', 'es') then '動詞,自立,*,*,サ変,基本形,する,スル'
when w in ('to', 'a', 'de', 'en') then '助動詞,*,*,*,特殊,仮定形,' || w || ',*' when length(w) % 7 = 0 then '動詞,自立,*,*,五段,連用形,' || w || 'u,' || w when length(w) % 7 = 1 then '名詞,サ変接続,*,*,*,*,*,' || w when length(w) % 7 = 2 then '名詞,接尾,一般,*,*,*,' || w || ',*'
when length(w) % 7 = 3 then '形容詞,自立,*,*,形容詞,未然ウ接続,' || w || 'i,' || w when length(w) % 7 = 4 then '副詞,一般' when length(w) % 7 = 5 then '接頭詞,名詞接続,*,*,*,*,,' || w else '名詞,一般,*,*,*,*,' || w || ',*' end"""
_NAMES = ("major", "sub1", "sub2", "sub3", "ctype", "cform")
_PARSED = f"""fe as (select *, string_split({FEATURES}, ',') as f from tok), mo as (select doc_id, sent, pos, surface, start, "end", w, {', '.join(f"coalesce(f[{k + 1}], '*') as {n}" for k, n in enumerate(_NAMES))}, coalesce(nullif(nullif(f[7], '*'), ''), surface) as base, coalesce(f[8], '*') as reading from fe)"""
_IND = "(major = '動詞' and sub1 = '自立' or major = '形容詞' or major = '名詞' and sub1 not in ('接尾', '非自立', '特殊') or major in ('副詞', '連体詞', '接続詞', '感動詞', '接頭詞'))"
_PHRASES = f"""mi as (select *, {_IND} as ind from mo), mf as (select *, sum(fresh) over (partition by doc_id, sent order by pos) as phrase from (select *, case when lag(pos) over x is null or ind and lag(major) over x <> '接頭詞' then 1 else 0 end as fresh from mi window x as (partition by doc_id, sent order by pos))),
ph as (select doc_id, sent, cast(phrase as bigint) as phrase, list(m order by pos) as ms, string_agg(surface, '' order by pos) as surface, min(start) as start, max("end") as "end" from (select *, {{'surface': surface, 'major': major, 'sub1': sub1, 'base': base, 'reading': reading, 'ind': ind}} as m from mf) group by 1, 2, 3),
pa as (select *, coalesce(nullif(list_position(list_transform(ms, lambda m: m.ind and m.major <> '接頭詞'), true), 0), nullif(list_position(list_transform(ms, lambda m: m.ind), true), 0), 1) as hp from ph),
pr as (select *, ms[hp] as h, list_transform(list_slice(ms, hp + 1, len(ms)), lambda m: m.major = '名詞' and m.sub1 = '接尾') as suf from pa),
po as (select *, case when h.major = '名詞' then list_slice(ms, hp, hp + coalesce(nullif(list_position(suf, false), 0) - 1, len(suf))) else [h] end as own from pr),
pq as (select *, array_to_string(list_transform(own, lambda m: m.surface), '') as head_surface, array_to_string(list_transform(own, lambda m: m.base), '') as own_base, list_filter(list_transform(own, lambda m: m.reading), lambda r: r <> '*') as readings,
  list_filter(range(1, len(ms) + 1), lambda k: ms[k].major = '動詞' and ms[k].sub1 = '自立') as verbs from po),
hd as (select *, case when len(readings) = 0 then '*' else array_to_string(readings, '') end as head_reading, h.major as head_major,
  case when len(ms) >= 2 and ms[1].major = '名詞' and ms[1].sub1 = 'サ変接続' and ms[2].base = 'する' then ms[1].base when len(verbs) >= 2 then array_to_string(list_transform(list_slice(ms, 1, list_max(verbs) - 1), lambda m: m.surface), '') || ms[list_max(verbs)].base else own_base end as head_base from pq)"""


def _rows(t) -> DataFrame:
    return phrases.morphemes(t("documents"), FEATURES)


@query(with_(TOKENS, _PARSED, query="select doc_id, pos, major, sub1, sub2, sub3, ctype, cform, base, reading from mo"))
def morpheme_features(t):
    """PRJ-5: feature strings taken apart."""
    return _rows(t).select("doc_id", "pos", *[F.col(f"m.{n}").alias(n) for n in phrases.FIELDS])


@query(with_(PIECES, query="select doc_id, cast(i as bigint) as i, surface, case kind when 'break' then '改行' else '記号' end as pos, 0.0::double as novelty, true as known from placed where kind <> 'word'"))
def literal_tokens(t):
    """PRJ-4: tokens for what isn't a word."""
    return phrases.literal_tokens(text.segments(t("documents")))


@query(with_(TOKENS, _PARSED, "n as (select *, lag(surface) over x as ps, lead(surface) over x as ns, lag(major) over x as pm, lead(major) over x as nm, lead(\"end\") over x as ne from mo window x as (partition by doc_id, sent order by pos))", query="""select doc_id, sent, pos, 0 as part, case when surface = 'in' and ns = 'the' then 'inthe' else surface end as surface, case when surface = 'in' and ns = 'the' then '連体詞' else major end as major, start, case when surface = 'in' and ns = 'the' then ne else "end" end as "end" from n where not coalesce(surface = 'the' and ps = 'in', false) and not coalesce(surface = 'of' and pm = '名詞' and nm = '名詞', false)
union all select doc_id, sent, pos, k, case k when 0 then 'o' else 'f' end, case k when 0 then '名詞' else '助詞' end, start + k, start + k + 1 from n, unnest([0, 1]) as u(k) where surface = 'of' and pm = '名詞' and nm = '名詞'"""))
def morpheme_rewrites(t):
    """PRJ-6, WIN-3: pairs that are merged, and words that come apart between nouns."""
    rows = _rows(t)
    spark = rows.sparkSession
    merges = spark.createDataFrame([("in", "the", "連体詞", "*", "in the")], "first string, second string, major string, sub1 string, base string")
    splits = spark.createDataFrame([("of", "名詞", "名詞", [("o", "名詞", "一般", "*"), ("f", "助詞", "格助詞", "*")])], "surface string, before string, after string, parts array<struct<surface:string,major:string,sub1:string,reading:string>>")
    return phrases.rewritten(rows, merges, splits).select("doc_id", "sent", "pos", "part", *[F.col(f"m.{n}").alias(n) for n in ("surface", "major", "start", "end")])


@query(with_(TOKENS, _PARSED, query=f"select doc_id, sent, pos, coalesce(sum(case when major in ('動詞', '形容詞', '助動詞') then 1 else 0 end) over x, 0)::bigint as predicates, last_value(case when major = '名詞' and sub1 = '接尾' then pos end ignore nulls) over x as last_formal, last_value(case when {_IND} then pos end ignore nulls) over x as last_independent from mo window x as (partition by doc_id, sent order by pos rows between unbounded preceding and 1 preceding)"))
def boundary_features(t):
    """WIN-2: what lies before each morpheme."""
    return phrases.boundary_features(_rows(t)).drop("m")


@query(with_(TOKENS, _PARSED, _PHRASES, query='select doc_id, sent, phrase, surface, start, "end", head_surface, head_reading, head_major from hd'))
def phrase_heads(t):
    """PRJ-8, PRJ-9: phrases and their heads."""
    return phrases.with_head(phrases.phrases(_rows(t))).drop("ms", "head_base", "head_sub1")


@query(with_(TOKENS, _PARSED, _PHRASES, query="select doc_id, sent, phrase, head_base from hd"))
def phrase_base_forms(t):
    """PRJ-7: the form to look up."""
    return phrases.with_head(phrases.phrases(_rows(t))).select("doc_id", "sent", "phrase", "head_base")


_FUNCTION = """case when ms[-1].major = '助詞' and ms[-1].sub1 = '格助詞' then 'case_phrase' when ms[-1].major = '助詞' and ms[-1].base = 'の' then 'adnominal' when ms[-1].major = '助詞' and ms[-1].sub1 = '接続助詞' then 'conjunctive'
when len(list_filter(ms, lambda m: m.major in ('動詞', '形容詞', '助動詞'))) > 0 then 'predicate' when head_major = '副詞' then 'adverbial' when head_major = '名詞' then 'nominal' else 'unknown' end"""


@query(with_(TOKENS, _PARSED, _PHRASES, query=f"select doc_id, sent, phrase, function, case function when 'case_phrase' then 90 when 'predicate' then 90 when 'nominal' then 75 when 'unknown' then 40 else 85 end as confidence from (select *, {_FUNCTION} as function from hd)"))
def phrase_functions(t):
    """PRJ-10: what a phrase does in its sentence."""
    return phrases.with_function(phrases.with_head(phrases.phrases(_rows(t)))).select("doc_id", "sent", "phrase", "function", "confidence")


@query(with_(TOKENS, _PARSED, _PHRASES, query="select doc_id, sent, count(*) as n_phrases, count(*) - 1 as boundaries, true as rebuilt, true as whole from ph group by 1, 2"))
def phrase_audit(t):
    """INT-6: phrases give their sentences again."""
    rows = _rows(t)
    sentences = rows.groupBy("doc_id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m.surface"))), lambda x: x["surface"]), "").alias("surface"), F.min("m.start").alias("start"), F.max("m.end").alias("end"))
    return phrases.audit(phrases.phrases(rows), sentences)


@query(with_(TOKENS, _PARSED, query="select doc_id, pos, case cform when '仮定形' then 'conditional' when '未然ウ接続' then 'volitional' when '連用形' then 'continuative' end as value, case cform when '連用形' then 96 else 95 end as confidence from mo where cform in ('仮定形', '未然ウ接続', '連用形')"))
def anchor_forms(t):
    """PRJ-23: what a conjugation form says."""
    rows = phrases.morphemes(t("documents"), FEATURES, lambda m: phrases.anchor_form(m["cform"])).where("m is not null")
    return rows.select("doc_id", "pos", "m.value", "m.confidence")


_AUX = ("of", "the", "and", "to", "in", "is")


@query(with_(TOKENS, f"""k as (select *, case when w in {_AUX} then 2 when length(w) >= 5 then 1 else 0 end as kind from tok), c as (select *, sum(case when kind < 2 then 1 else 0 end) over (partition by doc_id, sent order by pos) as chain from k),
g as (select doc_id, sent, max(case when kind = 1 then pos end) as start_pos, string_agg(case when kind = 2 then w end, ' ' order by pos) as operators from c where kind > 0 group by doc_id, sent, chain having max(case when kind = 1 then pos end) is not null and count(*) filter (kind = 2) > 0),
o as (select doc_id, sent, start_pos, unnest(string_split(operators, ' ')) as op from g), s as (select *, case op when 'of' then 90 when 'the' then 60 else 80 end as confidence from o)""", query="select doc_id, sent, start_pos, 'operator' as kind, op as concept, confidence from s union all select doc_id, sent, start_pos, 'chain', any_value(operators), min(confidence) from s join g using (doc_id, sent, start_pos) group by 1, 2, 3"))
def chain_candidates(t):
    """SEQ-9: candidates of chains and of their operators."""
    chains = grammar.chains(text.tokens(t("documents")), F.length("w") >= 5, F.col("w").isin(*_AUX))
    return phrases.chain_candidates(chains, {"of": 90, "the": 60}, 80)


_LEX = "lex as (select s, 100 + 10 * length(s) as cost from (select unnest(['small', 'red', 'blue', 'big', 'ring', 'widget', 'gadget', 'bolt', 'nut', 'gear', 'ri', 'ng', 'wid', 'get', 're', 'd', 'bl', 'ue', 'sma', 'll', 'green', 'large', 'steel', 'plate', 'pla', 'te', 'gre', 'en', 'lar', 'ge']) as s))"


@query(f"""with recursive texts as (select distinct replace(p_name, ' ', '') as text from part), {_LEX},
unknown as (select text, i from texts, unnest(range(1, length(text) + 1)) as u(i) where not exists (select 1 from lex where substring(text, i, length(s)) = s)),
p as (select text, 1 as ap, 0 as cost, '' as path from texts union all select p.text, p.ap + length(x.s), p.cost + x.cost, p.path || x.s || '|' from p, lateral (select s, cost from lex where substring(p.text, p.ap, length(s)) = s union all select substring(p.text, p.ap, 1), 10000 from unknown where unknown.text = p.text and unknown.i = p.ap) x where p.ap <= length(p.text))
select text, cast(cost as bigint) as cost, cast(cost - min(cost) over (partition by text) as bigint) as relative_cost, rank from (select text, cost, row_number() over (partition by text order by cost) as rank from p where ap > length(text)) where rank <= 3""")
def lattice_candidates(t):
    """SEQ-1 to SEQ-3: the best segmentations of names without spaces, and how far they're from the best one."""
    names = t("part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("text")).distinct()
    spark = names.sparkSession
    words = "small red blue big ring widget gadget bolt nut gear ri ng wid get re d bl ue sma ll green large steel plate pla te gre en lar ge".split()
    lexicon = spark.createDataFrame([(w, 0, 0, 100 + 10 * len(w), "word") for w in words], "surface string, left int, right int, cost int, feature string")
    found = lattice.analysed(names, lexicon, spark.createDataFrame([], "right int, left int, cost int"), 3)
    return lattice.candidates(found, "text").select("text", "cost", "relative_cost", "rank")


#: Boundary rules of these queries, the first that fits decides.
BOUNDARIES = [
    phrases.BoundaryRule("formal_noun", "after_predicate", "join", "structural", frozenset(["with", "mit", "pour", "por"])),
    phrases.BoundaryRule("relational_noun", "after_no", "join", "structural", frozenset(["thing", "ein", "un"])),
    phrases.BoundaryRule("do", "do_after_noun", "join", "structural"),
    phrases.BoundaryRule("negated", "negated", "join", "structural", frozenset(["for", "von"]), frozenset(["with", "mit"])),
    phrases.BoundaryRule("functional", "functional", "join", "join"),
    phrases.BoundaryRule("prefix", "after_prefix", "join", "hard"),
    phrases.BoundaryRule("core", "core", "split", "split"),
    phrases.BoundaryRule("default", "default", "join", "join"),
]


@query()
def phrase_paths(t):
    """INT-5, INT-6: the best cut of each sentence by boundary rules, and how many boundaries stay open."""
    return phrases.phrase_paths(_rows(t), BOUNDARIES).withColumn("ends", F.array_join(F.col("ends").cast("array<string>"), ","))


_LEXICAL = "('名詞', '接頭詞', '動詞', '形容詞')"


def _windows(table: str, out: str) -> str:
    """Windows of two and three lexical morphemes."""
    ahead = ", ".join(f"lead({{'s': surface, 'm': major, 'c': cform, 'b': base, 'u': sub1}}, {k}) over x as a{k}" for k in (1, 2))
    tail = lambda a: f"case when {a}.m in ('動詞', '形容詞') and {a}.b <> '*' then {a}.b else {a}.s end"
    return f"""{out}0 as (select *, {{'s': surface, 'm': major, 'c': cform, 'b': base, 'u': sub1}} as a0, {ahead} from {table} window x as (partition by doc_id, sent order by pos)),
{out} as (select doc_id, sent, pos as start_pos, 2::bigint as width, a0.s || a1.s as surface, a0.s || {tail('a1')} as query, [a0, a1] as ms from {out}0 where a0.m in {_LEXICAL} and a1.m in {_LEXICAL} union all select doc_id, sent, pos, 3, a0.s || a1.s || a2.s, a0.s || a1.s || {tail('a2')}, [a0, a1, a2] from {out}0 where a0.m in {_LEXICAL} and a1.m in {_LEXICAL} and a2.m in {_LEXICAL})"""


_BENCH = _PARSED.replace("from tok)", "from btok)").replace("fe as", "bfe as").replace("from fe)", "from bfe)").replace("mo as", "bmo as")
_BTOK = TOKENS.replace("documents", "(select item_id as doc_id, text from benchmark) b").replace("pieces", "bpieces").replace("placed", "bplaced").replace("tok as", "btok as")


@query(with_(TOKENS, _PARSED, _BTOK, _BENCH, _windows("mo", "dw"), _windows("bmo", "bw"), query="""select doc_id, sent, start_pos, width, surface, query, shape, case shape when 'nominal_compound' then 94 when 'compound_predicate' then 92 when 'derived_adjective' then 90 else 60 end as confidence, shape <> 'ambiguous_lexical_sequence' as accepted
from (select *, case when len(list_filter(ms, lambda m: m.m not in ('名詞', '接頭詞'))) = 0 then 'nominal_compound' when ms[-1].m = '動詞' and len(list_filter(list_slice(ms, 1, len(ms) - 1), lambda m: m.m = '動詞' and m.c like '連用%')) = len(ms) - 1 then 'compound_predicate' when ms[-1].m = '形容詞' and ms[-1].u = '接尾' and len(list_filter(list_slice(ms, 1, len(ms) - 1), lambda m: m.m = '名詞')) = len(ms) - 1 then 'derived_adjective' else 'ambiguous_lexical_sequence' end as shape
from dw where query in (select query from bw))"""))
def lexical_candidates(t):
    """SEQ-6: windows of lexical morphemes that are entries, and their shapes."""
    m = phrases.morpheme(F.col("surface"), F.expr(FEATURES), F.col("start"), F.col("end"))
    bench = text.tokens(t("benchmark").withColumnRenamed("item_id", "doc_id")).select("doc_id", "sent", "pos", m.alias("m"))
    entries = phrases.lexical_windows(bench, 3).select("query")
    return phrases.lexical_candidates(_rows(t), entries, 3)
