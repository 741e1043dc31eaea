"""Queries of the dictionary lookup, over a dictionary made from the words of ``benchmark`` and the words of ``conversations`` as what is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import dictionary, lookup, text
from lexiflow.plans.registry import query
from lexiflow.plans.sql import WORD, with_

# letters and the kana that stand for them in this dictionary
LATIN, HIRA, KATA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは", "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"


def _inputs(array) -> dict[str, str]:
    """The tables' SQL; ``array`` writes an array of expressions in an engine's way."""
    none = f"cast({array()} as {'varchar[]' if array() == '[]' else 'array<string>'})"
    hira, kata = (f"translate(substring(w, 1, 3), '{LATIN}', '{k}')" for k in (HIRA, KATA))
    return {
        "entries": f"""select 'd' || m as dict, 'd' || m || ':' || w as entry_id, row_number() over (partition by m order by w) as record_index, w as headword, {hira} as reading,
  case length(w) % 6 when 0 then 'surname' when 1 then 'suffix' when 2 then 'redirect' else 'word' end as kind,
  case length(w) % 4 when 0 then {array("'動五'")} when 1 then {array("'名'", "'形動'")} when 2 then {none} else {array("'連語'")} end as labels,
  case when length(w) >= 7 then {array("w", "substring(w, 1, length(w) - 2)")} else {array("w")} end as forms, length(w) <> 5 as content from vocab""",
        "keys": f"""select 'd' || m as dict, 'd' || m || ':' || w as entry_id, 'form' as kind, w as value, 0 as rank from vocab
  union all select 'd' || m, 'd' || m || ':' || w, 'form', substring(w, 1, 5), 1 from vocab where length(w) >= 6 union all select 'd' || m, 'd' || m || ':' || w, 'reading', {kata}, 0 from vocab""",
        "aliases": "select 'd' || m as dict, w || 's' as alias, w as target from vocab where length(w) >= 3",
        "asked": f"""select w as query_id, case when length(w) % 5 = 0 then {hira} else w end as headword, case length(w) % 3 when 0 then {kata} when 1 then null else '*' end as reading,
  case length(w) % 4 when 0 then '動詞' when 1 then '名詞' end as pos, case when length(w) % 2 = 0 then w end as observed from said""",
    }


_DUCK = _inputs(lambda *x: f"[{', '.join(x)}]")
_TABLES = f"""vocab as (select distinct item_id % 3 as m, lower(unnest(regexp_extract_all(text, '{WORD}+'))) as w from benchmark), said as (select distinct lower(unnest(regexp_extract_all(text, '{WORD}+'))) as w from conversations where role = 'user'),
entries as ({_DUCK["entries"]}), keys as ({_DUCK["keys"]}), aliases as ({_DUCK["aliases"]}), asked as ({_DUCK["asked"]})"""
_KANA = "regexp_matches(headword, '^[ぁ-ゟ゠-ヿー]+$')"
_KATA = f"translate({{}}, '{HIRA}', '{KATA}')"
_FOUND = f"""q as (select *, coalesce(nullif(nullif(reading, '*'), ''), case when {_KANA} then headword end) as wanted, {_KANA} as kana from asked),
top as (select * from (select dict, kind, value, entry_id, row_number() over (partition by dict, kind, value order by min(rank), entry_id) as k from keys group by dict, kind, value, entry_id) where k <= 10),
direct as (select query_id, dict, entry_id from q join top on kind = 'form' and value = headword),
direct2 as (select query_id, dict, entry_id from direct union all select query_id, e.dict, e.entry_id from q join entries e using (headword) where not exists (select 1 from top where top.kind = 'form' and top.value = q.headword and top.dict = e.dict)),
hop as (select distinct query_id, dict, target from q join aliases on alias = headword),
hopped as (select query_id, dict, entry_id from hop join top using (dict) where kind = 'form' and value = target union select query_id, e.dict, e.entry_id from hop join entries e on e.dict = hop.dict and e.headword = target where not exists (select 1 from top where top.kind = 'form' and top.value = target and top.dict = hop.dict)),
enough as (select query_id, dict from direct2 join entries using (dict, entry_id) where kind <> 'redirect' and content union select query_id, dict from hopped join entries e using (dict, entry_id) join q using (query_id) where e.kind <> 'redirect' and (wanted is null or {_KATA.format('e.reading')} = {_KATA.format('wanted')})),
back as (select query_id, t.dict, t.entry_id from q join top t on t.kind = 'reading' and t.value = {_KATA.format('wanted')} join entries e on e.dict = t.dict and e.entry_id = t.entry_id where not exists (select 1 from enough n where n.query_id = q.query_id and n.dict = t.dict) and (kana or list_contains(e.forms, q.headword))),
found as (select query_id, dict, entry_id, min(stage) as stage from (select *, 0 as stage from direct2 union all select *, 1 from hopped union all select *, 2 from back) group by 1, 2, 3)"""
_SCORED = f"""judged as (select f.query_id, f.dict, f.entry_id, e.kind, e.record_index, e.forms, e.reading as own_reading, q.wanted, q.headword as query, q.observed, stage,
  case when q.wanted is null or e.reading is null then 'absent' when {_KATA.format('e.reading')} = {_KATA.format('q.wanted')} then 'exact' else 'conflict' end as reading_match,
  case when q.pos is null then 'unknown' when len(e.labels) = 0 then case when e.kind = 'surname' and q.pos = '名詞' then 'compatible' when e.kind in ('surname', 'suffix') then 'conflict' else 'unknown' end
    when e.labels = ['連語'] then 'unknown' when q.pos = '動詞' and contains(array_to_string(e.labels, ','), '動') then 'exact' when q.pos = '名詞' and contains(array_to_string(e.labels, ','), '名') then 'exact' else 'conflict' end as pos_match, e.headword as head from found f join q using (query_id) join entries e on e.dict = f.dict and e.entry_id = f.entry_id),
scored as (select *, cast(case stage when 0 then 160 when 1 then 120 else 55 end + case when head = query then 45 else 0 end + case reading_match when 'exact' then 30 when 'conflict' then -45 else 0 end + case pos_match when 'exact' then 24 when 'compatible' then 12 when 'conflict' then -20 else 0 end
  + case kind when 'surname' then -65 when 'suffix' then -75 when 'redirect' then -120 else 0 end as bigint) as score from judged),
ranked as (select *, row_number() over (partition by query_id order by score desc, dict, record_index) as rank,
  row_number() over own as k, case when lead(kind = 'redirect') over own = (kind = 'redirect') then lead(score) over own end as second from scored window own as (partition by query_id, dict order by kind = 'redirect', score desc, record_index)),
final as (select *, k = 1 and score >= 80 and (second is null or score - second >= 16) as preferred from ranked)"""
_SEEDS = """opened as (select query_id, dict, own_reading, score, query, observed, unnest(forms) as form from final where kind <> 'redirect' and reading_match <> 'conflict'),
seeds as (select query_id, form as normal, greatest(max(score + 40 + case when form = observed then 1240 else 0 end + case when form = query then 880 else 0 end), max(case when form = observed then 3000 else 0 end), max(case when form = query then 2000 else 0 end)) as score, list_sort(list(distinct dict)) as dicts from opened group by 1, 2)"""


def _tables(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """queries, entries, keys, aliases."""
    spark = t("benchmark").sparkSession
    vocab = text.words(t("benchmark").withColumnRenamed("item_id", "doc_id")).select((F.col("doc_id") % 3).alias("m"), "w").distinct()
    said = text.words(t("conversations").where("role = 'user'").withColumnRenamed("conv_id", "doc_id")).select("w").distinct()
    made = {n: spark.sql(q.replace("from vocab", "from {vocab}").replace("from said", "from {said}"), **({"said": said} if n == "asked" else {"vocab": vocab})) for n, q in _inputs(lambda *x: f"array({', '.join(x)})").items()}
    return made["asked"], made["entries"], made["keys"], made["aliases"]


@query(with_(_TABLES, _FOUND, query="select query_id, dict, entry_id, case stage when 0 then 'exact_form' when 1 then 'explicit_alias' else 'reading_fallback' end as match_type from found"))
def lookup_stages(t):
    """JOIN-1 to JOIN-8, SET-1, SRT-7: keys, headwords, aliases and readings, ten entries of a key in each dictionary."""
    return lookup.discovered(*_tables(t))


@query(with_(_TABLES, _FOUND, _SCORED, query="select query_id, dict, entry_id, reading_match, pos_match, score, rank, preferred from final"))
def lookup_scores(t):
    """SCL-5 to SCL-7, WIN-6, SRT-3: scores, ranks and the preferred entry of each dictionary."""
    return lookup.lookup(*_tables(t)).select("query_id", "dict", "entry_id", "reading_match", "pos_match", "score", "rank", "preferred")


@query(with_(_TABLES, _FOUND, _SCORED, _SEEDS, query="select query_id, normal, score, array_to_string(dicts, ',') as dicts from seeds"))
def lookup_seeds(t):
    """SCL-8: forms of what was found and their scores."""
    asked, *tables = _tables(t)
    return lookup.seeds(lookup.lookup(asked, *tables), asked).select("query_id", "normal", "score", F.array_join("dicts", ",").alias("dicts"))


@query(with_(_TABLES, _FOUND, _SCORED, _SEEDS, query="select query_id, normal, d.dict, list_contains(dicts, d.dict) as available, row_number() over (partition by query_id, d.dict order by score desc, len(dicts) desc, normal) as place from seeds cross join (select distinct dict from entries) d"))
def form_matrix(t):
    """JOIN-9, SRT-5: forms against dictionaries."""
    asked, *tables = _tables(t)
    names = tables[0].select("dict").distinct().withColumn("place", F.lit(0))
    groups = lookup.form_groups(lookup.seeds(lookup.lookup(asked, *tables), asked), names)
    return groups.select("query_id", "normal", "place", F.explode("availability").alias("a")).select("query_id", "normal", "a.dict", "a.available", "place")


_ORDER = "ord as (select * from (values ('D2', 1), ('d0', 2)) o(dict, position))"


@query(with_(_TABLES, _FOUND, _SCORED, _ORDER, query="select query_id, f.dict, entry_id, row_number() over (partition by query_id order by position nulls last, rank) as place from final f left join ord on lower(ord.dict) = f.dict"))
def user_order(t):
    """SRT-4, DML-6, SET-7: the user's order of dictionaries, names in any case, others last."""
    found = lookup.lookup(*_tables(t))
    order = found.sparkSession.createDataFrame([("D2", 1), ("d0", 2)], "dict string, position int")
    return lookup.user_order(found, order).select("query_id", "dict", "entry_id", "place")


_ACTIVE = f"""active as (select query_id, normal, coalesce(case when normal = q.observed then q.observed end, case when normal = q.headword then q.headword end, normal) as form, wanted as asked_reading, nullif(nullif(q.reading, '*'), '') as given, q.pos from (select *, row_number() over (partition by query_id order by score desc, len(dicts) desc, normal) as k from seeds) join q using (query_id) where k = 1),
again as (select query_id, dict, entry_id from active join top on kind = 'form' and value = form union select query_id, e.dict, e.entry_id from active join entries e on e.headword = form where not exists (select 1 from top where top.kind = 'form' and top.value = form and top.dict = e.dict)),
pool as (select query_id, dict, entry_id, min(stage) as stage from (select *, 0 as stage from again union all select query_id, dict, entry_id, stage from found) group by 1, 2, 3),
rescored as (select p.query_id, p.dict, p.entry_id, e.record_index, e.kind, a.form, a.given, e.reading, e.forms,
  coalesce(a.given, case when regexp_matches(a.form, '^[ぁ-ゟ゠-ヿー]+$') then a.form end) as asked2, a.pos, e.labels, e.headword, stage from pool p join active a using (query_id) join entries e on e.dict = p.dict and e.entry_id = p.entry_id),
rescored2 as (select *, cast(case stage when 0 then 160 when 1 then 120 else 55 end + case when headword = form or forms[1] = form then 45 else 0 end + case when asked2 is null then 0 when {_KATA.format('reading')} = {_KATA.format('asked2')} then 30 else -45 end
  + case when pos is null then 0 when len(labels) = 0 then case when kind = 'surname' and pos = '名詞' then 12 when kind in ('surname', 'suffix') then -20 else 0 end when labels = ['連語'] then 0 when pos = '動詞' and contains(array_to_string(labels, ','), '動') then 24 when pos = '名詞' and contains(array_to_string(labels, ','), '名') then 24 else -20 end
  + case kind when 'surname' then -65 when 'suffix' then -75 when 'redirect' then -120 else 0 end as bigint) as score from rescored),
shown as (select *, row_number() over (partition by query_id order by score desc, dict, record_index) as rank from rescored2)"""


@query(with_(_TABLES, _FOUND, _SCORED, _SEEDS, _ACTIVE, _ORDER, query=f"select query_id, form, s.dict, entry_id, score, row_number() over (partition by query_id order by position nulls last, rank) as place from shown s left join ord on lower(ord.dict) = s.dict where kind <> 'redirect' and list_contains(forms, form) and (given is null or {_KATA.format('reading')} = {_KATA.format('given')})"))
def matrix_lookup(t):
    """SEA-3: discovery, forms, availability, the best form's entries, ranks, the user's order."""
    asked, *tables = _tables(t)
    order = asked.sparkSession.createDataFrame([("D2", 1), ("d0", 2)], "dict string, position int")
    return lookup.matrix(asked, *tables, order)


@query(with_(_TABLES, query="select dict, count(*) as entries, any_value(a.n) as aliases, any_value(k.forms) as forms, any_value(k.readings) as readings from entries left join (select dict, count(*) as n from aliases group by 1) a using (dict) left join (select dict, count(distinct case when kind = 'form' then value end) as forms, count(distinct case when kind = 'reading' then value end) as readings from keys group by 1) k using (dict) group by dict"))
def dictionary_stats(t):
    """AGG-9: what each dictionary holds."""
    _, entries, keys, aliases = _tables(t)
    return dictionary.stats(entries, keys, aliases)


@query(with_(_TABLES, query="select dict, entry_id, array_to_string(list_sort(list(distinct value)), ' ') as feed from keys where kind = 'form' group by 1, 2"))
def search_feed(t):
    """AGG-10: the form keys of each entry in one string."""
    _, _, keys, _ = _tables(t)
    return dictionary.search_feed(keys)


@query(with_(_TABLES, query="select query_id, dict, entry_id from asked a join entries e on contains(e.headword, a.headword) where length(a.headword) >= 4"))
def trigram_search(t):
    """SEA-4: substring search through an inverted index of trigrams."""
    asked, entries, _, _ = _tables(t)
    return dictionary.substring_search(asked.select("query_id", F.col("headword").alias("wanted")).where(F.length("wanted") >= 4), entries)
