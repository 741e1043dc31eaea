"""Queries of libraries, orders and budgets, and of functions on dictionary and Markdown text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import scalars
from lexiflow.operators import library
from lexiflow.plans.lookups import HIRA, LATIN
from lexiflow.plans.readings import KANJI
from lexiflow.plans.registry import query
from lexiflow.plans.sql import LINES, TOKENS, with_
from lexiflow.sources import tables

_BOOKS = """old as (select substring(sha256(coalesce(text, '')), 1, 32) as book_id, min('t' || doc_id) as title, max(length(text) // 2)::bigint as total, max(doc_id % 50)::bigint as "offset", max(case when doc_id % 3 = 0 then doc_id end) as opened from documents where doc_id % 2 = 0 group by 1),
new as (select substring(sha256(coalesce(text, '')), 1, 32) as book_id, max({'title': 'n' || doc_id, 'total': length(text)::bigint}) as b from documents where doc_id % 4 <> 0 group by 1),
books as (select coalesce(o.book_id, n.book_id) as book_id, coalesce(b.title, o.title) as title, greatest(o.total, b.total) as total, coalesce("offset", 0) as "offset", opened from old o full outer join new n on n.book_id = o.book_id)"""


def _books(t) -> DataFrame:
    d = t("documents").withColumn("book_id", library.book_id(F.coalesce("text", F.lit(""))))
    old = d.where("doc_id % 2 = 0").groupBy("book_id").agg(F.min(F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("title"), F.max(F.floor(F.length("text") / 2)).alias("total"), F.max(F.col("doc_id") % 50).alias("offset"), F.max(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("opened"))
    new = d.where("doc_id % 4 <> 0").select("book_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("title"), F.length("text").cast("long").alias("total"))
    return library.upserted(old, new)


@query(with_(_BOOKS, query="select * from books"))
def library_upsert(t):
    """DML-8, SNK-9, SCL-11: books are added or renamed; lengths never fall, progress stays."""
    return _books(t)


_LOG = """l as (select book_id, event_id as number, case event_type when 'signup' then 'reset' when 'error' then 'remove' else 'progress' end as op, event_id * 3 as value from (select *, row_number() over (order by book_id) - 1 as k from books) b join events on event_id % 4000 = k where event_type <> 'error' or event_id % 7 = 0),
f as (select book_id, list_reduce(list({'op': op, 'value': value} order by number), lambda s, o: {'off': case o.op when 'progress' then o.value when 'reset' then 0 else s.off end, 'gone': s.gone or o.op = 'remove'}, {'off': -1::bigint, 'gone': false}) as s from l group by 1)"""


@query(with_(_BOOKS, _LOG, query='select book_id, title, total, case when s is null or s.off = -1 then "offset" else s.off end as "offset", round(case when total > 0 then least(case when s is null or s.off = -1 then "offset" else s.off end, total) / total else 0 end, 4) as progress, cast(ceil(greatest(total - case when s is null or s.off = -1 then "offset" else s.off end, 0) / 400.0) as bigint) as minutes from books left join f using (book_id) where s is null or not s.gone'))
def library_log(t):
    """DML-8, SCL-22, AGG-23: progress, resets and removals in their order; what is read, and minutes left."""
    from pyspark.sql import Window as W

    books = _books(t)
    # pairs books with events by place; only this test data needs one order over all books
    named = books.select("book_id", (F.row_number().over(W.orderBy("book_id")) - 1).alias("k"))
    events = t("events").where("event_type <> 'error' or event_id % 7 = 0").withColumn("k", F.col("event_id") % 4000)
    op = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "remove").otherwise("progress")
    log = named.join(events, "k").select("book_id", F.col("event_id").alias("number"), op.alias("op"), (F.col("event_id") * 3).alias("value"))
    rows = library.after_log(books, log)
    return rows.select("book_id", "title", "total", "offset", library.progress(F.col("offset"), F.col("total")).alias("progress"), library.minutes_left(F.col("offset"), F.col("total"), 400).alias("minutes"))


@query("select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by opened desc nulls last, c_acctbal desc nulls last, c_custkey) as place from customer left join (select o_custkey, max(o_orderdate) as opened from orders where o_orderkey % 3 = 0 group by 1) o on o_custkey = c_custkey")
def library_order(t):
    """SRT-9, SRC-21: the last opened first, those never opened last."""
    opened = t("orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("book_id")).agg(F.max("o_orderdate").alias("opened"))
    books = t("customer").select(F.col("c_custkey").alias("book_id"), "c_nationkey", F.col("c_acctbal").alias("created")).join(opened, "book_id", "left")
    return library.recent_first(books, ["c_nationkey"]).select(F.col("book_id").alias("c_custkey"), "c_nationkey", "place")


@query(with_(LINES, query="""select d.doc_id as book_id, coalesce(array_to_string(list_sort(t.tags), ','), '') as tags, coalesce(c.chapters, '') as chapters from documents d left join (select doc_id, list_filter([case when quality = 1 then 'good' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null) as tags from labels) t using (doc_id)
left join (select doc_id, string_agg(substring(line, 1, 9), '|' order by line_no) as chapters from lines where line_no % 4 = 1 group by 1) c using (doc_id)"""))
def library_parts(t):
    """JOIN-23: books with their tags and chapters."""
    tags = t("labels").select(F.col("doc_id").alias("book_id"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))).alias("tag"))
    chapters = tables.lines(t("documents")).where("line_no % 4 = 1").select(F.col("doc_id").alias("book_id"), F.col("line_no").alias("place"), F.substring("line", 1, 9).alias("title"))
    rows = library.with_parts(t("documents").select(F.col("doc_id").alias("book_id")), tags, chapters)
    return rows.select("book_id", F.array_join("tags", ",").alias("tags"), F.array_join("chapters", "|").alias("chapters"))


@query("""with r as (select lower(n) as key, min(id) as resource from (select n_name || '.png' as n, n_nationkey as id from nation) group by 1), i as (select s_suppkey, case s_suppkey % 4 when 0 then './NATION_' || s_nationkey || '.PNG' when 1 then chr(92) || 'Nation_' || s_nationkey || '.png' when 2 then '/nation_' || (s_nationkey + 20) || '.png' else 'img/x.png' end as src from supplier)
select s_suppkey, resource from i left join r on r.key = ltrim(lower(replace(src, chr(92), '/')), './')""")
def library_resources(t):
    """JOIN-24: image sources and resources, whatever the slashes and the case."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    src = F.when(k % 4 == 0, F.concat(F.lit("./NATION_"), n.cast("string"), F.lit(".PNG"))).when(k % 4 == 1, F.concat(F.lit("\\Nation_"), n.cast("string"), F.lit(".png"))).when(k % 4 == 2, F.concat(F.lit("/nation_"), (n + 20).cast("string"), F.lit(".png"))).otherwise("img/x.png")
    resources = t("nation").select(F.concat("n_name", F.lit(".png")).alias("path"), F.col("n_nationkey").alias("resource"))
    return library.with_resources(t("supplier").select("s_suppkey", src.alias("src")), resources, "src").select("s_suppkey", "resource")


@query("select c_custkey, cast(ceil(k / 20.0) as bigint) as page, cast(ceil(n / 20.0) as bigint) as pages from (select c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as k, count(*) over (partition by c_nationkey) as n from customer) x")
def page_batches(t):
    """SRT-8: pages of twenty and how many there are."""
    return library.paged(t("customer"), ["c_nationkey"], ["c_custkey"], 20).select("c_custkey", "page", "pages")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as k from events) x where k <= 3")
def newest_kept(t):
    """SNK-2, SRT-11: the newest results of a source stay."""
    return library.newest(t("events"), ["user_id"], "ts", "event_id", 3)[0].select("user_id", "event_id")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as k from events) x where k > 3")
def old_pruned(t):
    """SNK-2: the others go."""
    return library.newest(t("events"), ["user_id"], "ts", "event_id", 3)[1].select("user_id", "event_id")


@query("select conv_id, turn, role from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn, role) as p from conversations) x where p is null or p <> role")
def consecutive_removed(t):
    """WIN-9: blocks that repeat the one before go."""
    return library.without_repeats(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], "role")


@query("""with f as (select s_nationkey, list_reduce(list({'o': s_suppkey, 's': s_acctbal} order by s_suppkey), lambda a, x: {'sum': a.sum + case when x.s >= 0 and x.s <= 6000 and a.sum + x.s <= 20000 then x.s else 0 end, 'out': list_append(a.out, {'o': x.o, 's': x.s, 'taken': x.s >= 0 and x.s <= 6000 and a.sum + x.s <= 20000})}, {'sum': 0.0::double, 'out': cast([] as struct(o bigint, s double, taken boolean)[])}) as r from supplier group by 1)
select s_nationkey, x.o as s_suppkey, x.s as s_acctbal, x.taken as taken from (select s_nationkey, unnest(r.out) as x from f)""")
def size_budget(t):
    """SRC-11, WIN-10: what fits into a budget, in order; what doesn't is skipped."""
    return library.within_budget(t("supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal", 6000, 20000)


_STATUS = "case event_type when 'signup' then 'accepted' when 'error' then 'rejected' else 'pending' end"


@query(f"select user_id % 10 as origin, count(*) as n, count(*) filter (s = 'accepted') as accepted, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'rejected') as rejected, count(distinct event_id % 31) as rules from (select *, {_STATUS} as s from events) group by 1")
def distinct_rules(t):
    """AGG-8, AGG-12: occurrences by status and origin, and their different rules."""
    rows = t("events").select((F.col("user_id") % 10).alias("origin"), F.expr(_STATUS).alias("s"), (F.col("event_id") % 31).alias("rule"))
    return library.counters(rows, ["origin"], "s", "rule")


@query("select c_custkey, row_number() over (partition by c_nationkey order by md5('seed-7:' || c_custkey), c_custkey) as place from customer")
def seeded_order(t):
    """SCL-25: an order that a seed fixes."""
    return library.shuffled(t("customer"), ["c_nationkey"], "c_custkey", "seed-7").select("c_custkey", "place")


@query("select o_custkey, o_orderkey, o_orderpriority, array_to_string(list_sort(list_distinct([substring(o_orderpriority, 1, 1), o_orderstatus, 'N1'])), ',') as levels, sha256(concat(cast(o_custkey as varchar), ':', cast(o_orderkey as varchar), ':', o_orderpriority)) as id from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as k from orders) x where k = 1")
def export_entries(t):
    """SNK-3, SCL-11: the first entry of each key, its levels, and an id from its content."""
    rows = t("orders").withColumn("levels", F.array(F.substring("o_orderpriority", 1, 1), "o_orderstatus", F.lit("N1")))
    out = library.exported(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "levels", ["o_custkey", "o_orderkey", "o_orderpriority"])
    return out.select("o_custkey", "o_orderkey", "o_orderpriority", F.array_join("levels", ",").alias("levels"), "id")


@query("""with d as (select p_partkey, p_name, case p_partkey % 3 when 0 then '②～' || p_name || '―（note ' || p_partkey || '）' when 1 then '① plain ' else 'x（a）b' end as s from part)
select p_partkey, replace(replace(translate(trim(regexp_replace(s, '（[^（）]*）\\s*$', '')), '①②③', '123'), '～', p_name), '―', p_name) as definition, nullif(regexp_extract(s, '（([^（）]*)）\\s*$', 1), '') as note from d""")
def definition_cleanup(t):
    """PRJ-22: notes, placeholders and marks of definitions."""
    k = F.col("p_partkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("②～"), "p_name", F.lit("―（note "), k.cast("string"), F.lit("）"))).when(k % 3 == 1, "① plain ").otherwise("x（a）b")
    return t("part").select("p_partkey", scalars.cleaned_definition(s, F.col("p_name")).alias("definition"), scalars.definition_note(s).alias("note"))


@query(with_(TOKENS, query="select doc_id, pos, case pos % 4 when 0 then w || ' see ' || w || ' & \"x\"' when 1 then w || ' mono' when 2 then 'a ' || w || ' b' else w || ' < 1' end as shown from tok"))
def inline_markdown(t):
    """PRJ-30: text of inline Markdown."""
    from lexiflow.operators import text

    w, k = F.col("w"), F.col("pos")
    s = F.when(k % 4 == 0, F.concat(F.lit("**"), w, F.lit("** see [_"), w, F.lit("_](http://x) &amp; &quot;x&quot;"))).when(k % 4 == 1, F.concat(F.lit("<b>"), w, F.lit("</b> `mono`![i](y.png)"))).when(k % 4 == 2, F.concat(F.lit("[a **"), w, F.lit("** b](u)"))).otherwise(F.concat(w, F.lit(" &lt; 1 ")))
    return text.tokens(t("documents")).select("doc_id", "pos", scalars.plain_inline(s).alias("shown"))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'N' then 'surface' when l_quantity > 30 then 'unit' when l_tax > 0.04 then 'formation' when l_discount > 0.05 then 'head' else 'surface' end as target from lineitem")
def lookup_targets(t):
    """PRJ-31: what to look up for a token."""
    target = scalars.lookup_target(F.when(F.col("l_quantity") > 30, "unit"), F.when(F.col("l_tax") > 0.04, "formation"), F.when(F.col("l_discount") > 0.05, "head").otherwise(""), F.lit("surface"), F.col("l_returnflag") == "N")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", target.alias("target"))


_NAME = "split_part(p_name, ' ', 1)"


@query(f"""with h as (select p_partkey, translate({_NAME}, '{LATIN}', '{HIRA}') as kana, translate({_NAME}, '{LATIN}', '{KANJI}') as kanji from part)
select p_partkey, kana as reading, case p_partkey % 3 when 0 then kanji when 1 then kanji || '|' || kanji || '山' else kana end as forms from h""")
def headword_forms(t):
    """PRJ-32: readings and forms of headwords."""
    word, k = F.split("p_name", " ")[0], F.col("p_partkey")
    kana, kanji = F.translate(word, LATIN, HIRA), F.translate(word, LATIN, KANJI)
    head = F.when(k % 3 == 0, F.concat(kana, F.lit("【▽"), kanji, F.lit("】"))).when(k % 3 == 1, F.concat(kana, F.lit("【"), kanji, F.lit("・"), kanji, F.lit("山・"), kanji, F.lit("】"))).otherwise(kana)
    return t("part").select("p_partkey", scalars.headword_parts(head).alias("h")).select("p_partkey", "h.reading", F.array_join("h.forms", "|").alias("forms"))


@query(f"""with h as (select p_partkey, translate({_NAME}, '{LATIN}', '{HIRA}') as kana, translate({_NAME}, '{LATIN}', '{KANJI}') as kanji from part)
select p_partkey, case p_partkey % 4 when 0 then kanji || kana || 'る|' || kanji || 'る' when 1 then kanji || '|' || kanji || '山' when 2 then kanji || '・' || kana else kanji || '（x）' end as forms from h""")
def form_variants(t):
    """PRJ-33: alternatives and optional kana of a form."""
    word, k = F.split("p_name", " ")[0], F.col("p_partkey")
    kana, kanji = F.translate(word, LATIN, HIRA), F.translate(word, LATIN, KANJI)
    form = F.when(k % 4 == 0, F.concat(kanji, F.lit("（"), kana, F.lit("）る"))).when(k % 4 == 1, F.concat(kanji, F.lit("・"), kanji, F.lit("山"))).when(k % 4 == 2, F.concat(kanji, F.lit("・"), kana)).otherwise(F.concat(kanji, F.lit("（x）")))
    return t("part").select("p_partkey", F.array_join(scalars.expanded_form(form), "|").alias("forms"))


@query("""select event_id, case event_id % 4 when 0 then '第' || (event_id % 9 + 1) || '章はじまり' when 1 then 'Chapter ' || event_id || ': The End' when 2 then '山川 plain 山' else 'part of it' end as title, case event_id % 4 when 0 then '第' || (event_id % 9 + 1) || '章はじまり' when 1 then 'chapter' || event_id || 'theend' when 2 then '山川plain山' else 'partofit' end as key, event_id % 4 < 2 as chapter from events""")
def chapter_titles(t):
    """SCL-17: titles without stray spaces, their keys, and which ones count chapters."""
    k = F.col("event_id")
    title = F.when(k % 4 == 0, F.concat(F.lit("第"), (k % 9 + 1).cast("string"), F.lit("章　は じ ま り"))).when(k % 4 == 1, F.concat(F.lit("Chapter "), k.cast("string"), F.lit(": The End"))).when(k % 4 == 2, "山 川 plain 山").otherwise("part of it")
    return t("events").select("event_id", scalars.despaced_title(title).alias("title"), scalars.heading_key(title).alias("key"), scalars.is_chapter_title(title).alias("chapter"))


@query("select doc_id, regexp_matches(case when doc_id % 2 = 0 then substring(sha256(text), 1, 32) else substring(sha256(text), 1, 31) || 'G' end, '^[0-9a-f]{32}$') as sound, case doc_id % 3 when 0 then 'png' when 1 then null else 'jpeg' end as ending from documents")
def library_ids(t):
    """SCL-21: sound ids, and endings that are images."""
    k = F.col("doc_id")
    id_ = F.when(k % 2 == 0, library.book_id(F.col("text"))).otherwise(F.concat(F.substring(F.sha2("text", 256), 1, 31), F.lit("G")))
    path = F.when(k % 3 == 0, "a/b.PNG").when(k % 3 == 1, "c.exe").otherwise("d.x.jpeg")
    return t("documents").select("doc_id", library.is_book_id(id_).alias("sound"), library.extension(path).alias("ending"))


@query("select user_id, array_to_string(list_distinct_ordered, ',') as types from (select user_id, list_reduce(list(event_type order by event_id), lambda s, x: case when list_contains(s, x) then s else list_append(s, x) end, cast(['view'] as varchar[])) as list_distinct_ordered from events group by user_id)")
def merged_lists(t):
    """SET-7, SET-8: a configured order, then what else there is, each once."""
    rows = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("own"))
    return rows.select("user_id", F.array_join(scalars.merged_unique(F.array(F.lit("view")), F.col("own")), ",").alias("types"))


@query(with_(TOKENS, query="select doc_id, pos, start, row_number() over (partition by doc_id order by start) as place from tok"))
def token_order(t):
    """SRT-1: tokens by their place."""
    from pyspark.sql import Window as W

    from lexiflow.operators import text

    return text.tokens(t("documents")).select("doc_id", "pos", "start", F.row_number().over(W.partitionBy("doc_id").orderBy("start")).cast("long").alias("place"))
