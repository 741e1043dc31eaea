"""All queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiflow.functions import scalars
from lexiflow.operators import dictionary, grammar, html, intervals, matching, occurrences, quality, snapshots, text
from lexiflow.plans.registry import ORACLES, QUERIES, query
from lexiflow.plans.sql import LINES, PIECES, TOKENS, VOCABULARY, WORD, WORDS, with_
from lexiflow.sources import tables
from lexiflow.streaming import session

def vocabulary(t) -> DataFrame:
    return text.words(t("benchmark").withColumnRenamed("item_id", "doc_id")).select("w").distinct()


# text ---------------------------------------------------------------------------------------------------------------


@query(with_(PIECES, query='select doc_id, cast(i as bigint) as i, kind, start, "end", surface from placed'))
def segment_text(t):
    """PRJ-3, WIN-1: segments with offsets."""
    return text.segments(t("documents")).select("doc_id", "i", "kind", "start", "end", "surface")


@query(with_(PIECES, query='select doc_id, cast(count(*) as bigint) as n, cast(max("end") as bigint) as total, max("end") = any_value(length(text)) as whole from placed join documents using (doc_id) group by doc_id'))
def range_integrity(t):
    """QA-11: segments tile the text."""
    rows = text.segments(t("documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("total"))
    return rows.join(t("documents").select("doc_id", F.length("text").alias("l")), "doc_id").select("doc_id", "n", "total", (F.col("total") == F.col("l")).alias("whole"))


@query(with_(LINES, query="select doc_id, line_no, start, line from lines"))
def line_chunks(t):
    """STR-1: lines with offsets."""
    return tables.lines(t("documents"))


@query(with_(LINES, query="""select doc_id, cast(para as bigint) as para, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars from (
  select *, sum(fresh) over (partition by doc_id order by line_no) as para from (
    select *, case when trim(line) <> '' and (lag(line) over (partition by doc_id order by line_no) is null or trim(lag(line) over (partition by doc_id order by line_no)) = '') then 1 else 0 end as fresh from lines)) where trim(line) <> '' group by doc_id, para"""))
def paragraphs(t):
    """PRJ-28, WIN-8: runs of lines."""
    return text.paragraphs(t("documents"))


@query("""select doc_id, cast(i as bigint) as sent_no, s as sentence from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from (
  select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') as l from documents))""")
def sentence_split(t):
    """WIN-7, SCL-23: sentences."""
    return text.sentences(t("documents"))


@query("""select doc_id, cast(p as bigint) as "at", substring(text, greatest(p - 24, 1), p - greatest(p - 24, 1)) || '【the】' || substring(text, p + 3, 24) as shown from (select doc_id, text, unnest(list_filter(range(1, length(text) - 1), lambda i: substring(text, i, 3) = 'the')) as p from documents)""")
def sentence_context(t):
    """PRJ-25: each place of a word in context."""
    return text.context(t("documents"), "the", 24)


@query(with_(LINES, query="select doc_id, line_no, start, line from lines where line_no between 4 and 6"))
def paged_lines(t):
    """SRC-2, SRT-8: the second page of three lines."""
    return tables.line_page(t("documents"), 2, 3)


@query(with_(LINES, query="select doc_id, line_no, start, line from lines where (line_no - 1) % 3 = 0 and trim(line) <> ''"))
def sampled_lines(t):
    """SRC-4: every third line."""
    return tables.sampled_lines(t("documents"), 3)


@query("select doc_id, substring(text, 1, 100) as head, length(text) > 100 as truncated from documents")
def char_limit(t):
    """SRC-5, SCL-24: the first characters, and whether there are more; the limit is the feature."""
    return t("documents").select("doc_id", F.substring("text", 1, 100).alias("head"), (F.length("text") > 100).alias("truncated"))


_MIXED = "(select doc_id, case doc_id % 4 when 0 then substring(text, 1, 9) || '山川の水が流れるところ' when 1 then '漢字之文' || substring(text, 1, 2) when 2 then '한국어 글' else text end as s from documents)"


@query(f"""with c as (select doc_id, len(regexp_extract_all(s, '[㐀-䶿一-鿿]')) as han, len(regexp_extract_all(s, '[ぁ-ゟ゠-ヿ]')) as kana, len(regexp_extract_all(s, '[가-힯]')) as hangul, len(regexp_extract_all(s, '\\p{{L}}')) as letters from {_MIXED} m)
select doc_id, case when han + kana + hangul = 0 or 2 * (han + kana + hangul) < letters then 'und' when kana >= hangul and kana > 0 then 'ja' when hangul > 0 then 'ko' else 'zh' end as language, han::int as han, kana::int as kana, hangul::int as hangul from c""")
def cjk_detection(t):
    """PRJ-16: language by its letters, with the evidence; what isn't clear stays undetermined."""
    k = F.col("doc_id")
    mixed = F.when(k % 4 == 0, F.concat(F.substring("text", 1, 9), F.lit("山川の水が流れるところ"))).when(k % 4 == 1, F.concat(F.lit("漢字之文"), F.substring("text", 1, 2))).when(k % 4 == 2, "한국어 글").otherwise(F.col("text"))
    return t("documents").select("doc_id", scalars.cjk_evidence(mixed).alias("e")).select("doc_id", "e.*")


@query(with_(TOKENS, query="""select doc_id, pos, 't:' || start || ':' || "end" || ':' || w || ':' || (row_number() over (partition by doc_id, w order by pos) - 1) as token_id from tok"""))
def stable_token_ids(t):
    """WIN-5, SCL-11, INT-13: ids from places and ordinals."""
    k = F.row_number().over(W.partitionBy("doc_id", "w").orderBy("pos")) - 1
    return text.tokens(t("documents")).select("doc_id", "pos", F.concat(F.lit("t:"), F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "w", k.cast("string"))).alias("token_id"))


@query(with_(WORDS, query="select w, cast(row_number() over (order by w) as bigint) as code, n from (select w, count(*) as n from words group by w)"))
def string_interning(t):
    """SNK-11: a number for each string."""
    return dictionary.interned(dictionary.exposures(text.words(t("documents"))), "w", "code")


# profile and dictionary ---------------------------------------------------------------------------------------------

@query(with_(WORDS, query="select w, count(*) as n from words group by w"))
def token_exposure(t):
    """AGG-1: exposures of all documents."""
    return dictionary.exposures(text.words(t("documents")))


def _half(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.col(doc_id), F.lit(2)), F.lit(0))


@query(with_(WORDS, query="select w, count(*) as n from words group by w"))
def exposure_upsert(t):
    """DML-1: two parts of the corpus counted apart and merged; equal to counting the whole."""
    return dictionary.upserted(*(dictionary.exposures(text.words(t("documents").where(_half() == k))) for k in (0, 1)))


def _known_rate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.round(F.col("novelty") * 1000000).cast("long")).alias("millionths"), F.round(F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)) / F.sum("times"), 6).alias("known_rate"))


_WHOLE = """own as (select doc_id, coalesce(abs(doc_id) % 2, 0) as half, w, count(*) as times from words group by doc_id, w), prof as (select half, w, sum(times) as n from own group by half, w),
nov as (select doc_id, own.w as w, times, round(0.5 + 0.5 * exp(-coalesce(n, 0) / 5.0), 6) as novelty from own left join prof on prof.w = own.w and prof.half = 1 - own.half)"""


def _novelty_of_all(t) -> DataFrame:
    a, b = (text.words(t("documents").where(_half() == k)) for k in (0, 1))
    return dictionary.novelty(b, dictionary.exposures(a)).unionByName(dictionary.novelty(a, dictionary.exposures(b)))


@query(with_(WORDS, _WHOLE, query="select doc_id, w, times, novelty, novelty < 0.55 as known from nov"))
def novelty_score(t):
    """JOIN-10, SCL-9: novelty of each word of every document, each half of the corpus against the other's exposures."""
    return _novelty_of_all(t)


@query(with_(WORDS, _WHOLE, query="select doc_id, count(*) as n_words, cast(sum(round(novelty * 1000000)) as bigint) as millionths, round(sum(case when novelty < 0.55 then times else 0 end) / sum(times), 6) as known_rate from nov group by doc_id"))
def novelty_by_doc(t):
    """JOIN-10, AGG-2: known rate of every document, each half of the corpus against the other's exposures."""
    return _known_rate(_novelty_of_all(t))


@query("""select user_id, round(list_reduce(list(case when event_type = 'signup' then 0.8 else -0.2 end::double order by ts, event_id), lambda s, x: case when x > 0 then least(1.0::double, s + x) else greatest(0.0::double, s + x) end, 0.0::double), 6) as confidence from events where event_type in ('signup', 'error') group by user_id""")
def profile_event_fold(t):
    """DML-2, DML-3, STR-8: ordered fold of events."""
    return dictionary.fold_confidence(t("events"), "signup", "error")


@query(with_(WORDS, VOCABULARY, query="select doc_id, count(*) as n from words where w in (select w from vocab) group by doc_id"))
def dict_exact_semi(t):
    """JOIN-1: words that are entries."""
    return text.words(t("documents")).join(vocabulary(t), "w", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(with_(WORDS, f"refs as (select w, min(item_id) as first_item, count(distinct item_id) as items from (select item_id, lower(unnest(regexp_extract_all(text, '{WORD}+'))) as w from benchmark) group by w)", query="select doc_id, w, first_item, items from (select distinct doc_id, w from words) join refs using (w)"))
def dict_refs(t):
    """JOIN-2, JOIN-3: entries of a document's words, aggregated before they're joined."""
    entries = text.words(t("benchmark").withColumnRenamed("item_id", "doc_id"))
    refs = entries.groupBy("w").agg(F.min("doc_id").alias("first_item"), F.count_distinct("doc_id").alias("items"))
    return text.words(t("documents")).distinct().join(refs, "w").select("doc_id", "w", "first_item", "items")


_PLAIN = f"translate(w, '{dictionary.ACCENTED}', '{dictionary.PLAIN}')"


@query(with_(WORDS, VOCABULARY, "q as (select distinct w from words)", f"s2 as (select {_PLAIN} as k, min(w) as m from vocab group by 1)", "s3 as (select substring(w, 1, 5) as k, min(w) as m from vocab where length(w) >= 5 group by 1)", query=f"""select q.w, cast(case when v.w is not null then 1 when s2.m is not null then 2 when s3.m is not null then 3 else 4 end as bigint) as stage, coalesce(v.w, s2.m, s3.m) as target
from q left join vocab v on v.w = q.w left join s2 on s2.k = {_PLAIN.replace('(w', '(q.w')} left join s3 on length(q.w) >= 5 and s3.k = substring(q.w, 1, 5)"""))
def dict_cascade_lookup(t):
    """JOIN-4 to JOIN-8, SRT-7: staged lookup."""
    return dictionary.cascade(text.words(t("documents")).select("w").distinct(), vocabulary(t))


@query(with_(WORDS, VOCABULARY, query="select count(*) as n, cast(sum(case when v.w is null then 0 else 1 end) as bigint) as matched, round(coalesce(sum(case when v.w is null then 0 else 1 end) / nullif(count(*), 0), 1.0), 6) as coverage from words left join vocab v using (w)"))
def coverage_audit(t):
    """AGG-2: coverage, 1 where there's nothing to cover."""
    rows = dictionary.exposures(text.words(t("documents"))).join(vocabulary(t).withColumn("v", F.lit(1)), "w", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v") == 1, F.col("n")).otherwise(0)), F.lit(0)).alias("matched")).withColumn("coverage", F.round(F.coalesce(F.try_divide("matched", "n"), F.lit(1.0)), 6))


@query(with_(VOCABULARY, f"s as (select doc_id, unnest(regexp_extract_all(text, '{WORD}+')) as surface from documents)", query="select lower(surface) as w, count(*) as n, array_to_string(list_sort(list(distinct surface)), ' ') as surfaces from s where lower(surface) not in (select w from vocab) group by 1 order by n desc, w limit 100"))
def missed_lexemes(t):
    """AGG-3: the most frequent misses with their surfaces."""
    s = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD}+)"), 1)).alias("surface")).groupBy("surface").agg(F.count("*").alias("k"))
    missed = s.withColumn("w", F.lower("surface")).join(vocabulary(t), "w", "left_anti")
    return missed.groupBy("w").agg(F.sum("k").alias("n"), F.array_join(F.array_sort(F.collect_set("surface")), " ").alias("surfaces")).orderBy(F.desc("n"), "w").limit(100)


@query(with_(WORDS, VOCABULARY, query="select substring(w, 1, 1) as initial, cast(length(w) as bigint) as len, cast(sum(n) as bigint) as occurrences, count(*) as words, array_to_string(list_slice(list_sort(list(w)), 1, 4), ' ') as samples from (select w, count(*) as n from words where w not in (select w from vocab) group by w) group by 1, 2"))
def residual_groups(t):
    """SEQ-17, AGG-5: residuals by group with the first four of each. Ranks bound what a group keeps."""
    rows = dictionary.exposures(text.words(t("documents")).join(vocabulary(t), "w", "left_anti"))
    rows = rows.withColumns({"initial": F.substring("w", 1, 1), "len": F.length("w").cast("long")})
    sums = rows.groupBy("initial", "len").agg(F.sum("n").alias("occurrences"), F.count("*").alias("words"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("initial", "len").orderBy("w"))).where("k <= 4").groupBy("initial", "len").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("samples"))
    return sums.join(first, ["initial", "len"])


@query(with_(LINES, query="""select doc_id, line_no, cast(3 * (case when regexp_matches(line, '[0-9]') then 1 else 0 end) + 5 * coalesce(toxic, 0) + (case when line like '%!!%' then 4 else 0 end) as bigint) as issue_score from lines left join labels using (doc_id)"""))
def line_issue_score(t):
    """AGG-6, SRT-12: weighted issues of each line."""
    rows = tables.lines(t("documents")).join(t("labels"), "doc_id", "left")
    score = 3 * F.col("line").rlike("[0-9]").cast("int") + 5 * F.coalesce("toxic", F.lit(0)) + 4 * F.col("line").contains("!!").cast("int")
    return rows.select("doc_id", "line_no", score.cast("long").alias("issue_score"))


# patterns -----------------------------------------------------------------------------------------------------------

_AHEAD = "a as (select *, lead(w, 1) over p as w1, lead(w, 2) over p as w2, lead(w, 3) over p as w3 from tok window p as (partition by doc_id, sent order by pos))"


@query(with_(TOKENS, _AHEAD, query="""select doc_id, 'of_the' as rule_id, pos as start_pos, 2::bigint as width, w || ' ' || w1 as surface from a where w = 'of' and w1 = 'the'
union all select doc_id, 'prep_art', pos, 2, w || ' ' || w1 from a where w in ('in', 'for', 'with') and w1 in ('the', 'a')
union all select doc_id, 'the_any_of', pos, 3, w || ' ' || w1 || ' ' || w2 from a where w = 'the' and w1 is not null and w2 = 'of'"""))
def contiguous_pattern(t):
    """SEQ-10: rules over adjacent words."""
    a = matching.atom
    rules = [matching.Rule("of_the", (a("of"), a("the"))), matching.Rule("prep_art", (a("in for with"), a("the a"))), matching.Rule("the_any_of", (a("the"), a(None), a("of")))]
    return matching.matches(t("documents"), rules).drop("captures")


@query(with_(TOKENS, _AHEAD, query="""select doc_id, 'the_of' as rule_id, pos as start_pos, 2::bigint as width, w || ' ' || w1 as surface from a where w in ('the', 'and') and w1 = 'of'
union all select doc_id, 'the_of', pos, 3, w || ' ' || w1 || ' ' || w2 from a where w in ('the', 'and') and w1 in ('the', 'and') and w2 = 'of'
union all select doc_id, 'the_of', pos, 4, w || ' ' || w1 || ' ' || w2 || ' ' || w3 from a where w in ('the', 'and') and w1 in ('the', 'and') and w2 in ('the', 'and') and w3 = 'of'"""))
def repeat_pattern(t):
    """SEQ-5: bounded repetition, every count that fits."""
    return matching.matches(t("documents"), [matching.Rule("the_of", (matching.atom("the and", 1, 3), matching.atom("of")))]).drop("captures")


@query(with_(TOKENS, _AHEAD, query="""select doc_id, 'to_the_of' as rule_id, pos as start_pos, 2::bigint as width, w || ' ' || w1 as surface from a where w = 'to' and w1 in ('of', 'and')
union all select doc_id, 'to_the_of', pos, 3, w || ' ' || w1 || ' ' || w2 from a where w = 'to' and w1 = 'the' and w2 in ('of', 'and')"""))
def optional_atom_pattern(t):
    """SEQ-7: an optional atom."""
    return matching.matches(t("documents"), [matching.Rule("to_the_of", (matching.atom("to"), matching.atom("the", 0, 1), matching.atom("of and")))]).drop("captures")


@query(with_(TOKENS, query="select h.doc_id, h.pos as head_pos, min(x.pos) as tail_pos from tok h join tok x on x.doc_id = h.doc_id and x.sent = h.sent and x.w = 'and' and x.pos between h.pos + 3 and h.pos + 7 where h.w = 'the' group by h.doc_id, h.pos"))
def gap_pattern_nearest(t):
    """SEQ-11, JOIN-16: the nearest tail in a gap."""
    return matching.nearest(t("documents"), frozenset(["the"]), frozenset(["and"]), 2, 6)


@query("select u.conv_id, u.turn as user_turn, min(a.turn) as answer_turn from conversations u join conversations a on a.conv_id = u.conv_id and a.role = 'assistant' and a.turn > u.turn where u.role = 'user' group by u.conv_id, u.turn")
def conversation_followup(t):
    """JOIN-16: the next answer to each user turn."""
    rows = t("conversations").groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))
    w = W.partitionBy("conv_id").orderBy("turn").rangeBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("answer_turn", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w))
    return rows.where("role = 'user' and answer_turn is not null").select("conv_id", F.col("turn").alias("user_turn"), "answer_turn")


def _grams(t) -> DataFrame:
    return matching.grams(t("benchmark").withColumnRenamed("item_id", "doc_id"), 2)


_GRAMS = TOKENS.replace("documents", "(select item_id as doc_id, text from benchmark) b").replace("pieces", "bpieces").replace("placed", "bplaced").replace("tok as", "btok as") + ", grams as (select distinct w || ' ' || nxt as gram from (select w, lead(w) over (partition by doc_id, sent order by pos) as nxt from btok) where nxt is not null)"


@query(with_(TOKENS, _AHEAD, _GRAMS, query="select doc_id, pos, w || ' ' || w1 as gram from a where w1 is not null and w || ' ' || w1 in (select gram from grams)"))
def ngram_dictionary_windows(t):
    """SEQ-14, SEQ-6: windows of two words that are entries."""
    return matching.windows(t("documents"), _grams(t), 2)


_GRAMS3 = ", ".join([_GRAMS, "grams3 as (select distinct w || ' ' || n1 || ' ' || n2 as gram from (select w, lead(w) over x as n1, lead(w, 2) over x as n2 from btok window x as (partition by doc_id, sent order by pos)) where n2 is not null)"])


@query(with_(TOKENS, _AHEAD, _GRAMS3, "h3 as (select doc_id, pos, w || ' ' || w1 || ' ' || w2 as gram from a where w2 is not null and w || ' ' || w1 || ' ' || w2 in (select gram from grams3))", "h2 as (select doc_id, pos, w || ' ' || w1 as gram from a where w1 is not null and w || ' ' || w1 in (select gram from grams))", query="select * from h3 union all select * from h2 where not exists (select 1 from h3 where h3.doc_id = h2.doc_id and h3.pos in (h2.pos, h2.pos - 1))"))
def dictionary_windows_claimed(t):
    """SEQ-14, INT-3: longer windows first, none within one that is taken."""
    bench = t("benchmark").withColumnRenamed("item_id", "doc_id")
    entries = matching.grams(bench, 3).unionByName(matching.grams(bench, 2))
    return matching.windows(t("documents"), entries, 3, claim=True)


@query(with_(TOKENS, _AHEAD, query="""select doc_id, pos as start_pos, 3::bigint as width, w1 as taken from a where w = 'the' and w1 is not null and w2 = 'of' union all select doc_id, pos, 4, w1 || ' ' || w2 from a where w = 'the' and w1 is not null and w2 is not null and w3 = 'of'"""))
def rule_captures(t):
    """SEQ-5: what the atoms of a rule take."""
    rule = matching.Rule("the_x_of", (matching.atom("the"), matching.atom(None, 1, 2, "x"), matching.atom("of")))
    return matching.matches(t("documents"), [rule]).select("doc_id", "start_pos", "width", F.col("captures")[0]["value"].alias("taken"))


_SKIP = "('the', 'a', 'of')"


@query(with_(TOKENS, _AHEAD, query=f"""select doc_id, pos as start_pos, case when w1 = 'and' then 2 when w2 = 'and' then 3 else 4 end::bigint as width from a where w = 'to' and (w1 = 'and' or w1 in {_SKIP} and w2 = 'and' or w1 in {_SKIP} and w2 in {_SKIP} and w3 = 'and')"""))
def intervening_particles(t):
    """SEQ-7: up to two particles may stand between the atoms."""
    rule = matching.Rule("to_and", (matching.atom("to"), matching.atom("and")), frozenset(["the", "a", "of"]), 2)
    return matching.matches(t("documents"), [rule]).select("doc_id", "start_pos", "width")


_CONTENT = "c as (select doc_id, pos, sent, w, lead(w) over p as w1, lead(pos) over p as pos1 from tok where length(w) >= 4 window p as (partition by doc_id, sent order by pos))"


@query(with_(TOKENS, _CONTENT, _GRAMS, "pairs as (select distinct w || ' ' || w1 as gram from (select w, lead(w) over (partition by doc_id, sent order by pos) as w1 from btok where length(w) >= 4) where w1 is not null)", query="select doc_id, pos as start_pos, pos1 - pos + 1 as width, w || ' ' || w1 as surface from c where w1 is not null and w || ' ' || w1 in (select gram from pairs)"))
def user_expressions(t):
    """SEQ-12: rules of a table over content words, others between them aren't seen."""
    pairs = matching.grams(t("benchmark").withColumnRenamed("item_id", "doc_id"), 2, 4)
    word = lambda k: F.create_map(F.lit("words"), F.array(F.split("gram", " ")[k]))
    table = pairs.select(F.sha2("gram", 256).alias("rule_id"), F.to_json(F.struct(F.array(word(0), word(1)).alias("atoms"))).alias("pattern"))
    return matching.matches(t("documents"), matching.rules_of(table), content=4).select("doc_id", "start_pos", "width", "surface")


@query(with_(TOKENS, "c as (select *, row_number() over (partition by doc_id order by pos) as k from tok where length(w) >= 4)", query="select h.doc_id, h.pos as head_pos, min(x.pos) as tail_pos from c h join c x on x.doc_id = h.doc_id and x.sent = h.sent and x.w in ('with', 'from') and x.k between h.k + 1 and h.k + 6 where h.w in ('that', 'this') group by h.doc_id, h.pos"))
def user_gap_rules(t):
    """SEQ-13: heads and tails with up to five content words between, in one sentence."""
    return matching.nearest(t("documents"), frozenset(["that", "this"]), frozenset(["with", "from"]), 0, 5, content=4)


@query(with_(TOKENS, _AHEAD, query="""select doc_id, pos + k as pos, case k when 0 then 'start' when 2 then 'end' else 'middle' end as position from a, unnest([0, 1, 2]) as u(k) where w = 'the' and w1 is not null and w2 = 'of' union all select doc_id, pos, 'single' from a where w = 'because'"""))
def expression_positions(t):
    """PRJ-24: the place of each word in its expression."""
    a = matching.atom
    rules = [matching.Rule("the_x_of", (a("the"), a(None), a("of"))), matching.Rule("because", (a("because"),))]
    return matching.positions(matching.matches(t("documents"), rules)).select("doc_id", "pos", "position")


@query(with_(TOKENS, "z as (select *, max(case when length(w) >= 9 then pos end) over (partition by doc_id, sent) as last_long, lead(w) over (partition by doc_id, sent order by pos) as w1 from tok)", query="select doc_id, pos as start_pos from z where w = 'in' and w1 = 'the' and last_long > pos + 1"))
def following_content(t):
    """SEQ-10, SEQ-15: expressions that content must follow before the sentence ends."""
    return matching.matches(t("documents"), [matching.Rule("in_the", (matching.atom("in"), matching.atom("the")), follow=9)]).select("doc_id", "start_pos")


@query(with_(TOKENS, _AHEAD, query="""select doc_id, pos as start_pos, case when w2 = 'and' then 3 else 2 end::bigint as width from a where w = 'of' and w1 = 'the'"""))
def longest_merge_rule(t):
    """SEQ-16, DML-7: of merge rules that begin at one word, the longest."""
    a = matching.atom
    rules = [matching.Rule("of_the", (a("of"), a("the"))), matching.Rule("of_the_and", (a("of"), a("the"), a("and")))]
    return matching.longest(matching.matches(t("documents"), rules)).select("doc_id", "start_pos", "width")


@query(with_(TOKENS, _AHEAD, query="select doc_id, case when w1 is null then 'no_follower' when w1 in ('of', 'and') then 'rejected' else 'accepted' end as status, count(*) as n from a where w = 'the' group by 1, 2"))
def negative_context_reject(t):
    """SEQ-15, WIN-4, AGG-8: candidates rejected by what follows."""
    nxt = F.lead("w").over(W.partitionBy("doc_id", "sent").orderBy("pos"))
    rows = text.tokens(t("documents")).select("doc_id", "w", nxt.alias("w1")).where("w = 'the'")
    status = F.when(F.col("w1").isNull(), "no_follower").when(F.col("w1").isin("of", "and"), "rejected").otherwise("accepted")
    return rows.groupBy("doc_id", status.alias("status")).agg(F.count("*").alias("n"))


# intervals ----------------------------------------------------------------------------------------------------------


def _ranges(t) -> DataFrame:
    """Ranges around long words: id is their place."""
    rows = text.tokens(t("documents"), 9)
    return rows.select("doc_id", "sent", F.greatest(F.col("start") - F.length("w"), F.lit(0)).alias("start"), (F.col("end") + F.pmod("pos", F.lit(7)) * 3).alias("end"), F.col("pos").alias("id"))


_RANGES = 'r as (select doc_id, sent, greatest(start - length(w), 0) as start, "end" + (pos % 7) * 3 as "end", pos as id from tok where length(w) >= 9)'


@query(with_(TOKENS, _RANGES, query="""select doc_id, min(start) as start, max("end") as "end", count(*) as parts from (select *, sum(fresh) over (partition by doc_id order by start, "end" rows unbounded preceding) as island from (
  select *, case when start > coalesce(max("end") over (partition by doc_id order by start, "end" rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as fresh from r)) group by doc_id, island"""))
def range_merge(t):
    """INT-10: merged ranges."""
    return intervals.merged(_ranges(t), ["doc_id"])


@query(with_(TOKENS, _RANGES, query='select doc_id, id, start, "end" from r where not exists (select 1 from r o where o.doc_id = r.doc_id and o.id <> r.id and o.start <= r.start and o."end" >= r."end" and (o.start < r.start or o."end" > r."end" or o.id < r.id))'))
def range_containment_drop(t):
    """INT-4: ranges that lie in no other."""
    return intervals.not_contained(_ranges(t), ["doc_id"]).select("doc_id", "id", "start", "end")


@query(with_(TOKENS, _RANGES, query='select doc_id, id, exists (select 1 from r o where o.doc_id = r.doc_id and o.id <> r.id and o.start < r."end" and o."end" > r.start) as overlaps from r'))
def range_overlap_flag(t):
    """JOIN-15, INT-11: whether a range overlaps another."""
    return intervals.overlap_flags(_ranges(t), ["doc_id"]).select("doc_id", "id", "overlaps")


@query(with_(TOKENS, query="""select doc_id, sent, w, pos, rn as rank from (select *, row_number() over (partition by doc_id, sent order by length(w) desc, "end" - start desc, pos) as rn from tok) where rn <= 2"""))
def conflict_resolve(t):
    """INT-9, SRT-6: the best two candidates of each sentence."""
    w = W.partitionBy("doc_id", "sent").orderBy(F.desc(F.length("w")), F.desc(F.col("end") - F.col("start")), "pos")
    return text.tokens(t("documents")).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2").select("doc_id", "sent", "w", "pos", "rank")


def _candidates(t) -> DataFrame:
    return _ranges(t).select("doc_id", "sent", "start", "end", F.pmod("id", F.lit(5)).alias("priority"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"))


@query()
def greedy_claim(t):
    """INT-1, INT-3: greedy claim of places, sentence by sentence."""
    return intervals.greedy_claim(_candidates(t), ["doc_id", "sent"])


@query()
def weighted_interval(t):
    """INT-2: the heaviest disjoint set, sentence by sentence."""
    return intervals.weighted_schedule(_candidates(t), ["doc_id", "sent"])


@query()
def best_path_segmentation(t):
    """INT-5: best cut of each sentence into spans."""
    return intervals.best_path(text.tokens(t("documents")), 2, _grams(t))


@query(with_(TOKENS, LINES, query="select t.doc_id, l.line_no, count(*) as n, min(t.start - l.start) as first_column from tok t join lines l on l.doc_id = t.doc_id and t.start >= l.start and t.start < l.start + length(l.line) + 1 group by 1, 2"))
def point_in_range_join(t):
    """JOIN-13, JOIN-14, INT-12: tokens to the lines that hold them; a token carries its line, so no ranges are joined."""
    rows = text.tokens(t("documents")).groupBy("doc_id", F.col("line").alias("line"))
    return rows.agg(F.count("*").alias("n"), F.min("column").alias("first_column")).select("doc_id", (F.col("line") + 1).alias("line_no"), "n", "first_column")


@query(with_(TOKENS, LINES, "d as (select t.doc_id, l.line_no, t.pos from tok t join lines l on l.doc_id = t.doc_id and t.start >= l.start and t.start < l.start + length(l.line) + 1 where length(t.w) >= 9)", query="select doc_id, pos, line_no from d"))
def points_to_ranges(t):
    """JOIN-14, INT-12: any points to the ranges that hold them; ranges and points go through one sorted pass."""
    docs = t("documents")
    lines = tables.lines(docs).select("doc_id", "start", "line_no")
    return intervals.located(text.tokens(docs, 9).select("doc_id", F.col("start").alias("at"), "pos"), lines, ["doc_id"], "line_no").select("doc_id", "pos", "line_no")


# snapshots ----------------------------------------------------------------------------------------------------------

_BEFORE = "before as (select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice from orders where o_orderkey % 101 <> 0)"
_AFTER = "after as (select o_orderkey, case when o_orderkey % 17 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority, case when o_orderkey % 23 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 103 <> 0)"
_CHANGES = """changes as (select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, coalesce(b.o_orderpriority, a.o_orderpriority) as stage, b.o_orderstatus as s0, a.o_orderstatus as s1,
  case when b.o_orderkey is null then 'added' when a.o_orderkey is null then 'removed' when b.o_orderstatus <> a.o_orderstatus or b.o_totalprice <> a.o_totalprice then 'modified' else 'stable' end as operation,
  case when b.o_orderkey is null or a.o_orderkey is null then '' else concat_ws(',', case when b.o_orderstatus <> a.o_orderstatus then 'o_orderstatus' end, case when b.o_totalprice <> a.o_totalprice then 'o_totalprice' end) end as changed
  from before b full outer join after a on a.o_orderkey = b.o_orderkey)"""


def _snapshots(t) -> tuple[DataFrame, DataFrame]:
    orders, k = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), F.col("o_orderkey")
    after = orders.where(k % 103 != 0).withColumns({"o_orderstatus": F.when(k % 17 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 23 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return orders.where(k % 101 != 0), after


def _changes(t) -> DataFrame:
    before, after = _snapshots(t)
    rows = snapshots.diff(before, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return rows.join(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("stage")), "o_orderkey")


@query(with_(_BEFORE, _AFTER, _CHANGES, query="select o_orderkey, operation, changed from changes"))
def snapshot_full_outer_diff(t):
    """JOIN-19, SCL-13: keyed changes and their fields."""
    return _changes(t).select("o_orderkey", "operation", "changed")


@query(with_(_BEFORE, _AFTER, _CHANGES, query="""select stage, n, changed, round(p, 8) as rate, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 8) as low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 8) as high
from (select stage, count(*) as n, cast(sum(case when operation <> 'stable' then 1 else 0 end) as bigint) as changed, sum(case when operation <> 'stable' then 1 else 0 end) / count(*) as p, 1.959963984540054::double as z from changes group by stage)"""))
def stage_churn_wilson(t):
    """AGG-13, AGG-14: churn of each stage with its interval."""
    return snapshots.churn(_changes(t), "stage")


@query(with_(_BEFORE, _AFTER, _CHANGES, query="select coalesce(s0, '-') as before, coalesce(s1, '-') as after, count(*) as n from changes group by 1, 2"))
def status_transitions(t):
    """AGG-13: the transition matrix."""
    before, after = (df.select("o_orderkey", F.col("o_orderstatus").alias(n)) for df, n in zip(_snapshots(t), ("b", "a")))
    return before.join(after, "o_orderkey", "full_outer").groupBy(F.coalesce("b", F.lit("-")).alias("before"), F.coalesce("a", F.lit("-")).alias("after")).agg(F.count("*").alias("n"))


@query(with_(_BEFORE, _AFTER, _CHANGES, query="select coalesce(stage, 'all') as stage, coalesce(operation, 'all') as operation, count(*) as n from changes group by rollup (stage, operation)"))
def severity_rollup(t):
    """AGG-15: totals by stage and operation."""
    return _changes(t).rollup("stage", "operation").agg(F.count("*").alias("n")).select(F.coalesce("stage", F.lit("all")).alias("stage"), F.coalesce("operation", F.lit("all")).alias("operation"), "n")


@query(with_(_BEFORE, _AFTER, _CHANGES, query="select unnest(string_split(changed, ',')) as field, count(*) as n from changes where changed <> '' group by 1"))
def field_histogram(t):
    """AGG-17: how often each field differs."""
    return _changes(t).where("changed <> ''").select(F.explode(F.split("changed", ",")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query(with_(_BEFORE, _AFTER, query="select 'added' as kind, count(*) as n from (select o_orderkey from after except select o_orderkey from before) union all select 'removed', count(*) from (select o_orderkey from before except select o_orderkey from after) union all select 'kept', count(*) from (select o_orderkey from before intersect select o_orderkey from after)"))
def snapshot_set_compare(t):
    """SET-3: added, removed and kept keys."""
    b, a = (df.select("o_orderkey") for df in _snapshots(t))
    parts = {"added": a.subtract(b), "removed": b.subtract(a), "kept": a.intersect(b)}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""with k as (select l_orderkey, list_sort(list(l_returnflag || l_linestatus)) as a, list_sort(list(case when l_orderkey % 13 = 0 and l_linenumber = 1 then 'Z' else l_returnflag end || l_linestatus)) as b from lineitem group by l_orderkey) select l_orderkey from k where a <> b""")
def changed_keys(t):
    """SET-5: keys whose multisets differ, whatever their order."""
    flag = F.when((F.col("l_orderkey") % 13 == 0) & (F.col("l_linenumber") == 1), "Z").otherwise(F.col("l_returnflag"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat("l_returnflag", "l_linestatus"))).alias("a"), F.array_sort(F.collect_list(F.concat(flag, "l_linestatus"))).alias("b"))
    return rows.where("a <> b").select("l_orderkey")


_TURNS = "n as (select conv_id || '#' || turn as node, conv_id, row_number() over (partition by conv_id order by turn) as k from (select distinct conv_id, turn from conversations))"


def _replies(t) -> DataFrame:
    """(child, parent): each turn of a conversation and the one before it."""
    node = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    w = W.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn").distinct().select(node.alias("child"), F.lag(node).over(w).alias("parent"))


@query(with_(_TURNS, query="select c.node as child, p.node as ancestor, cast(c.k - p.k as bigint) as distance from n c join n p on p.conv_id = c.conv_id and p.k < c.k"))
def causal_parents(t):
    """JOIN-18, JOIN-21: all causes of each turn, by transitive closure."""
    return snapshots.closure(_replies(t))


@query(with_(_TURNS, query="select node as root, cast(max(k) over (partition by conv_id) - k as bigint) as affected, cast(max(k) over (partition by conv_id) - k as bigint) as depth from n qualify max(k) over (partition by conv_id) > k"))
def root_impacts(t):
    """AGG-16: what each cause affects, and how far."""
    return snapshots.impacts(snapshots.closure(_replies(t)))


@query(with_(_BEFORE, _AFTER, _CHANGES, query="""select rule, value > most as violated, case when value > most and blocking then 'blocked' when value > most then 'review_required' else 'passed' end as verdict from (
  select 'churn' as rule, round(avg(case when operation <> 'stable' then 1.0 else 0.0 end), 8) as value, 0.05 as most, true as blocking from changes
  union all select 'removed', cast(sum(case when operation = 'removed' then 1 else 0 end) as double), 1000000.0, true from changes
  union all select 'added', cast(sum(case when operation = 'added' then 1 else 0 end) as double), 0.0, false from changes)"""))
def gate_evaluation(t):
    """QA-9: rules over metrics, blocking ones first."""
    c = _changes(t).agg(F.round(F.avg((F.col("operation") != "stable").cast("double")), 8).alias("churn"), F.sum((F.col("operation") == "removed").cast("double")).alias("removed"), F.sum((F.col("operation") == "added").cast("double")).alias("added"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"), F.lit(m).alias("most"), F.lit(b).alias("blocking")) for r, m, b in (("churn", 0.05, True), ("removed", 1e6, True), ("added", 0.0, False))])
    rows = c.select(F.explode(rules).alias("r")).select("r.*").withColumn("violated", F.col("value") > F.col("most"))
    return rows.select("rule", "violated", F.when(~F.col("violated"), "passed").when(F.col("blocking"), "blocked").otherwise("review_required").alias("verdict"))


# pages --------------------------------------------------------------------------------------------------------------


@query("select tag, cast(sum(k) as bigint) as n, count(*) as pages from (select page_id, lower(tag) as tag, count(*) as k from (select page_id, unnest(regexp_extract_all(html, '<\\s*/?\\s*([a-zA-Z][A-Za-z0-9_:-]*)', 1)) as tag from pages) group by 1, 2) group by tag")
def html_tag_census(t):
    """AGG-18: tags and pages."""
    return html.tag_census(t("pages"))


@query("""select page_id, target, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as target from pages) group by 1, 2""")
def html_links(t):
    """PRJ-20: distinct links."""
    return html.links(t("pages"))


@query()
def html_text(t):
    """PRJ-17, PRJ-19: visible text."""
    return html.page_text(t("pages"))


@query()
def html_sanitize(t):
    """PRJ-18: whitelisted HTML."""
    return t("pages").select("page_id", html.sanitized("html").alias("clean"))


_INNER = "regexp_replace(replace(replace(replace(trim(regexp_replace(regexp_replace({}, '<[^<>]*>', '', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;?', '&', 'g')"


@query(f"""select page_id, {_INNER.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as header, len(regexp_extract_all(html, '<li>')) as items, len(regexp_extract_all(html, '(?s)<div class="ad">')) as sections, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) as links from pages""")
def page_adapter(t):
    """PRJ-17, PRJ-20, PRJ-21: headers, senses, sections and links of pages, by selectors."""
    rows = html.adapted(t("pages"), {"header": "h1", "senses": "li", "sections": "div.ad", "links": "a"})
    return rows.select("page_id", "header", *[F.size(c).cast("long").alias(n) for c, n in (("senses", "items"), ("sections", "sections"), ("links", "links"))])


@query(with_(LINES, query="select doc_id, 'kept' as op, count(*) as n from lines where line_no % 5 <> 4 group by 1 union all select doc_id, 'gone', count(*) from lines where line_no % 5 = 4 group by 1"))
def line_alignment(t):
    """QA-4: lines of two versions side by side."""
    rows = tables.lines(t("documents"))
    lines = lambda df: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(":", F.col("line_no").cast("string"), "line").alias("line")))), lambda x: x["line"]).alias("lines"))
    ops = quality.aligned_lines(lines(rows), lines(rows.where("line_no % 5 <> 4")), "doc_id")
    return ops.groupBy("doc_id", F.when(F.col("op") == "equal", "kept").otherwise("gone").alias("op")).agg(F.sum(F.col("a1") - F.col("a0")).alias("n"))


@query()
def reader_blocks(t):
    """SRC-24, PRJ-29: blocks with their places."""
    return html.reader_blocks(t("pages"))


# catalogues, libraries, exports -------------------------------------------------------------------------------------

@query(with_(TOKENS, query="""select doc_id, sent, cost, rank from (select *, row_number() over (partition by doc_id order by rank_score, cost, sent) as rank from (
  select doc_id, sent, count(*) as cost, count(*) - cast(sum(case when length(w) >= 6 then length(w) * length(w) else 0 end) as bigint) as rank_score from tok group by doc_id, sent)) where rank <= 3"""))
def nbest_rerank(t):
    """SEQ-4, SRT-6: sentences as candidates, reranked by their long words."""
    return matching.reranked(t("documents"), 6, 3)


@query("""select conv_id, turn, role, cast(least(length(text), 800) as bigint) as used, cast(before as bigint) as before from (select *, sum(least(length(text), 800)) over (partition by conv_id order by turn, role, text) - least(length(text), 800) as before from conversations) where before < 1600""")
def llm_budget_candidates(t):
    """QA-13, WIN-10: candidates until a budget is used up."""
    used = F.least(F.length("text"), F.lit(800))
    before = F.sum(used).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)) - used
    return t("conversations").select("conv_id", "turn", "role", used.cast("long").alias("used"), before.alias("before")).where("before < 1600")


@query("""select b.conv_id, b.turn, a.turn is not null and contains(a.text, substring(b.text, 1, 20)) as grounded from conversations b left join (select conv_id, turn, min(text) as text from conversations group by 1, 2) a on a.conv_id = b.conv_id and a.turn = b.turn - 1""")
def quote_grounding(t):
    """QA-12: whether a turn's opening is quoted from the turn before."""
    c = t("conversations")
    a = c.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("before"))
    return c.join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(F.contains("before", F.substring("text", 1, 20)), F.lit(False)).alias("grounded"))


@query(with_(TOKENS, query='select doc_id, start, "end", w from tok'))
def progressive_equals_full(t):
    """STR-1 to STR-4: chunks in any order give the whole document's tokens."""
    return session.progressive(session.chunks(t("documents"), 3), 3).select("doc_id", "start", "end", "w")


@query(with_(LINES, query="select doc_id, count(distinct (line_no - 1) // 3) as n, count(distinct case when (line_no - 1) // 3 % 2 = 0 then (line_no - 1) // 3 end) as arrived, count(distinct (line_no - 1) // 3) = 1 as complete from lines group by doc_id"))
def chunk_coverage(t):
    """AGG-22: which documents are complete."""
    parts = session.chunks(t("documents"), 3)
    return session.coverage(parts, parts.where("chunk % 2 = 0"))


# occurrences and orders ---------------------------------------------------------------------------------------------

_AUX = ("of", "the", "and", "to", "in", "is")


@query(with_(TOKENS, f"""k as (select *, case when w in {_AUX} then 2 when length(w) >= 5 then 1 else 0 end as kind from tok), c as (select *, sum(case when kind < 2 then 1 else 0 end) over (partition by doc_id, sent order by pos) as chain from k)""", query="""select doc_id, sent, max(case when kind = 1 then pos end) as start_pos, cast(sum(case when kind = 2 then 1 else 0 end) as bigint) as n_aux, string_agg(case when kind = 2 then w end, ' ' order by pos) as operators
from c where kind > 0 group by doc_id, sent, chain having max(case when kind = 1 then pos end) is not null and sum(case when kind = 2 then 1 else 0 end) > 0"""))
def morph_chains(t):
    """SEQ-8, SEQ-9: roots with the auxiliaries that follow."""
    return grammar.chains(text.tokens(t("documents")), F.length("w") >= 5, F.col("w").isin(*_AUX))


@query("select l_partkey, l_returnflag, max(l_quantity) as confidence, max(l_linenumber) as priority, array_to_string(list_sort(list(distinct l_linestatus)), ',') as evidence, count(*) as n from lineitem group by 1, 2")
def candidate_dedup(t):
    """INT-7: candidates merged by key."""
    rows = t("lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("confidence"), F.col("l_linenumber").alias("priority"), F.col("l_linestatus").alias("evidence"))
    return grammar.deduplicated(rows, ["l_partkey", "l_returnflag"])


@query()
def refine_conflicts(t):
    """INT-8: refinement in order of priority, sentence by sentence."""
    r = _ranges(t).select("doc_id", "sent", F.concat(F.lit("c"), F.pmod("id", F.lit(3)).cast("string")).alias("concept"), "start", "end", F.pmod("id", F.lit(5)).alias("priority"), F.when(F.pmod("id", F.lit(4)) == 0, "c1").alias("refines"), F.when(F.pmod("id", F.lit(2)) == 0, "g").alias("conflict_group"), F.lit("accepted").alias("status"), "id")
    return grammar.refined(r, ["doc_id", "sent"])


@query()
def pair_unmatched(t):
    """JOIN-20: removed and added orders of a customer, paired by their fields; of all orders, those with even keys count as removed and the others as added."""
    o = t("orders").select("o_custkey", F.col("o_orderkey").alias("key"), F.array("o_orderstatus", "o_orderpriority").alias("fields"))
    return grammar.pair_unmatched(o.where("key % 2 = 0"), o.where("key % 2 <> 0"), ["o_custkey"])


_OCC = 'o as (select doc_id, pos as id, start, "end" from tok where length(w) = 3)'


def _occurrences(t) -> DataFrame:
    return text.tokens(t("documents"), 3).where("length(w) = 3").select("doc_id", F.col("pos").alias("id"), "start", "end")


@query(with_(TOKENS, _RANGES, _OCC, query='select o.doc_id, o.id, least(o.start, coalesce(min(r.start), o.start)) as start, greatest(o."end", coalesce(max(r."end"), o."end")) as "end", coalesce(bool_or(r.start <= o.start and r."end" >= o."end"), false) as absorbed from o left join r on r.doc_id = o.doc_id and r.start < o."end" and r."end" > o.start group by o.doc_id, o.id, o.start, o."end"'))
def expanded_occurrences(t):
    """INT-14: occurrences with the chains that they touch; those within a chain are absorbed."""
    return occurrences.expanded(_occurrences(t), _ranges(t).select("doc_id", "start", "end"))


@query(with_(TOKENS, _RANGES, _OCC, query='select r.doc_id, r.id as unit, o.id, o.start >= r.start and o.start < r."end" as badge from r join o on o.doc_id = r.doc_id and o.start < r."end" and o."end" > r.start'))
def attached_occurrences(t):
    """INT-15: occurrences on each unit that they touch, the badge where they begin."""
    return occurrences.attached(_occurrences(t), _ranges(t).select("doc_id", F.col("id").alias("unit"), "start", "end"), "unit")


@query(with_(TOKENS, _RANGES, _OCC, query="""select doc_id, id, arg_max(rid, struct_pack(w := w, b := -rid)) as chain from (select o.doc_id, o.id, r.id as rid, r."end" - r.start as w from o join r on r.doc_id = o.doc_id and r.start <= o.start and r."end" >= o."end") group by 1, 2"""))
def head_chains(t):
    """PRJ-15: the widest chain that holds a head."""
    return occurrences.widest(_occurrences(t), _ranges(t).select("doc_id", F.col("id").alias("chain"), "start", "end"), "chain")


@query(with_(TOKENS, _RANGES, query='select doc_id, pos from tok where not exists (select 1 from r where r.doc_id = tok.doc_id and r.start <= tok.start and r."end" > tok.start)'))
def uncovered_tokens(t):
    """SEQ-17: tokens that no range covers."""
    docs = t("documents")
    return grammar.residuals(text.tokens(docs), _ranges(t))




from lexiflow.plans import catalogs, files, functions, libraries, lookups, morphemes, qualities, readings, sessions  # noqa: E402, F401  (register their queries here)
