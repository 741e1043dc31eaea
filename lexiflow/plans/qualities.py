"""Queries of the quality comparison: two versions of what documents hold, and small tables of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import quality, text
from lexiflow.plans.registry import query
from lexiflow.plans.sql import LINES, TOKENS, with_
from lexiflow.sources import tables
from lexiflow.sources.shared import checkpointed

STAGES = [("source", 0), ("lines", 1), ("words", 2), ("sentences", 3), ("expressions", 4)]
NEEDS = [("words", "lines", 1), ("sentences", "lines", 1), ("sentences", "words", 2)]
CRITICAL, GUARDED = ("source",), ("words", "sentences")


def _before_after(t) -> tuple[DataFrame, DataFrame]:
    """Lines, long words and sentences of the documents; some are missing or different in one of both versions."""
    docs = t("documents")
    lines = tables.lines(docs).where("line <> ''")
    tok = text.tokens(docs)
    sents = tok.groupBy("doc_id", "sent").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))

    def version(after: bool) -> DataFrame:
        edit = lambda when, new, old: F.when(when, new).otherwise(old) if after else old
        common = lambda df, stage, key, value, status, end: df.select(F.col("doc_id").alias("document"), F.lit(stage).alias("stage"), F.col(key).alias("key"), "start", end.cast("long").alias("end"), value.alias("value"), status.alias("status"))
        own_lines = common(lines, "lines", "line_no", edit(F.col("line_no") % 5 == 2, F.concat("line", F.lit("!")), F.col("line")), F.lit("accepted"), F.col("start") + F.length("line"))
        status = F.when(F.col("pos") % 3 == 0, "accepted").otherwise("pending")
        words = text.tokens(docs, 9).where(F.col("pos") % 7 != (1 if after else 2))
        own_words = common(words, "words", "pos", F.col("w"), edit(F.col("pos") % 11 == 3, F.lit("rejected"), status), F.col("end"))
        own_sents = common(sents, "sentences", "sent", F.col("n").cast("string"), F.lit("accepted"), edit(F.col("sent") % 4 == 1, F.col("end") - 1, F.col("end")))
        return own_lines.unionByName(own_words).unionByName(own_sents)

    return version(False), version(True)


def _version(after: int) -> str:
    pick = lambda new, old: new if after else old
    return f"""(select doc_id as document, 'lines' as stage, line_no as key, start, start + length(line) as "end", {pick("case when line_no % 5 = 2 then line || '!' else line end", 'line')} as value, 'accepted' as status from lines where line <> ''
  union all select doc_id, 'words', pos, start, "end", w, {pick("case when pos % 11 = 3 then 'rejected' when pos % 3 = 0 then 'accepted' else 'pending' end", "case when pos % 3 = 0 then 'accepted' else 'pending' end")} from tok where length(w) >= 9 and pos % 7 <> {pick(1, 2)}
  union all select doc_id, 'sentences', sent, min(start), {pick('max("end") - case when sent % 4 = 1 then 1 else 0 end', 'max("end")')}, cast(count(*) as varchar), 'accepted' from tok group by doc_id, sent)"""


_CHANGES = f"""old as {_version(0)}, new as {_version(1)},
c0 as (select coalesce(o.document, n.document) as document, coalesce(o.stage, n.stage) as stage, coalesce(o.key, n.key) as key, coalesce(o.start, n.start) as start, coalesce(o."end", n."end") as "end", case when o.key is null then 'added' when n.key is null then 'removed' else 'modified' end as operation,
  o.key is not null and n.key is not null and o."end" <> n."end" as moved, o.key is not null and n.key is not null and o.status <> n.status as decided, coalesce(o.status, 'absent') as status_before, coalesce(n.status, 'absent') as status_after
  from old o full outer join new n on n.document = o.document and n.stage = o.stage and n.key = o.key where o.value is distinct from n.value or o.status is distinct from n.status or o."end" is distinct from n."end"),
c1 as (select *, case when moved then 'range' when decided then 'decision' else 'content' end as scope from c0),
c as (select *, case when stage in ('words', 'sentences') and (operation = 'removed' or scope in ('range', 'decision')) then 'high' else 'medium' end as severity from c1)"""
_CAUSES = """p as (select distinct c.document, c.stage, c.key, u.stage as cause_stage, u.key as cause, case u.stage when 'lines' then 1 else 2 end as place from c join c u on u.document = c.document and u.start < c."end" and u."end" > c.start and ((c.stage = 'words' and u.stage = 'lines') or (c.stage = 'sentences' and u.stage in ('lines', 'words')))),
near as (select *, max(place) over (partition by document, stage, key) as top from p), named as (select document, stage, key, any_value(cause_stage) as cause_stage, least(count(*), 20) as n from near where place = top group by 1, 2, 3),
caused as (select c.*, case when n is null then 'root' else 'propagated_candidate' end as causal_status, cause_stage, coalesce(n, 0) as n_causes from c left join named using (document, stage, key))"""


def _changes(t) -> DataFrame:
    return quality.changes(*_before_after(t), CRITICAL, GUARDED)


def _caused(t) -> DataFrame:
    spark = t("documents").sparkSession
    # changes are read three times here, and made from two versions of all texts
    return quality.causes(checkpointed(_changes(t)), spark.createDataFrame(NEEDS, "stage string, ancestor string, place int"))


@query(with_(TOKENS, LINES, _CHANGES, query='select document, stage, key, start, "end", operation, scope, severity, status_before, status_after from c'))
def quality_changes(t):
    """QA-5, JOIN-19, SCL-15: changes with their scope and severity."""
    return _changes(t).drop("fields")


@query(with_(TOKENS, LINES, _CHANGES, _CAUSES, query="select document, stage, key, causal_status, cause_stage, n_causes from caused"))
def change_causes(t):
    """JOIN-21: the nearest earlier changes at the same places."""
    return _caused(t).select("document", "stage", "key", "causal_status", "cause_stage", F.coalesce(F.size("causes"), F.lit(0)).cast("long").alias("n_causes"))


_SUMMARY = """spine as (select * from (values ('source', 0), ('lines', 1), ('words', 2), ('sentences', 3), ('expressions', 4)) s(stage, place)),
sums as (select s.stage, place, case when b.n is null and a.n is null then 'missing' else 'comparable' end as coverage, coalesce(b.n, 0) as before_n, coalesce(a.n, 0) as after_n, coalesce(x.n, 0) as changes, coalesce(x.roots, 0) as roots, coalesce(b.n, 0) + coalesce(x.added, 0) as units from spine s
  left join (select stage, count(*) as n from old group by 1) b using (stage) left join (select stage, count(*) as n from new group by 1) a using (stage) left join (select stage, count(*) as n, count(*) filter (causal_status = 'root') as roots, count(*) filter (operation = 'added') as added from caused group by 1) x using (stage)),
summary as (select *, case when units = 0 then 0.0 else round(changes / units, 8) end as rate, 1.959963984540054::double as z, changes / nullif(units, 0) as q from sums)"""


def _summary(t) -> tuple[DataFrame, DataFrame]:
    before, after = _before_after(t)
    spark = before.sparkSession
    caused = checkpointed(_caused(t).drop("causes", "fields"))
    stages = spark.createDataFrame(STAGES, "stage string, place int")
    summary = quality.stage_summary(stages, before, after, caused, spark.createDataFrame([], "stage string"))
    return checkpointed(summary), caused


@query(with_(TOKENS, LINES, _CHANGES, _CAUSES, _SUMMARY, query="""select stage, place, coverage, before_n, after_n, changes, roots, units, rate, coalesce(round(greatest((q + z * z / (2 * units) - z * sqrt(q * (1 - q) / units + z * z / (4.0 * units * units))) / (1 + z * z / units), 0), 8), 0) as low,
  case when units = 0 then 0 else round(least((q + z * z / (2 * units) + z * sqrt(q * (1 - q) / units + z * z / (4.0 * units * units))) / (1 + z * z / units), 1), 8) end as high from summary"""))
def stage_summary(t):
    """AGG-13 to AGG-15: every stage of the spine with its coverage, churn and interval."""
    return _summary(t)[0]


@query(with_(TOKENS, LINES, _CHANGES, query="select place, severity, coalesce(n, 0) as n from (values (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'info')) s(place, severity) left join (select severity, count(*) as n from c group by 1) using (severity)"))
def severity_counts(t):
    """AGG-15: severities in their fixed order."""
    return quality.severity_counts(_changes(t))


@query(with_(TOKENS, LINES, _CHANGES, query="""select document, stage, key, row_number() over (partition by document order by case stage when 'lines' then 1 when 'words' then 2 else 3 end, case severity when 'high' then 1 else 2 end, start, "end", key) as place from c"""))
def ordered_changes(t):
    """SRT-10: changes by stage, severity and range."""
    changes = _changes(t)
    return quality.ordered(changes, changes.sparkSession.createDataFrame(STAGES, "stage string, place int")).select("document", "stage", "key", "place")


#: Gate rules: (rule, kind, target, maximum, blocking)
RULES = [
    ("comparable", "comparable", "", 0.0, True), ("eligible", "quality_conclusion", "eligible", 0.0, True), ("known_gap", "missing_stage", "expressions", 0.0, True), ("words_there", "required_stage", "words", 0.0, True), ("expressions_there", "required_stage", "expressions", 0.0, True), ("contracts", "contract_mismatches", "", 0.0, True),
    ("roots", "max_root_changes", "", 10.0, False), ("churn", "max_churn_rate", "", 0.9, False), ("high", "max_severities", "high", 0.0, False), ("critical", "max_severities", "critical", 0.0, False), ("ranges", "max_scope_changes", "range", 5.0, False), ("rejections", "max_status_transitions", "accepted->rejected", 1.0, False),
    ("lines_known", "stage_known", "lines", 0.0, True), ("ghost_known", "stage_known", "ghost", 0.0, True), ("line_changes", "stage_max_changes", "lines", 3.0, False), ("line_churn", "stage_max_churn_rate", "lines", 0.9, False), ("word_decisions", "stage_max_scopes", "words/decision", 0.0, False),
]
_GATE = """total as (select sum(roots) as roots, sum(changes) as changes, sum(units) as units from sums),
g as (select 'comparable' as rule, 'comparable' as kind, '' as target, 0.0 as actual, false as violated, true as blocking union all select 'quality_conclusion', 'quality_conclusion', 'partial', 1, true, true union all select 'missing_stage', 'missing_stage', 'source', 1, true, true
  union all select 'words_there', 'required_stage', 'words', 0, false, true union all select 'expressions_there', 'required_stage', 'expressions', 1, true, true union all select 'contracts', 'contract_mismatches', '', 0, false, true
  union all select 'roots', 'max_root_changes', '', roots, roots > 10, false from total union all select 'churn', 'max_churn_rate', '', round(changes / units, 8), round(changes / units, 8) > 0.9, false from total
  union all select 'high', 'max_severities', 'high', count(*), count(*) > 0, false from c where severity = 'high' union all select 'critical', 'max_severities', 'critical', 0, false, false
  union all select 'ranges', 'max_scope_changes', 'range', count(*), count(*) > 5, false from c where scope = 'range' union all select 'rejections', 'max_status_transitions', 'accepted->rejected', count(*), count(*) > 1, false from c where status_before = 'accepted' and status_after = 'rejected'
  union all select 'lines_known', 'stage_known', 'lines', 0, false, true union all select 'ghost_known', 'stage_known', 'ghost', 1, true, true
  union all select 'line_changes', 'stage_max_changes', 'lines', changes, changes > 3, false from summary where stage = 'lines' union all select 'line_churn', 'stage_max_churn_rate', 'lines', rate, rate > 0.9, false from summary where stage = 'lines'
  union all select 'word_decisions', 'stage_max_scopes', 'words/decision', count(*), count(*) > 0, false from c where stage = 'words' and scope = 'decision')"""


def _judged(t) -> DataFrame:
    summary, caused = _summary(t)
    spark = summary.sparkSession
    found = quality.metrics(summary, caused, quality.conclusion(summary, ("source",)), spark.createDataFrame([], "artifact string"))
    return quality.gate(spark.createDataFrame(RULES, "rule string, kind string, target string, maximum double, blocking boolean"), found)


@query(with_(TOKENS, LINES, _CHANGES, _CAUSES, _SUMMARY, _GATE, query="select rule, kind, target, cast(actual as double) as actual, violated, blocking from g"))
def gate_rules(t):
    """QA-9, SET-6: rules of fourteen kinds over the comparison's figures."""
    return _judged(t)


@query(with_(TOKENS, LINES, _CHANGES, _CAUSES, _SUMMARY, _GATE, query="select case when count(*) filter (violated and blocking) > 0 then 'blocked' when count(*) filter (violated) > 0 then 'review_required' else 'passed' end as status, count(*) filter (violated) as violations from g"))
def gate_verdict(t):
    """QA-9: what the rules come to."""
    return quality.verdict(_judged(t))


@query("with m as (select s_name as artifact, s_nationkey as b, s_nationkey + case when s_suppkey % 9 = 0 then 1 else 0 end as a, s_suppkey as k from supplier) select artifact, case k % 3 when 0 then 'lines' when 1 then 'words' else 'sentences' end as stage from m where a <> b and k % 5 <> 4")
def contract_mismatches(t):
    """QA-7: artifacts under another contract stop the stages that they cover."""
    s, k = t("supplier"), F.col("s_suppkey")
    manifest = lambda adapter: s.select(F.col("s_name").alias("artifact"), adapter.cast("string").alias("adapter"), F.lit("full").alias("capture"))
    covers = s.select(F.col("s_name").alias("artifact"), F.when(k % 3 == 0, "lines").when(k % 3 == 1, "words").otherwise("sentences").alias("stage"))
    after = manifest(F.col("s_nationkey") + F.when(k % 9 == 0, 1).otherwise(0)).join(s.where(k % 5 != 4).select(F.col("s_name").alias("artifact")), "artifact")
    return quality.contract_mismatches(manifest(F.col("s_nationkey")), after, covers)


@query("select distinct p_type as kind, p_name as name, case when p_type = 'ECONOMY' then 'all' when p_type like 'PROMO%' then 'lexical' when contains(lower(p_name), 'ring') then 'formation' when contains(lower(p_name), 'red') then 'phrases' else 'default' end as stages from part")
def resource_stages(t):
    """QA-8: which stages a resource can change, by the first rule that fits."""
    rules = t("part").sparkSession.createDataFrame([(0, "ECONOMY", None, None, "all"), (1, None, "PROMO", None, "lexical"), (2, None, None, "ring", "formation"), (3, None, None, "red", "phrases"), (4, None, None, None, "default")], "place int, kind string, kind_prefix string, part string, stages string")
    return quality.affected_stages(t("part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name")), rules)


@query("select doc_id, sha256(text) as sha256, doc_id % 13 <> 0 as sound from documents")
def artifact_verification(t):
    """SRC-22: artifacts whose digest isn't the stated one."""
    docs = t("documents").withColumn("expected", F.sha2(F.concat("text", F.when(F.col("doc_id") % 13 == 0, "x").otherwise("")), 256))
    return quality.verified(docs, "text", "expected").select("doc_id", "sha256", "sound")


@query("""with t as (select o_custkey as document, o_orderpriority as stage, o_orderkey % 7 as key, 'tokens' as artifact, 0 as n, o_orderstatus as value from orders where o_orderkey % 3 <> 0 union all select o_custkey, o_orderpriority, o_orderkey % 7, 'scan', 1, o_orderstatus || '?' from orders where o_orderkey % 3 <> 1)
select document, stage, key, artifact, sha256(value) as value_hash, count(*) as copies from (select *, min(n) over (partition by document, stage, key) as first from t) where n = first group by 1, 2, 3, 4, 5""")
def snapshot_entities(t):
    """QA-6: entities of two artifacts; the first one's count where both have a key."""
    own = lambda value: t("orders").select(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 7).alias("key"), value.alias("value"), "o_orderkey")
    return quality.entities([("tokens", own(F.col("o_orderstatus")).where("o_orderkey % 3 <> 0")), ("scan", own(F.concat("o_orderstatus", F.lit("?"))).where("o_orderkey % 3 <> 1"))])


@query("""with s as (select o_custkey as run_id, o_orderpriority as sha256, min(o_orderkey) as path, count(*) as n from orders group by 1, 2), r as (select run_id, sum(n) as n, min(path) as only from s group by 1)
select event_id as diff_id, coalesce(s.path, r.only) as path, case when s.path is not null then 'digest' when r.only is not null then 'run' else 'none' end as how from events e left join s on s.run_id = e.user_id and s.sha256 = (event_id % 5 + 1) || '-' left join r on r.run_id = e.user_id and r.n = 1""".replace("o_orderpriority", "substring(o_orderpriority, 1, 2)"))
def history_sides(t):
    """JOIN-22: the snapshot of a comparison's side, by digest, else the run's only one."""
    snaps = t("orders").select(F.col("o_custkey").alias("run_id"), F.substring("o_orderpriority", 1, 2).alias("sha256"), F.col("o_orderkey").alias("path"))
    diffs = t("events").select(F.col("event_id").alias("diff_id"), F.col("user_id").alias("run_id"), F.concat((F.col("event_id") % 5 + 1).cast("string"), F.lit("-")).alias("sha256"))
    return quality.sides(diffs, snaps)


@query("select conv_id, turn, case when strlen(text) <= 480 then text end as value, case when strlen(text) > 480 then 'string' end as kind, case when strlen(text) > 480 then strlen(text) end as bytes, case when strlen(text) > 480 then sha256(text) end as sha256 from conversations")
def value_descriptors(t):
    """SCL-14: long values by kind, size and digest."""
    return t("conversations").select("conv_id", "turn", quality.descriptor(F.col("text")).alias("d")).select("conv_id", "turn", "d.value", "d.kind", F.col("d.bytes").cast("long").alias("bytes"), "d.sha256")


@query("""with a as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus) as k, l_returnflag || '|' || l_linestatus as v from lineitem), b as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus) as k, l_returnflag || '|' || l_linestatus as v from (select * replace (case when l_orderkey % 13 = 0 then 'Z' else l_returnflag end as l_returnflag) from lineitem) where not (l_orderkey % 11 = 0 and l_linenumber = 2))
select l_orderkey, count(a.v) as rows_left, count(b.v) as rows_right, count(*) filter (a.v is distinct from b.v) as differing, min(case when a.v is distinct from b.v then k end) as first from a full outer join b using (l_orderkey, k) group by 1""")
def migration_check(t):
    """QA-10: two tables row by row."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    other = rows.where("not (l_orderkey % 11 = 0 and l_linenumber = 2)").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 13 == 0, "Z").otherwise(F.col("l_returnflag")))
    return quality.compared_rows(rows, other, "l_orderkey", ["l_linenumber", "l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"])


@query("""with f as (select doc_id as case_id, list(distinct w) as p from (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+'))) as w from documents) group by 1), d as (select doc_id as case_id, coalesce(p, []) as p from documents left join f on case_id = doc_id)
select case_id, array_to_string(list_sort(list_filter(['the', 'of'], lambda w: not list_contains(p, w))), ',') as missing, array_to_string(list_sort(list_filter(['der', 'les'], lambda w: list_contains(p, w))), ',') as forbidden, list_contains(p, 'the') and list_contains(p, 'of') and not list_contains(p, 'der') and not list_contains(p, 'les') as passed from d""")
def concept_assertions(t):
    """AGG-7: concepts that a case must and mustn't show."""
    docs = t("documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), F.array(F.lit("the"), F.lit("of")).alias("expected"), F.array(F.lit("der"), F.lit("les")).alias("unwanted"))
    found = text.words(docs).distinct().select(F.col("doc_id").alias("case_id"), F.col("w").alias("concept"))
    return quality.asserted(found, cases).withColumns({"missing": F.array_join("missing", ","), "forbidden": F.array_join("forbidden", ",")})


_DECISION = "case event_type when 'signup' then 'verified' when 'view' then 'verified' when 'error' then 'rejected' else 'pending' end"


@query(f"select user_id, count(*) as total, count(*) filter (d = 'verified') as verified, count(*) filter (d = 'rejected') as rejected, count(*) filter (d = 'pending') as pending, coalesce(round(100 * count(*) filter (d = 'verified') / nullif(count(*) - count(*) filter (d = 'pending'), 0), 4), 0) as pass_rate from (select user_id, {_DECISION} as d from events) group by 1")
def verification_report(t):
    """AGG-20: decisions and the pass rate."""
    return quality.verification(t("events").select("user_id", F.expr(_DECISION).alias("decision")), "user_id", "decision")


@query("select event_type as phase, round(sum(value), 4) as total, count(*) as n, row_number() over (order by event_type) as place from events group by 1")
def phase_timings(t):
    """AGG-19: time by phase."""
    return quality.timings(t("events"), "event_type", "value")


@query(with_(TOKENS, "v as (select distinct w from (select lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+'))) as w from benchmark))", query="select d.doc_id, count(t.w) as n, count(t.w) filter (v.w is null) as residuals, coalesce(round(count(t.w) filter (v.w is null) / nullif(count(t.w), 0), 6), 0) as rate from documents d left join tok t on t.doc_id = d.doc_id left join v on v.w = t.w group by d.doc_id"))
def residual_rate(t):
    """AGG-4: the share of words that nothing explains, 0 where there are none."""
    docs = t("documents")
    known = text.words(t("benchmark").withColumnRenamed("item_id", "doc_id")).select("w").distinct()
    return quality.residual_rate(docs.select("doc_id"), text.words(docs), known)


@query(with_(TOKENS, LINES, query="""select doc_id, count(distinct line_no) as lines, coalesce(sum(n), 0)::bigint as units, coalesce(sum(greatest(n - 1, 0)), 0)::bigint as boundaries, count(*) filter (n = 0) as failures from (select l.doc_id, l.line_no, count(t.pos) as n from lines l left join tok t on t.doc_id = l.doc_id and t.line + 1 = l.line_no group by 1, 2) group by doc_id"""))
def line_metrics(t):
    """AGG-11: lines, units, boundaries between them, and lines without any."""
    docs = t("documents")
    return quality.unit_metrics(tables.lines(docs).select("doc_id", "line_no"), text.tokens(docs).select("doc_id", (F.col("line") + 1).alias("line_no")))
