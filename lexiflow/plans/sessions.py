"""Queries of progressive sessions: batches, revisions, patches, restored and recorded results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import text
from lexiflow.plans.registry import query
from lexiflow.plans.sql import LINES, TOKENS, with_
from lexiflow.sources import tables
from lexiflow.streaming import session

_CHUNKS = LINES + """, parts as (select doc_id, (line_no - 1) // 2 as chunk, min(start) as start, string_agg(line, chr(10) order by line_no) as text from lines group by 1, 2)"""
_FOLD = """folded as (select doc_id, list_reduce(list({'chunk': chunk, 'n': length(text), 'done': chunk % 5 = 3} order by chunk), lambda s, x: {'batch': s.batch + case when x.done then (case when s.total > 0 then 1 else 0 end) when s.total + x.n >= 400 then 1 else 0 end, 'total': case when x.done or s.total + x.n >= 400 then 0 else s.total + x.n end,
  'out': case when x.done then s.out else list_append(s.out, {'chunk': x.chunk, 'batch': s.batch}) end}, {'batch': 0::bigint, 'total': 0::bigint, 'out': cast([] as struct(chunk bigint, batch bigint)[])}) as r from parts group by doc_id)"""


@query(with_(_CHUNKS, _FOLD, query="select doc_id, o.chunk as chunk, o.batch as batch from (select doc_id, unnest(r.out) as o from folded)"))
def session_batches(t):
    """STR-2, WIN-11: neighbouring chunks that aren't done, until there are enough characters."""
    return session.batches(session.chunks(t("documents"), 2), 400, F.col("chunk") % 5 == 3)


@query(with_(_CHUNKS, "p as (select *, start + length(text) as stop from parts), places as (select doc_id, max(stop) // 2 as \"at\" from p group by 1), r as (select p.*, \"at\", coalesce(sum(length(text)) over (partition by doc_id order by chunk rows between unbounded preceding and 1 preceding), 0) as before from p join places using (doc_id) where stop >= \"at\")", query="select doc_id, \"at\", chunk from r where before < 500"))
def session_range_request(t):
    """STR-3: what is asked for first is taken first."""
    parts = session.chunks(t("documents"), 2)
    at = parts.groupBy("doc_id").agg(F.floor(F.max(F.col("start") + F.length("text")) / 2).alias("at"))
    return session.batch_at(parts, at, 500)


_MUTATIONS = "m as (select user_id as session, event_id as number, row_number() over (partition by user_id order by event_id) - 1 - (event_id % 4 = 0)::int as base from events)"


@query(with_(_MUTATIONS, "f as (select session, list_reduce(list({'number': number, 'base': base} order by number), lambda s, x: {'rev': s.rev + (x.base = s.rev)::int, 'out': list_append(s.out, {'number': x.number, 'base': x.base, 'ok': x.base = s.rev, 'rev': s.rev + (x.base = s.rev)::int})}, {'rev': 0::bigint, 'out': cast([] as struct(number bigint, base bigint, ok boolean, rev bigint)[])}) as r from m group by 1)", query="select session, o.number as number, o.base as base, o.ok as accepted, o.rev as revision from (select session, unnest(r.out) as o from f)"))
def session_revisions(t):
    """STR-5: mutations with an old base are refused."""
    from pyspark.sql import Window as W

    base = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1 - (F.col("event_id") % 4 == 0).cast("int")
    return session.accepted(t("events").select(F.col("user_id").alias("session"), F.col("event_id").alias("number"), base.cast("long").alias("base")))


_EDITED = "old as (select doc_id, line_no, line from lines where line_no % 11 <> 5), new as (select doc_id, line_no, case when line_no % 7 = 3 then line || '!' else line end as line from lines where line_no % 5 <> 4)"


def _versions(t):
    rows = tables.lines(t("documents")).select("doc_id", "line_no", "line")
    new = rows.where("line_no % 5 <> 4").withColumn("line", F.when(F.col("line_no") % 7 == 3, F.concat("line", F.lit("!"))).otherwise(F.col("line")))
    return rows.where("line_no % 11 <> 5"), new


_PATCH = "p as (select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(o.line_no, n.line_no) as line_no, case when o.doc_id is null then 'insert' when n.doc_id is null then 'remove' else 'update' end as op, n.line from old o full outer join new n on n.doc_id = o.doc_id and n.line_no = o.line_no where o.line is distinct from n.line)"


@query(with_(LINES, _EDITED, _PATCH, query="select * from p"))
def session_patch(t):
    """STR-6, SET-4: inserted, updated and removed rows."""
    return session.patch(*_versions(t), ["doc_id", "line_no"], ["line"])


@query(with_(LINES, _EDITED, _PATCH, query="select doc_id, case when count(*) filter (op <> 'update') = 0 then 'token_update' when count(*) filter (op <> 'insert') = 0 then 'full_replace' else 'range_replace' end as kind, count(*) as n from p group by 1"))
def session_patch_kinds(t):
    """STR-6: the kind of each document's patch."""
    return session.patch_kinds(session.patch(*_versions(t), ["doc_id", "line_no"], ["line"]), "doc_id")


@query(with_(LINES, _EDITED, query="select * from new"))
def session_merge(t):
    """JOIN-25: the old rows and the patch give the new rows."""
    old, new = _versions(t)
    return session.patched(old, session.patch(old, new, ["doc_id", "line_no"], ["line"]), ["doc_id", "line_no"], ["line"])


@query(with_(TOKENS, _CHUNKS, query='select t.doc_id, chunk, t.start - p.start as start, t."end" - p.start as "end", w from tok t join parts p on p.doc_id = t.doc_id and t.start >= p.start and t.start < p.start + length(p.text) where chunk % 3 = 1'))
def session_warm_restore(t):
    """STR-9: cached tokens at their places in the chunks that are asked for."""
    docs = t("documents")
    return session.restored(text.tokens(docs), session.chunks(docs, 2).where("chunk % 3 = 1"))


_COMPLETE = "ready as (select doc_id from (select distinct doc_id, (line_no - 1) // 3 as chunk from lines) group by 1 having count(*) filter (chunk % 4 = 3) = 0 and doc_id % 10 <> 0)"


@query(with_(TOKENS, LINES, _COMPLETE, query="select w, count(*) as n from tok join ready using (doc_id) group by w"))
def session_exposure_once(t):
    """STR-8: complete documents without a flag count, and only once."""
    docs = t("documents")
    parts = session.chunks(docs, 3)
    flags = docs.where("doc_id % 10 = 0").select("doc_id")
    first, after = session.recorded_once(session.coverage(parts, parts.where("chunk % 4 <> 3")), text.words(docs), flags)
    return first


@query(with_(TOKENS, LINES, _COMPLETE, "a as (select doc_id, pos, w, lead(w) over (partition by doc_id, sent order by pos) as w1 from tok join ready using (doc_id))", query="select doc_id, pos as start_pos from a where w = 'of' and w1 = 'the'"))
def session_deferred_expressions(t):
    """STR-10: expressions are looked for once the whole text is there."""
    from lexiflow.operators import matching

    docs = t("documents")
    parts = session.chunks(docs, 3)
    ready = session.coverage(parts, parts.where("chunk % 4 <> 3")).where("complete and doc_id % 10 <> 0").select("doc_id")
    rule = matching.Rule("of_the", (matching.atom("of"), matching.atom("the")))
    return matching.matches(docs.join(ready, "doc_id", "left_semi"), [rule]).select("doc_id", "start_pos")


_STAGE = "case event_type when 'signup' then 'text' when 'error' then 'units' when 'click' then 'profile' when 'view' then 'grammar' else 'expressions' end"
_NEEDS = "needs as (select * from (values " + ", ".join(f"('{p}', '{s}')" for s, ps in {"text": ["text"], "tokens": ["text", "tokens"], "units": ["text", "tokens", "units"], "phrases": ["text", "tokens", "units", "phrases"], **{k: ["text", "tokens", "units", "phrases", k] for k in ("grammar", "expressions", "profile")}}.items() for p in ps) + ") n(stage, again))"


@query(with_(_NEEDS, query=f"select distinct user_id as session, again as stage from events join needs on stage = {_STAGE} where event_id % 3 = 0"))
def session_invalidation(t):
    """STR-7: a stage that is touched, and all that need it, run again; the profile changes nothing else."""
    return session.invalidated(t("events").where("event_id % 3 = 0").select(F.col("user_id").alias("session"), F.expr(_STAGE).alias("stage")))


@query("select user_id as session, event_id as number, max(round(100 * (event_id % 37) / 37, 2)) over (partition by user_id order by event_id) as percent from events")
def session_progress(t):
    """STR-11: progress never falls."""
    return session.progress(t("events").select(F.col("user_id").alias("session"), F.col("event_id").alias("number"), (F.col("event_id") % 37).alias("done"), F.lit(37).alias("total")))
