"""Queries of rule catalogues; the bundles are made from ``part``, one for each brand, and written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import catalog
from lexiflow.plans.registry import query
from lexiflow.plans.sql import with_

_TABLES = """p as (select *, p_partkey as k from part), concepts as (select p_brand as bundle_id, case when k % 89 = 0 then 'Bad Id ' || k else 'c' || k end as concept_id, p_name as label, case when k % 4 = 0 then 'idiom' else 'concept' end as kind, cast(case when k % 5 = 0 then 3 else k % 5 end as int) as level, case when k % 6 = 0 then 'pending' when k % 83 = 0 then 'lost' else 'verified' end as status, case when k % 3 = 0 then [] else [lower(p_type)] end as domains, k from p),
senses as (select concept_id, concept_id || '.s' || n as sense_id, case when k % 7 = 0 and n = 0 then ' ' else label || ' ' || n end as text from concepts, unnest(case when k % 11 = 0 then [] when k % 2 = 0 then [0, 1] else [0] end) as u(n)),
rules as (select 'r' || (k - case when k % 101 = 0 and k > 0 then 1 else 0 end) as rule_id, concept_id, p_size as priority, case when k % 53 = 0 then '{{ghost}} x' when k % 2 = 0 then '{{head}} y' else '{{actual_form}}' end as template, case when k % 97 = 0 then 'r900000' when k % 10 = 5 then 'r' || (k - 1) end as refines, k % 13 = 0 as bare, case when k % 2 = 0 then 'verified' else 'pending' end as status from concepts join p using (k)),
redirects as (select concept_id as source, case when k % 500 = 2 then 'c900000' else 'c' || (k - 1) end as target, k from concepts where k % 10 in (1, 2) and k % 89 <> 0 and (k - 1) % 89 <> 0 union all select 'c' || k, case when k % 500 = 23 then 'c' || (k + 1) else 'c' || (k - 1) end, k from p where k % 500 in (23, 24))"""
_ENDS = "ends as (select a.source, coalesce(b.target, a.target) as target, case when b.target is null then 1 else 2 end::bigint as hops from redirects a left join redirects b on b.source = a.target where a.k % 500 not in (23, 24))"


def _bundles(t) -> DataFrame:
    """(bundle): the JSON of each brand's concepts with their senses and rules; a third of what they have is left to the defaults."""
    p = t("part").withColumn("k", F.col("p_partkey"))
    k = F.col("k")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    none = F.lit(None).cast("string")
    concept = F.when(k % 89 == 0, text("Bad Id ", k)).otherwise(text("c", k))
    senses = F.transform(F.when(k % 11 == 0, F.array().cast("array<int>")).when(k % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))), lambda n: F.struct(F.concat(concept, F.lit(".s"), n.cast("string")).alias("id"), F.when((k % 7 == 0) & (n == 0), " ").otherwise(F.concat("p_name", F.lit(" "), n.cast("string"))).alias("text")))
    some = lambda on: F.when(on, F.array(F.lit("an example")))
    rule = F.struct(
        text("r", k - F.when((k % 101 == 0) & (k > 0), 1).otherwise(0)).alias("id"), F.col("p_size").alias("priority"), F.array(F.lit("head")).alias("captures"), F.when(k % 53 == 0, "{{ghost}} x").when(k % 2 == 0, "{{head}} y").otherwise("{{actual_form}}").alias("template"),
        F.when(k % 97 == 0, "r900000").when(k % 10 == 5, text("r", k - 1)).alias("refines"), some(k % 13 != 0).alias("examples"), some(k % 13 != 0).alias("counter_examples"), F.when(k % 2 == 0, none).otherwise("pending").alias("status"),
    )
    c = F.struct(concept.alias("id"), F.col("p_name").alias("label"), F.when(k % 4 == 0, "idiom").alias("kind"), F.when(k % 5 != 0, (k % 5).cast("int")).alias("level"), F.when(k % 6 == 0, "pending").when(k % 83 == 0, "lost").alias("status"), F.when(k % 3 != 0, F.array(F.lower("p_type"))).alias("domains"), senses.alias("senses"), F.array(rule).alias("rules"))
    moved = F.when((k % 10).isin(1, 2) & (k % 89 != 0) & ((k - 1) % 89 != 0), F.struct(concept.alias("source"), F.when(k % 500 == 2, "c900000").otherwise(text("c", k - 1)).alias("target")))
    ring = F.when((k % 500).isin(23, 24), F.struct(text("c", k).alias("source"), F.when(k % 500 == 23, text("c", k + 1)).otherwise(text("c", k - 1)).alias("target")))
    rows = p.groupBy("p_brand").agg(F.collect_list(c).alias("concepts"), F.array_compact(F.concat(F.collect_list(moved), F.collect_list(ring))).alias("redirects"))
    defaults = F.struct(F.lit(3).alias("level"), F.lit("verified").alias("status"))
    return rows.select(F.to_json(F.struct(F.col("p_brand").alias("id"), defaults.alias("defaults"), "concepts", "redirects")).alias("bundle"))


def _tables(t) -> dict[str, DataFrame]:
    return catalog.expanded(_bundles(t))


@query(with_(_TABLES, query="select bundle_id, concept_id, label, kind, level, status, array_to_string(domains, ',') as domains from concepts"))
def catalog_concepts(t):
    """SRC-17, SRC-18: concepts of JSON bundles, defaults filled in."""
    return _tables(t)["concepts"].withColumn("domains", F.array_join("domains", ","))


@query(with_(_TABLES, query="select rule_id, concept_id, priority, template, refines, status from rules"))
def catalog_rules(t):
    """SRC-18: rules of JSON bundles."""
    return _tables(t)["rules"].select("rule_id", "concept_id", "priority", "template", "refines", "status")


@query(
    with_(
        _TABLES,
        query="""select 'duplicate_rule_id' as "check", rule_id as item from rules group by rule_id having count(*) > 1 union all select 'duplicate_source', source from redirects group by source having count(*) > 1 union all select 'bad_id', concept_id from concepts where k % 89 = 0 union all select 'unknown_status', concept_id from concepts where status = 'lost'
union all select 'sense_without_text', sense_id from senses where trim(text) = '' union all select 'concept_without_sense', concept_id from concepts where k % 11 = 0 union all select 'dangling_refines', rule_id from rules r where refines is not null and not exists (select 1 from rules x where x.rule_id = r.refines)
union all select 'unbound_placeholder', rule_id from rules where contains(template, 'ghost') union all select 'verified_without_examples', rule_id from rules where bare and status = 'verified' union all select distinct 'dangling_redirect', c from (select unnest([source, target]) as c from redirects) where c not in (select concept_id from concepts)
union all select 'redirect_cycle', source from redirects where k % 500 in (23, 24)""",
    )
)
def catalog_violations(t):
    """QA-1, QA-2, AGG-21: what is wrong with a catalogue."""
    return catalog.violations(_tables(t))


@query(with_(_TABLES, _ENDS, query="select * from ends"))
def redirect_targets(t):
    """JOIN-18: where redirects end."""
    return catalog.targets(_tables(t)["redirects"])


catalog_published_sql = with_(_TABLES, _ENDS, query="select rule_id, c.concept_id, c.label, coalesce(n, 0) as senses, case when r.status = 'verified' and c.status = 'verified' and coalesce(told, false) then 'accepted' else 'pending' end as status, row_number() over (order by priority desc, rule_id, c.concept_id, label) as place from rules r left join ends e on e.source = r.concept_id join concepts c on c.concept_id = coalesce(e.target, r.concept_id) left join (select concept_id, count(*) as n, bool_and(trim(text) <> '') as told from senses group by 1) s on s.concept_id = c.concept_id")


@query(catalog_published_sql)
def catalog_published(t):
    """QA-3, JOIN-17, SRT-2: rules with their concepts, what is published, in the order in which rules are tried."""
    return catalog.published(_tables(t), ("rule_id", "concept_id", "label"))


_INDEX = "idx as (select c.*, coalesce((select list_sort(list(distinct x.label)) from ends e join concepts x on x.concept_id = e.source where e.target = c.concept_id), []) as aliases, coalesce((select list_sort(list(distinct text)) from senses s where s.concept_id = c.concept_id), []) as hints from concepts c)"


@query(with_(_TABLES, _ENDS, _INDEX, query="select concept_id, label, kind, level, status, array_to_string(aliases, '|') as aliases, array_to_string(hints, '|') as hints from idx"))
def catalog_index(t):
    """SEA-2: the search index, with the names of what was redirected."""
    return catalog.search_index(_tables(t)).select("concept_id", "label", "kind", "level", "status", F.array_join("aliases", "|").alias("aliases"), F.array_join("hints", "|").alias("hints"))


@query(with_(_TABLES, _ENDS, _INDEX, query="select concept_id, label from idx where status = 'verified' and level = 3 and (kind = 'idiom' or list_contains(domains, 'economy')) and (contains(lower(label), 'ring') or contains(concept_id, 'ring') or contains(array_to_string(aliases, '|'), 'ring') or contains(array_to_string(hints, '|'), 'ring') or contains(array_to_string(domains, '|'), 'ring')) union all select concept_id, label from idx where kind = 'idiom' and level = 1"))
def catalog_search(t):
    """SEA-1: status, level, family and text, each if it's given."""
    index = catalog.search_index(_tables(t))
    found = catalog.search(index, "RING", "economy", 3, "verified").unionByName(catalog.search(index, "ring", "idiom", 3, "verified")).distinct()
    return found.select("concept_id", "label").unionByName(catalog.search(index, family="idiom", level=1).select("concept_id", "label"))
