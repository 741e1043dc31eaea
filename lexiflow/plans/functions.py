"""Queries of scalar functions, and of results that are written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiflow.functions import scalars
from lexiflow.operators import catalog, grammar, lookup, quality, text
from lexiflow.plans import catalogs
from lexiflow.plans.files import _ENTRIES, _entries
from lexiflow.plans.lookups import HIRA, KATA, LATIN
from lexiflow.plans.registry import query
from lexiflow.plans.sql import LINES, WORDS, with_
from lexiflow.sources import bundles, cache, tables
from lexiflow.sources.shared import shared_folder

_WIDE = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query(with_(LINES, query="select doc_id, line_no + 2 as line_no, line from lines where not starts_with(line, '## ')"))
def chapter_section(t):
    """SRC-3: the lines under a heading, up to the next one."""
    docs = t("documents").withColumn("text", F.concat(F.lit("front\n## A\n"), "text", F.lit("\n## B\nend\n## A B\nx")))
    return tables.chapter(docs, "A")


@query("select doc_id, 'see ' || text || 'end' as shown from (select doc_id, regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g') as text from documents)")
def markdown_images(t):
    """PRJ-1: text without images."""
    return t("documents").select("doc_id", scalars.without_images(F.concat(F.lit("![a b](c.png)see "), "text", F.lit("![](x)end"))).alias("shown"))


@query("select s_suppkey, case when s_suppkey % 3 <> 0 then s_name || ' of N' || s_nationkey || '; ' || s_name end as bound from supplier")
def bound_templates(t):
    """PRJ-26: captures put into a template, nothing if one is missing."""
    captures = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("head"), F.col("s_name"))).otherwise(F.create_map(F.lit("head"), F.col("s_name"), F.lit("place"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))))
    return t("supplier").select("s_suppkey", scalars.bound_template(F.lit("{{head}} of {{place}}; {{head}}"), captures).alias("bound"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(case when l_linenumber = 1 then 'own' end, case when l_partkey % 5 = 0 then 'sense ' || l_partkey end, case when l_suppkey % 2 = 0 then 'concept ' || l_suppkey end) as explanation from lineitem")
def explanations(t):
    """PRJ-27, JOIN-17: an occurrence's own explanation, else its sense's, else its concept's."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").alias("concept"), F.col("l_partkey").alias("sense"), F.when(F.col("l_linenumber") == 1, "own").alias("explicit"))
    senses = t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("sense"), F.concat(F.lit("sense "), F.col("p_partkey").cast("string")).alias("explanation"))
    concepts = t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("concept"), F.concat(F.lit("concept "), F.col("s_suppkey").cast("string")).alias("explanation"))
    return grammar.explained(rows, senses, concepts).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "explanation")


@query(f"""with w as (select p_partkey, split_part(p_name, ' ', 1) as w, p_name from part) select p_partkey, replace(p_name, ' ', '') || translate(w, '{LATIN}', '{HIRA}') as form, translate(w, '{LATIN}', '{KATA}') as reading, translate(w, '{LATIN}', '{HIRA}') as identity, false as form_is_kana, true as reading_is_kana, true as query_is_kana from w""")
def normal_forms(t):
    """SCL-1 to SCL-4: forms and readings in their normal form, and what counts as kana."""
    word = F.split("p_name", " ")[0]
    kana = F.translate(word, LATIN, HIRA)
    form = F.concat(F.translate("p_name", LATIN, _WIDE), F.lit("・ -"), kana)
    reading = F.concat_ws("・", F.substring(kana, 1, 1), F.substring(kana, F.lit(2), F.length(kana)))
    return t("part").select("p_partkey", scalars.normalized_form(form).alias("form"), scalars.normalized_reading(reading).alias("reading"), scalars.form_identity(F.translate(word, LATIN, KATA)).alias("identity"), scalars.is_kana(form).alias("form_is_kana"), scalars.is_kana_form(kana).alias("reading_is_kana"), scalars.is_kana_query(reading).alias("query_is_kana"))


@query("""select event_id, case when event_id % 5 = 0 then null else '{"a":{"x":"é","y":null},"b":[1,2],"k":' || event_id || '}' end as canonical from events""")
def canonical_jsons(t):
    """SCL-12: JSON with sorted keys and no spaces; nothing for what isn't JSON."""
    k = F.col("event_id").cast("string")
    return t("events").select("event_id", scalars.canonical_json(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "b": [1, 2],  "a": {"y": null, "x": "é"}}')))).alias("canonical"))


@query("""select event_id, '/k' as path, event_id::varchar as before, (event_id + 1)::varchar as after from events where event_id % 2 = 0 union all select event_id, '/l/7/v', '1', '2' from events where event_id % 3 = 0 union all select event_id, '/l/8', null, '{"id":8}' from events where event_id % 5 = 0 union all select event_id, '/n~1m', '[1,2]', '[2,1]' from events where event_id % 7 = 0""")
def json_differences(t):
    """SCL-13: paths of what differs; lists with ids by id, other lists as a whole."""
    k = F.col("event_id")
    text_ = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    before = text_('{"k": ', k, ', "l": [{"id": 7, "v": 1}], "n/m": [1, 2]}')
    after = text_('{"n/m": ', F.when(k % 7 == 0, "[2, 1]").otherwise("[1, 2]"), ', "l": [', F.when(k % 5 == 0, '{"id": 8}, ').otherwise(""), '{"v": ', F.when(k % 3 == 0, "2").otherwise("1"), ', "id": 7}], "k": ', k + F.when(k % 2 == 0, 1).otherwise(0), "}")
    return t("events").select("event_id", F.explode(scalars.json_diff(before, after)).alias("d")).select("event_id", "d.*")


@query("""select event_id, x.tag as tag, x.a0 as a0, x.a1 as a1, x.b0 as b0, x.b1 as b1 from events, (values (0, 'equal', 0, 3, 0, 3), (1, 'equal', 0, 1, 0, 1), (1, 'replace', 1, 2, 1, 2), (1, 'equal', 2, 3, 2, 3), (2, 'insert', 0, 0, 0, 1), (2, 'equal', 0, 2, 1, 3), (2, 'delete', 2, 3, 3, 3)) x(k, tag, a0, a1, b0, b1) where event_id % 3 = k""")
def edit_scripts(t):
    """SCL-16: edits between two sequences."""
    k = F.col("event_id")
    lists = lambda *x: F.array(*map(F.lit, x))
    after = F.when(k % 3 == 0, lists("a", "b", "c")).when(k % 3 == 1, lists("a", "x", "c")).otherwise(lists("z", "a", "b"))
    return t("events").select("event_id", F.explode(scalars.opcodes(lists("a", "b", "c"), after)).alias("o")).select("event_id", "o.*")


@query("select p_partkey, replace(p_name, ' ', ' ') || '漢字...' || p_partkey as shown, lower(replace(p_name, ' ', '-')) || '-' || p_partkey || '-é' as slug from part")
def inline_texts(t):
    """SCL-18, SCL-26: spaces only between ASCII words; slugs."""
    k = F.col("p_partkey").cast("string")
    return t("part").select("p_partkey", scalars.inline_spaces(F.concat(F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit(" 漢 字 … "), k)).alias("shown"), scalars.slug(F.concat(F.lit("--"), F.initcap("p_name"), F.lit(" / "), k, F.lit(" É! "))).alias("slug"))


@query("select c_custkey, 'Red,' || substring(c_name, 1, 24) || case when c_custkey % 2 = 0 then ',t1,t2,t3,t4,t5,t6,t7,t8,t9,t10' else '' end as tags from customer")
def tag_lists(t):
    """SCL-20: tags without marks, each spelling once, twelve at most."""
    more = F.array(*[F.lit(f"t{k}") for k in range(1, 16)])
    raw = F.concat(F.array(F.lit("##Red"), F.lit(" red "), F.lit("#"), F.lit("")), F.array(F.concat("c_name", F.lit("x" * 30))), F.when(F.col("c_custkey") % 2 == 0, more).otherwise(F.array().cast("array<string>")))
    return t("customer").select("c_custkey", F.array_join(F.transform(scalars.tags(raw), lambda x: F.regexp_replace(x, "x+$", "")), ",").alias("tags"))


@query("select p_partkey, cast(greatest(90 - 4 * (count(*) over (partition by p_brand, p_size) - 1), 0) as bigint) as confidence from part")
def sense_confidence(t):
    """SCL-27: the more senses a concept has, the less sure each is."""
    return grammar.sense_confidence(t("part").withColumn("confidence", F.lit(90)), ["p_brand", "p_size"], "confidence").select("p_partkey", "confidence")


@query("select p_partkey as query_id, 'x' || p_partkey as entry_id, case when p_partkey % 3 = 0 then 'compatibility_alias' else 'exact_form' end as match_type from part where p_partkey % 3 < 2")
def compatible_aliases(t):
    """SEA-5, SET-2: aliases for queries that find nothing else."""
    k, id_ = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p = t("part")
    word = lambda prefix: F.concat(F.lit(prefix), id_)
    entries = p.select(F.lit("d").alias("dict"), word("x").alias("entry_id"), k.alias("record_index"), word("w").alias("headword"), F.lit(None).cast("string").alias("reading"), F.lit("word").alias("kind"), F.array().cast("array<string>").alias("labels"), F.array(word("w")).alias("forms"), F.lit(True).alias("content"))
    keys = entries.select("dict", "entry_id", F.lit("form").alias("kind"), F.col("headword").alias("value"), F.lit(0).alias("rank"))
    aliases = p.sparkSession.createDataFrame([], "dict string, alias string, target string")
    asked = p.select(k.alias("query_id"), F.when(k % 3 == 1, word("w")).when(k % 3 == 0, word("old")).otherwise(word("none")).alias("headword"), F.lit(None).cast("string").alias("reading"), F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("observed"))
    return lookup.discovered(asked, entries, keys, aliases, p.select(word("old").alias("alias"), word("w").alias("target"))).select("query_id", "entry_id", "match_type")


@query(f"with {_ENTRIES} select dict, headword, reading, definition from e where target is null")
def dictionary_database(t):
    """SRC-12, SRC-14, SNK-5: a dictionary's tables, written, counted and opened again; those of another version are skipped."""
    entries = _entries(t)
    spark, folder = entries.sparkSession, _folder(entries.sparkSession)
    bundles.database(entries, f"{folder}/a", 4)
    bundles.database(entries.limit(1), f"{folder}/b", 3)
    return bundles.databases(spark, [f"{folder}/b", f"{folder}/a"], 4).select("dict", "headword", "reading", "definition")


@query(with_(WORDS, query="select w, count(*) as n from words group by w"))
def stage_cache(t):
    """SRC-19, SNK-2: a stage's result, computed once, stored, and read again."""
    docs = t("documents")
    spark, folder = docs.sparkSession, _folder(docs.sparkSession)
    for _ in range(2):
        found = cache.cached(spark, folder, "documents", "exposures-1", lambda: text.words(docs).groupBy("w").agg(F.count("*").alias("n")), ["w", "n"])
    return found


@query(with_(LINES, query="select doc_id, line_no, line from lines"))
def snapshot_capture(t):
    """SNK-8: stages written by run and read again."""
    rows = tables.lines(t("documents")).select("doc_id", "line_no", "line")
    folder = _folder(rows.sparkSession)
    run = quality.capture({"lines": rows}, folder)
    return rows.sparkSession.read.parquet(f"{folder}/run_id={run}/stage=lines")


@query(catalogs.catalog_published_sql)
def catalog_compiled(t):
    """SNK-6: the published rules, compiled and read again."""
    tables_ = catalogs._tables(t)
    folder = _folder(tables_["concepts"].sparkSession)
    catalog.compile_catalog(tables_, folder, order=("rule_id", "concept_id", "label"))
    return tables_["concepts"].sparkSession.read.parquet(f"{folder}/rules")
