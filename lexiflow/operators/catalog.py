"""Rule catalogues: bundles as they're written, the tables they mean, their checks, a search index, and a compiled form.

A bundle is JSON: ``{"id": ..., "defaults": {...}, "concepts": [{"id", "label",
"kind", "level", "status", "domains", "senses": [{"id", "text"}], "rules":
[{"id", "priority", "captures", "template", "refines", "examples",
"counter_examples", "status"}]}], "redirects": [{"source", "target"}]}``. What a
concept or rule leaves out comes from the bundle's defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexiflow.operators.snapshots import closure

SENSE = "struct<id: string, text: string>"
RULE = "struct<id: string, priority: int, captures: array<string>, template: string, refines: string, examples: array<string>, counter_examples: array<string>, status: string>"
CONCEPT = f"struct<id: string, label: string, kind: string, level: int, status: string, domains: array<string>, senses: array<{SENSE}>, rules: array<{RULE}>>"
BUNDLE = f"id string, defaults struct<level: int, status: string, kind: string>, concepts array<{CONCEPT}>, redirects array<struct<source: string, target: string>>"
ID = r"^[a-z0-9]+([._-][a-z0-9]+)*$"
STATUSES = ("verified", "pending", "rejected")


def expanded(bundles: DataFrame, text: str = "bundle") -> dict[str, DataFrame]:
    """Tables ``concepts``, ``senses``, ``rules`` and ``redirects`` of JSON bundles, with defaults filled in."""
    b = bundles.select(F.from_json(text, T._parse_datatype_string(BUNDLE)).alias("b"))
    c = b.select(F.col("b.id").alias("bundle_id"), F.col("b.defaults").alias("d"), F.explode("b.concepts").alias("c"))
    concepts = c.select("bundle_id", F.col("c.id").alias("concept_id"), F.col("c.label").alias("label"), F.coalesce("c.kind", "d.kind", F.lit("concept")).alias("kind"), F.coalesce("c.level", "d.level").alias("level"), F.coalesce("c.status", "d.status", F.lit("pending")).alias("status"), F.coalesce("c.domains", F.array().cast("array<string>")).alias("domains"))
    senses = c.select("bundle_id", F.col("c.id").alias("concept_id"), F.posexplode("c.senses").alias("place", "s")).select("bundle_id", F.col("s.id").alias("sense_id"), "concept_id", "place", F.col("s.text").alias("text"))
    empty = F.array().cast("array<string>")
    r = c.select("bundle_id", "d", F.col("c.id").alias("concept_id"), F.explode("c.rules").alias("r"))
    rules = r.select("bundle_id", F.col("r.id").alias("rule_id"), "concept_id", F.coalesce("r.priority", F.lit(0)).alias("priority"), F.coalesce("r.captures", empty).alias("captures"), F.coalesce("r.template", F.lit("")).alias("template"), F.col("r.refines").alias("refines"), F.coalesce("r.examples", empty).alias("examples"), F.coalesce("r.counter_examples", empty).alias("counter_examples"), F.coalesce("r.status", "d.status", F.lit("pending")).alias("status"))
    redirects = b.select(F.explode("b.redirects").alias("x")).select("x.source", "x.target")
    return {"concepts": concepts, "senses": senses, "rules": rules, "redirects": redirects}


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """(check, item) of all that is wrong with a catalogue; empty for a sound one."""
    concepts, senses, rules, redirects = (t[n] for n in ("concepts", "senses", "rules", "redirects"))
    flag = lambda df, check, item: df.select(F.lit(check).alias("check"), F.col(item).alias("item"))
    twice = lambda df, key: flag(df.groupBy(key).count().where("count > 1"), f"duplicate_{key}", key)
    known, known_rules = concepts.select("concept_id").distinct(), rules.select(F.col("rule_id").alias("refines")).distinct()
    named = F.regexp_extract_all("template", F.lit(r"\{\{([^{}]*)\}\}"), 1)
    ends = redirects.select(F.explode(F.array("source", "target")).alias("concept_id"))
    parts = [
        twice(concepts, "concept_id"), twice(senses, "sense_id"), twice(rules, "rule_id"), twice(redirects, "source"),
        flag(concepts.where(~F.col("concept_id").rlike(ID)), "bad_id", "concept_id"), flag(rules.where(~F.col("rule_id").rlike(ID)), "bad_id", "rule_id"),
        flag(concepts.where(~F.col("status").isin(*STATUSES)), "unknown_status", "concept_id"),
        flag(senses.where(F.coalesce(F.trim("text"), F.lit("")) == ""), "sense_without_text", "sense_id"),
        flag(concepts.join(senses.select("concept_id").distinct(), "concept_id", "left_anti"), "concept_without_sense", "concept_id"),
        flag(rules.join(known_rules, "refines", "left_anti").where("refines is not null"), "dangling_refines", "rule_id"),
        flag(rules.where(F.size(F.array_except(F.array_except(named, "captures"), F.array(F.lit("actual_form")))) > 0), "unbound_placeholder", "rule_id"),
        flag(rules.where((F.col("status") == "verified") & ((F.size("examples") == 0) | (F.size("counter_examples") == 0))), "verified_without_examples", "rule_id"),
        flag(ends.join(known, "concept_id", "left_anti").distinct(), "dangling_redirect", "concept_id"),
        flag(closure(redirects.select(F.col("source").alias("child"), F.col("target").alias("parent"))).where("child = ancestor"), "redirect_cycle", "child"),
    ]
    return reduce(DataFrame.unionByName, parts)


def targets(redirects: DataFrame) -> DataFrame:
    """(source, target, hops): where each redirect ends; chains that run in a circle end nowhere and are left out."""
    up = closure(redirects.select(F.col("source").alias("child"), F.col("target").alias("parent")))
    ends = up.join(redirects.select(F.col("source").alias("ancestor")), "ancestor", "left_anti")
    return ends.select(F.col("child").alias("source"), F.col("ancestor").alias("target"), F.col("distance").alias("hops"))


def published(t: dict[str, DataFrame], order: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """(rule_id, concept_id, label, senses, status, place): rules with their concept after redirects; accepted only if rule and concept are verified and all senses have a text; placed by priority, then ``order``; of rules that are equal in all of it the later concept's before redirects comes first."""
    moved = targets(t["redirects"])
    rules = t["rules"].withColumn("_source", F.col("concept_id")).join(moved.select(F.col("source").alias("concept_id"), F.col("target").alias("_to")), "concept_id", "left").withColumn("concept_id", F.coalesce("_to", "concept_id")).drop("_to")
    senses = t["senses"].groupBy("concept_id").agg(F.count("*").alias("senses"), F.every(F.coalesce(F.trim("text"), F.lit("")) != "").alias("_told"))
    rows = rules.join(t["concepts"].select("concept_id", "label", F.col("status").alias("_concept")), "concept_id").join(senses, "concept_id", "left")
    sound = (F.col("status") == "verified") & (F.col("_concept") == "verified") & F.coalesce("_told", F.lit(False))
    # a catalogue is a small table: its order needs one window over all of it
    place = F.row_number().over(W.orderBy(F.desc("priority"), *order, F.desc("_source"), F.desc("status")))
    return rows.select("rule_id", "concept_id", "label", F.coalesce("senses", F.lit(0)).alias("senses"), F.when(sound, "accepted").otherwise("pending").alias("status"), place.cast("long").alias("place"))


def search_index(t: dict[str, DataFrame]) -> DataFrame:
    """(concept_id, label, kind, level, status, domains, aliases, hints): concepts with the labels of those that redirect to them and the texts of their senses."""
    named = targets(t["redirects"]).join(t["concepts"].select(F.col("concept_id").alias("source"), F.col("label").alias("_label")), "source")
    aliases = named.groupBy(F.col("target").alias("concept_id")).agg(F.array_sort(F.collect_set("_label")).alias("aliases"))
    hints = t["senses"].groupBy("concept_id").agg(F.array_sort(F.collect_set("text")).alias("hints"))
    none = F.array().cast("array<string>")
    rows = t["concepts"].join(aliases, "concept_id", "left").join(hints, "concept_id", "left")
    return rows.select("concept_id", "label", "kind", "level", "status", "domains", F.coalesce("aliases", none).alias("aliases"), F.coalesce("hints", none).alias("hints"))


def search(index: DataFrame, text: str | None = None, family: str | None = None, level: int | None = None, status: str | None = None) -> DataFrame:
    """Concepts of the index of that status, level and family (a kind or a domain) that have the text in some field, whatever its case."""
    if status is not None:
        index = index.where(F.col("status") == status)
    if level is not None:
        index = index.where(F.col("level") == level)
    if family is not None:
        index = index.where((F.col("kind") == family) | F.array_contains("domains", family))
    if text:
        held = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
        index = index.where(held(F.col("concept_id")) | held(F.col("label")) | F.exists("domains", held) | F.exists("aliases", held) | F.exists("hints", held))
    return index


def fingerprint(table: DataFrame, key: str) -> DataFrame:
    """(n, sha256): the rows of a small table as JSON, in the order of their key."""
    rows = table.select(F.struct(F.col(key).alias("k"), F.to_json(F.struct(*sorted(table.columns))).alias("j")).alias("r"))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), "\n"), 256).alias("sha256"))


def compile_catalog(t: dict[str, DataFrame], folder: str, check: bool = False, order: tuple[str, ...] = ("rule_id",)) -> bool:
    """Write the published rules, the search index and a manifest of their digests; with ``check`` write nothing. True if what was there is up to date."""
    spark = t["concepts"].sparkSession
    parts = {"rules": (published(t, order), "rule_id"), "index": (search_index(t), "concept_id")}
    digests = {n: fingerprint(df, key).first()["sha256"] for n, (df, key) in parts.items()}
    try:
        old = {r["name"]: r["sha256"] for r in spark.read.json(f"{folder}/manifest").collect()}
    except Exception as e:  # noqa: BLE001  (no catalogue yet)
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = {}
    fresh = old == digests
    if not check and not fresh:
        for n, (df, _) in parts.items():
            df.write.mode("overwrite").parquet(f"{folder}/{n}")
        spark.createDataFrame(sorted(digests.items()), "name string, sha256 string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return fresh
