"""Quality comparison of two snapshots: entities, changes, causes, summaries and gates.

Entities are rows (document, stage, key, start, end, value, status) of one
snapshot; changes come from one full outer join. Stages (stage, place) and
what each one needs (stage, ancestor, place of the ancestor), resource rules
and gate rules are small tables of the caller and are data, not code.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiflow.operators.snapshots import wilson

#: Severities from the worst on.
SEVERITIES = ("critical", "high", "medium", "info")
#: Characters of a bin in which ranges meet, and causes that a change names at most.
BIN, CAUSES = 512, 20


def verified(artifacts: DataFrame, content: str, expected: str) -> DataFrame:
    """``artifacts`` with ``sha256`` of their content and whether it's the expected one."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return artifacts.withColumn("sha256", digest).withColumn("sound", F.coalesce(digest == F.lower(expected), F.lit(False)))


def entities(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Entities (document, stage, key, value) of several artifacts, named in the order of their authority: of one key only the first artifact's values count, each value once."""
    rows = None
    for n, (name, df) in enumerate(parts):
        own = df.select("document", "stage", "key", "value", F.lit(n).alias("_n"), F.lit(name).alias("artifact"))
        rows = own if rows is None else rows.unionByName(own)
    first = F.min("_n").over(W.partitionBy("document", "stage", "key"))
    rows = rows.withColumn("_first", first).where("_n = _first")
    return rows.groupBy("document", "stage", "key", "artifact", F.sha2("value", 256).alias("value_hash")).agg(F.count("*").alias("copies"))


def scope(fields: Column) -> Column:
    """What a change's fields touch: ranges before decisions before content."""
    has = lambda *names: F.arrays_overlap(fields, F.array(*map(F.lit, names)))
    return F.when(has("start", "end"), "range").when(has("status"), "decision").when(has("evidence") & (F.size(fields) == 1), "evidence").otherwise("content")


def severity(stage: Column, operation: Column, scope_: Column, critical: tuple[str, ...], guarded: tuple[str, ...]) -> Column:
    return F.when(stage.isin(*critical), "critical").when(scope_ == "evidence", "info").when(stage.isin(*guarded) & ((operation == "removed") | scope_.isin("decision", "range")), "high").otherwise("medium")


def changes(before: DataFrame, after: DataFrame, critical: tuple[str, ...] = (), guarded: tuple[str, ...] = ()) -> DataFrame:
    """(document, stage, key, start, end, operation, scope, severity, status_before, status_after, fields) of what isn't the same in both."""
    facts = ["start", "end", "value", "status"]
    a, b = (df.select("document", "stage", "key", F.struct(*facts).alias(n)) for df, n in ((before, "a"), (after, "b")))
    rows = a.join(b, ["document", "stage", "key"], "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in facts]))
    operation = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(fields) > 0, "modified")
    rows = rows.withColumn("operation", operation).where("operation is not null").withColumn("fields", F.when(F.col("operation") == "modified", fields).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("scope", scope(F.col("fields")))
    return rows.select(
        "document", "stage", "key", F.coalesce("a.start", "b.start").alias("start"), F.coalesce("a.end", "b.end").alias("end"), "operation", "scope",
        severity(F.col("stage"), F.col("operation"), F.col("scope"), critical, guarded).alias("severity"), F.coalesce("a.status", F.lit("absent")).alias("status_before"), F.coalesce("b.status", F.lit("absent")).alias("status_after"), "fields",
    )


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, l, r) of rows whose ranges (start, end) share a place, as structs of their other columns.

    Ranges are put into bins of BIN characters and meet in the bin in which
    their shared places begin, so a pair comes once and nothing is compared
    outside its own bins.
    """
    pack = lambda df, n: df.where(F.col("end") > F.col("start")).select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(n), F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("_bin"))
    rows = pack(left, "l").join(pack(right, "r"), [*keys, "_bin"])
    begin = F.greatest("l.start", "r.start")
    return rows.where((begin < F.least("l.end", "r.end")) & (F.floor(begin / BIN) == F.col("_bin"))).drop("_bin")


def causes(changes_: DataFrame, needs: DataFrame) -> DataFrame:
    """``changes_`` with causal_status, cause_stage and causes: changes of the nearest earlier stage that touch the same places, CAUSES at most; without any a change is a root."""
    # each stage's changes also stand for the stages that need it
    up = changes_.join(F.broadcast(needs.select(F.col("stage").alias("for_stage"), F.col("ancestor").alias("stage"), "place")), "stage")
    up = up.select("document", F.col("for_stage").alias("stage"), "start", "end", F.col("stage").alias("from_stage"), F.col("key").alias("from_key"), "place")
    pairs = overlapping(changes_.select("document", "stage", "start", "end", "key"), up, ["document", "stage"])
    found = pairs.select("document", "stage", F.col("l.key").alias("key"), F.col("r.place").alias("place"), F.col("r.from_stage").alias("cause_stage"), F.col("r.from_key").alias("cause"))
    near = W.partitionBy("document", "stage", "key").orderBy(F.desc("place"))
    found = found.withColumn("d", F.dense_rank().over(near)).where("d = 1").withColumn("k", F.row_number().over(near.orderBy("cause"))).where(F.col("k") <= CAUSES)
    named = found.groupBy("document", "stage", "key").agg(F.first("cause_stage").alias("cause_stage"), F.array_sort(F.collect_list("cause")).alias("causes"))
    rows = changes_.join(named, ["document", "stage", "key"], "left")
    return rows.withColumn("causal_status", F.when(F.col("causes").isNull(), "root").otherwise("propagated_candidate"))


def stage_summary(stages: DataFrame, before: DataFrame, after: DataFrame, caused: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row for each of ``stages`` (stage, place), even where nothing was captured: coverage, entities, changes, roots, churn and its interval.

    ``blocked`` (stage) are those whose contracts differ.
    """
    count = lambda df, n: df.groupBy("stage").agg(F.count("*").alias(n))
    own = caused.groupBy("stage").agg(F.count("*").alias("changes"), F.count_if(F.col("causal_status") == "root").alias("roots"), F.count_if(F.col("operation") == "added").alias("added"))
    rows = stages.join(count(before, "before_n"), "stage", "left").join(count(after, "after_n"), "stage", "left").join(own, "stage", "left").join(blocked.select("stage").distinct().withColumn("stopped", F.lit(True)), "stage", "left")
    coverage = F.when(F.col("stopped"), "contract_mismatch").when(F.col("before_n").isNotNull() & F.col("after_n").isNotNull(), "comparable").when(F.col("before_n").isNotNull(), "before_only").when(F.col("after_n").isNotNull(), "after_only").otherwise("missing")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = [zero(F.col(c)).alias(c) for c in ("before_n", "after_n", "changes", "roots")]
    units = zero(F.col("before_n")) + zero(F.col("added"))
    rows = rows.select("stage", "place", coverage.alias("coverage"), *counts, units.alias("units"))
    low, high = wilson(F.col("changes").cast("double"), F.col("units").cast("double"))
    rate = F.round(F.coalesce(F.try_divide("changes", "units"), F.lit(0.0)), 8)
    return rows.withColumns({"rate": rate, "low": low, "high": high})


def conclusion(summary: DataFrame, source: tuple[str, ...]) -> DataFrame:
    """(comparable, conclusion): paused where a source stage changed, partial where a stage is missing or can't be compared, else eligible."""
    changed = F.max((F.col("stage").isin(*source) & (F.col("changes") > 0)).cast("int")) == 1
    some, all_ = F.max((F.col("coverage") == "comparable").cast("int")) == 1, F.min((F.col("coverage") == "comparable").cast("int")) == 1
    rows = summary.agg(changed.alias("changed"), some.alias("some"), all_.alias("whole"))
    return rows.select((~F.col("changed") & F.col("some")).alias("comparable"), F.when(F.col("changed"), "paused_input_changed").when(F.col("whole"), "eligible").otherwise("partial").alias("conclusion"))


def metrics(summary: DataFrame, caused: DataFrame, ending: DataFrame, mismatches: DataFrame) -> DataFrame:
    """(kind, target, value) that gate rules ask for; flags are 1 for what a rule objects to."""
    row = lambda df, kind, target, value: df.select(F.lit(kind).alias("kind"), target.alias("target"), value.cast("double").alias("value"))
    none = F.lit("")
    total = summary.agg(F.sum("roots").alias("roots"), F.sum("changes").alias("changes"), F.sum("units").alias("units"))
    counted = lambda kind, target, df=caused: row(df.groupBy(target.alias("_t")).agg(F.count("*").alias("n")), kind, F.col("_t"), F.col("n"))
    parts = [
        row(ending, "comparable", none, (~F.col("comparable")).cast("int")),
        row(ending, "quality_conclusion", F.col("conclusion"), F.lit(1)),
        row(summary.where("coverage = 'missing'"), "missing_stage", F.col("stage"), F.lit(1)),
        row(summary, "required_stage", F.col("stage"), (F.col("coverage") != "comparable").cast("int")),
        row(mismatches.agg(F.count("*").alias("n")), "contract_mismatches", none, F.col("n")),
        row(total, "max_root_changes", none, F.col("roots")),
        row(total, "max_churn_rate", none, F.round(F.coalesce(F.try_divide("changes", "units"), F.lit(0.0)), 8)),
        counted("max_severities", F.col("severity")),
        counted("max_scope_changes", F.col("scope")),
        counted("max_status_transitions", F.concat_ws("->", "status_before", "status_after")),
        row(summary, "stage_known", F.col("stage"), F.lit(0)),
        row(summary, "stage_max_changes", F.col("stage"), F.col("changes")),
        row(summary, "stage_max_churn_rate", F.col("stage"), F.col("rate")),
        counted("stage_max_scopes", F.concat_ws("/", "stage", "scope")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Rules that object to what they don't name: of each kind, all metrics but the allowed targets.
ALLOWING = ("quality_conclusion", "missing_stage")


def gate(rules: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, kind, target, actual, violated, blocking) for ``rules`` (rule, kind, target, maximum, blocking).

    A rule is violated if its metric is over its maximum, absent metrics being
    0, but for a stage that isn't known at all. Rules of the kinds ALLOWING
    name what may be; whatever else is found of that kind is a violation.
    """
    measured = found.groupBy("kind", "target").agg(F.max("value").alias("value"))
    allowing = rules.where(F.col("kind").isin(*ALLOWING))
    others = measured.where(F.col("kind").isin(*ALLOWING)).join(allowing.select("kind").distinct(), "kind", "left_semi").join(allowing.select("kind", "target"), ["kind", "target"], "left_anti")
    others = others.select(F.col("kind").alias("rule"), "kind", "target", F.col("value").alias("actual"), F.lit(True).alias("violated"), F.lit(True).alias("blocking"))
    rows = rules.where(~F.col("kind").isin(*ALLOWING)).join(measured, ["kind", "target"], "left")
    actual = F.when(F.col("kind") == "stage_known", F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).otherwise(F.coalesce("value", F.lit(0.0)))
    return rows.select("rule", "kind", "target", actual.alias("actual"), (actual > F.col("maximum")).alias("violated"), "blocking").unionByName(others)


def verdict(judged: DataFrame) -> DataFrame:
    """(status, violations): blocked by a violated blocking rule, under review by any other."""
    n, blocks = F.count_if("violated"), F.count_if(F.col("violated") & F.col("blocking"))
    return judged.agg(F.when(blocks > 0, "blocked").when(n > 0, "review_required").otherwise("passed").alias("status"), n.alias("violations"))


def contract_mismatches(before: DataFrame, after: DataFrame, covers: DataFrame) -> DataFrame:
    """(artifact, stage): stages that ``covers`` (artifact, stage) lists for artifacts that both snapshots have under different contracts (adapter, capture)."""
    a, b = (df.select("artifact", F.struct("adapter", "capture").alias(n)) for df, n in ((before, "a"), (after, "b")))
    return a.join(b, "artifact").where(~F.col("a").eqNullSafe(F.col("b"))).select("artifact").join(covers, "artifact")


def affected_stages(resources: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, name, stages): of ``rules`` (place, kind, kind_prefix, part, stages) the first whose kind, start of the kind, or part of the name fits; null conditions always fit."""
    fits = F.expr("(r.kind is null or r.kind = x.kind) and (r.kind_prefix is null or startswith(x.kind, r.kind_prefix)) and (r.part is null or contains(lower(x.name), r.part))")
    rows = resources.select("kind", "name").distinct().alias("x").join(F.broadcast(rules).alias("r"), fits)
    return rows.groupBy("x.kind", "x.name").agg(F.min_by("r.stages", "r.place").alias("stages"))


def ordered(changes_: DataFrame, stages: DataFrame) -> DataFrame:
    """``changes_`` with ``place`` within their document: by stage, severity, range and key."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = changes_.join(F.broadcast(stages.select("stage", F.col("place").alias("_stage"))), "stage")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("document").orderBy("_stage", rank, "start", "end", "key")).cast("long")).drop("_stage")


def severity_counts(changes_: DataFrame) -> DataFrame:
    """(place, severity, n): all severities in their fixed order, those that don't occur with 0."""
    spine = changes_.sparkSession.createDataFrame(list(enumerate(SEVERITIES)), "place int, severity string")
    return spine.join(changes_.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("place", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def sides(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(diff_id, path, how) for (diff_id, run_id, sha256): the snapshot of that run with the same digest, else the run's only one, else none."""
    snaps = snapshots.groupBy("run_id", "sha256").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    runs = snaps.groupBy("run_id").agg(F.sum("n").alias("n"), F.min("path").alias("only"))
    rows = diffs.join(snaps.select("run_id", "sha256", "path"), ["run_id", "sha256"], "left").join(runs.where("n = 1").select("run_id", "only"), "run_id", "left")
    return rows.select("diff_id", F.coalesce("path", "only").alias("path"), F.when(F.col("path").isNotNull(), "digest").when(F.col("only").isNotNull(), "run").otherwise("none").alias("how"))


def completed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, manifest, summary): folders anywhere under ``folder`` that hold both a manifest.json and a summary.json; a run without one of them isn't complete."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("content").cast("string").alias("text"))
    one = lambda name: F.max(F.when(F.col("file") == name, F.col("text")))
    return rows.groupBy("path").agg(one("manifest.json").alias("manifest"), one("summary.json").alias("summary")).where("manifest is not null and summary is not null")


def write_bundle(caused: DataFrame, summary: DataFrame, folder: str) -> None:
    """A diff bundle: changes and stage rows as JSON lines, and a manifest of their counts."""
    caused.write.mode("overwrite").json(f"{folder}/diff")
    summary.orderBy("place").write.mode("overwrite").json(f"{folder}/stages")
    counts = caused.agg(F.count("*").alias("changes")).crossJoin(summary.agg(F.count("*").alias("stages")))  # one row each
    counts.write.mode("overwrite").json(f"{folder}/manifest")


def descriptor(value: Column, limit: int = 480) -> Column:
    """A value, or for one of more than ``limit`` bytes what kind it is, how many bytes, and its digest."""
    size = F.octet_length(value)
    kind = F.when(value.startswith("{"), "object").when(value.startswith("["), "array").otherwise("string")
    items = F.when(kind == "array", F.json_array_length(value)).when(kind == "object", F.size(F.json_object_keys(value)))
    large = size > limit
    return F.struct(F.when(~large, value).alias("value"), F.when(large, kind).alias("kind"), F.when(large, items).alias("items"), F.when(large, size).alias("bytes"), F.when(large, F.sha2(value, 256)).alias("sha256"))


def compared_rows(left: DataFrame, right: DataFrame, group: str, order: list[str], fields: list[str]) -> DataFrame:
    """(group, rows_left, rows_right, differing, first): two tables row by row in their order, the longer one against nothing, and the first place where they differ."""
    number = lambda df, n: df.select(group, F.row_number().over(W.partitionBy(group).orderBy(*order)).alias("k"), F.sha2(F.to_json(F.struct(*fields)), 256).alias(n))
    rows = number(left, "a").join(number(right, "b"), [group, "k"], "full_outer")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return rows.groupBy(group).agg(F.count("a").alias("rows_left"), F.count("b").alias("rows_right"), F.count_if(differs).alias("differing"), F.min(F.when(differs, F.col("k"))).cast("long").alias("first"))


def asserted(found: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, missing, forbidden, passed): ``cases`` (case_id, expected, unwanted) against (case_id, concept)."""
    present = found.groupBy("case_id").agg(F.collect_set("concept").alias("present"))
    rows = cases.join(present, "case_id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    missing, bad = F.array_sort(F.array_except("expected", "present")), F.array_sort(F.array_intersect("unwanted", "present"))
    return rows.select("case_id", missing.alias("missing"), bad.alias("forbidden"), ((F.size(missing) == 0) & (F.size(bad) == 0)).alias("passed"))


def verification(decisions: DataFrame, by: str, decision: str) -> DataFrame:
    """(by, total, verified, rejected, pending, pass_rate): the share of verified ones among those that aren't pending, in percent."""
    n = lambda d: F.count_if(F.col(decision) == d)
    rows = decisions.groupBy(by).agg(F.count("*").alias("total"), n("verified").alias("verified"), n("rejected").alias("rejected"), n("pending").alias("pending"))
    return rows.withColumn("pass_rate", F.round(F.coalesce(F.try_divide(100 * F.col("verified"), F.col("total") - F.col("pending")), F.lit(0.0)), 4))


def timings(rows: DataFrame, phase: str, took: str) -> DataFrame:
    """(phase, total, n, place): time by phase, in the order of the phases, which are few."""
    sums = rows.groupBy(F.col(phase).alias("phase")).agg(F.round(F.sum(took), 4).alias("total"), F.count("*").alias("n"))
    return sums.withColumn("place", F.row_number().over(W.orderBy("phase")).cast("long"))


def residual_rate(docs: DataFrame, words: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, n, residuals, rate) for each of ``docs``: its words that aren't known, and their share."""
    rows = words.groupBy("doc_id", "w").agg(F.count("*").alias("k")).join(known.select("w").withColumn("_known", F.lit(1)), "w", "left")
    sums = rows.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("_known").isNull(), F.col("k")).otherwise(0)).alias("residuals"))
    n, r = (F.coalesce(c, F.lit(0)) for c in ("n", "residuals"))
    return docs.join(sums, "doc_id", "left").select("doc_id", n.alias("n"), r.alias("residuals"), F.round(F.coalesce(F.try_divide(r, n), F.lit(0.0)), 6).alias("rate"))


def unit_metrics(lines: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, lines, units, boundaries, failures): units of each line, boundaries between units of one line, and lines without any."""
    counts = units.groupBy("doc_id", "line_no").agg(F.count("*").alias("k"))
    rows = lines.join(counts, ["doc_id", "line_no"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("k").alias("units"), F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("boundaries"), F.count_if(F.col("k") == 0).alias("failures"))


def capture(stages: dict[str, DataFrame], folder: str) -> str:
    """Write each stage's rows under ``folder`` by run, and a manifest of their counts and digests; the run's id is the digest of these.

    A digest is the sum of the rows' own hashes, so it's the same whatever the order and the partitions, and takes one pass.
    """
    spark = next(iter(stages.values())).sparkSession
    facts = []
    for name, df in sorted(stages.items()):
        h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        n, total = df.agg(F.count("*"), F.sum(h)).first()
        facts.append((name, n, hashlib.sha256(f"{n}:{total or 0}".encode()).hexdigest()))
    run = hashlib.sha256(repr(facts).encode()).hexdigest()[:20]
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{folder}/run_id={run}/stage={name}")
    rows = spark.createDataFrame(facts, "stage string, rows long, sha256 string")
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/run_id={run}/manifest")
    return run


def history_index(runs: DataFrame) -> DataFrame:
    """(place, path, run_id, changes, status) of complete runs (path, manifest, summary), the newest run id first; what their JSON lacks is null."""
    rows = runs.select("path", F.get_json_object("manifest", "$.run_id").alias("run_id"), F.get_json_object("summary", "$.changes").cast("long").alias("changes"), F.get_json_object("summary", "$.status").alias("status"))
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("run_id"), "path"))  # a row for each run: few
    return rows.select(place.cast("long").alias("place"), "path", "run_id", "changes", "status")


def aligned_lines(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, op, a0, a1, b0, b1): how the lines of one version become those of the other, from (key, lines array<string>) of both; a document that only one has is all new or all gone."""
    from lexiflow.functions.scalars import opcodes

    none = F.array().cast("array<string>")
    rows = before.select(key, F.col("lines").alias("a")).join(after.select(key, F.col("lines").alias("b")), key, "full_outer")
    ops = rows.select(key, F.explode(opcodes(F.coalesce("a", none), F.coalesce("b", none))).alias("o"))
    return ops.select(key, F.col("o.tag").alias("op"), "o.a0", "o.a1", "o.b0", "o.b1")
