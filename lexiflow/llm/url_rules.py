"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

A fixed rule fits its host and all subdomains if the path starts with the
rule's; the longest one decides. For other urls the method decides: FP-growth
over the token sets of labelled urls (labels of the site's own rules, else
those of the document that the url names: a page is shown under its document's
id) finds frequent token combinations; those that imply a
label with enough confidence, and more of it than any combination with one
token less, are rules, however many there are. Rules lie in an inverted index
under their rarest token; a url looks up its tokens, checks the rest of each
rule found, and takes the verdict of the rule with the highest confidence, then
support, then the smaller token list. Without one the verdict is allow. Rules
are taken in blocks of at most ``BLOCK`` tokens, so that what a task and the
driver hold is bounded.

A url without ``://`` and a null url have an empty host and path and no token:
they're allowed. Long urls are read whole. Support counts rows, so repeated
rows count as often as they occur, and each gives a row of the result; null ids
are kept. With no labelled url there are no mined rules. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, label_rows, table

# fixed values: rules of the site
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Fit parameters: support (a share of the labelled urls, and rows at least) and confidence.
SUPPORT, FEWEST, CONFIDENCE = 0.002, 5, 0.9
#: Tokens of rules that are matched at a time.
BLOCK = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host_: Column, path_: Column, value: int) -> Column:
    """The longest rule that fits (value 0), or its verdict (value 1); null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(RULES, key=lambda r: len(r[0])):
        name, _, rest = rule[0].partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        out = F.when(fits, rule[value]).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: labels of the host but for www, segments of the path, and names of the query, each marked by its place."""
    labels = F.transform(F.array_remove(F.array_remove(F.split(host(url), r"\."), ""), "www"), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.array_remove(F.split(path(url), "/"), ""), lambda x: F.concat(F.lit("p:"), F.lower(x)))
    query = F.split(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit("")), "&")
    names = F.transform(query, lambda x: F.concat(F.lit("q:"), F.lower(F.substring_index(x, "=", 1))))
    return F.array_distinct(F.coalesce(F.concat(labels, segments, F.array_remove(names, "q:")), F.array().cast("array<string>")))


def document_id(url: Column) -> Column:
    """The id of the document that a url's path ends with, as in ``/en/12``, ``/en/12/`` and ``/en/12.html``; null without one."""
    return F.nullif(F.regexp_extract(path(url), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("")).try_cast("long")


def mine(labelled: DataFrame) -> DataFrame:
    """(x, y, confidence, freq): sorted tokens, verdict, confidence and support of the rules in (items, verdict)."""
    labelled = checkpointed(labelled.where("verdict is not null"))
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "x array<string>, y string, confidence double, freq long")
    least = max(FEWEST, -(-int(SUPPORT * n * 1000) // 1000))
    # rare tokens can't be in a rule; without them transactions are short
    frequent = labelled.select(F.explode("items").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = [r[0] for r in frequent.select("t").toLocalIterator()]  # at most (tokens of a url) / SUPPORT
    marked = labelled.select(F.concat(F.array_intersect("items", F.lit(common) if common else F.array().cast("array<string>")), F.array(F.concat(F.lit("y:"), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=least / n).fit(marked).freqItemsets
    sets = checkpointed(sets.select(F.sort_array(F.filter("items", lambda t: ~t.startswith("y:"))).alias("x"), F.get(F.filter("items", lambda t: t.startswith("y:")), F.lit(0)).alias("y"), "freq"))
    alone = sets.where("y is null and size(x) > 0").select("x", F.col("freq").alias("base"))
    rules = sets.where("y is not null and size(x) > 0").join(alone, "x").withColumn("confidence", F.col("freq") / F.col("base"))
    rules = checkpointed(rules.where(F.col("confidence") >= CONFIDENCE))
    parents = rules.select("x", "y", "confidence", F.explode("x").alias("t")).select("x", "y", "confidence", F.array_remove("x", F.col("t")).alias("p"))
    known = rules.select(F.col("x").alias("p"), "y", F.col("confidence").alias("c"))
    needless = parents.join(known, ["p", "y"]).where("c >= confidence").select("x", "y").distinct()
    return checkpointed(rules.join(needless, ["x", "y"], "left_anti").select("x", F.substring("y", 3, 10).alias("y"), "confidence", "freq"))


BEST = "struct<verdict: string, mined: array<string>, confidence: double, freq: bigint>"


def judge(rules: list[tuple[list[str], str, float, int]], items: str) -> Column:
    """Arrow UDF column (BEST): the best of the rules for a token list."""
    rules = sorted(rules, key=lambda r: (-r[2], -r[3], r[0]))
    counts: dict[str, int] = {}
    for x, _, _, f in rules:
        for t in x:
            counts[t] = max(counts.get(t, 0), f)
    index: dict[str, list[int]] = {}
    for k, (x, _, _, _) in enumerate(rules):
        index.setdefault(min(x, key=lambda t: (counts[t], t)), []).append(k)
    needs = [frozenset(x) for x, _, _, _ in rules]
    # rules come in the order in which they decide

    @F.arrow_udf(BEST)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.field("verdict", pa.string()), pa.field("mined", pa.list_(pa.string())), pa.field("confidence", pa.float64()), pa.field("freq", pa.int64())]
        for b in batches:
            best = []
            for given in b.to_pylist():
                own = set(given or ())
                best.append(min((k for t in own for k in index.get(t, ()) if needs[k] <= own), default=None))
            found = [None if k is None else rules[k] for k in best]
            columns = [[f and f[1] for f in found], [f and f[0] for f in found], [f and f[2] for f in found], [f and f[3] for f in found]]
            yield pa.StructArray.from_arrays([pa.array(c, kind.type) for c, kind in zip(columns, kinds)], fields=kinds)

    return judged.asNondeterministic()(F.col(items))


def judged_by(rows: DataFrame, rules: DataFrame, items: str, out: str) -> DataFrame:
    """``rows`` with ``out`` (BEST), the best rule for each; rules are taken block by block, and better ones replace what earlier blocks gave."""
    tokens_ = rules.agg(F.sum(F.size("x"))).first()[0] or 0
    blocks = max(1, -(-tokens_ // BLOCK))
    for k in range(blocks):
        part = rules.where(F.pmod(F.xxhash64("x"), F.lit(blocks)) == k)
        found = rows.withColumn("_m", judge([(list(r.x), r.y, r.confidence, r.freq) for r in part.select("x", "y", "confidence", "freq").toLocalIterator()], items))
        if k == 0:
            rows = found.withColumnRenamed("_m", out)
        else:
            m, o = F.col("_m"), F.col(out)
            same, even = m["confidence"] == o["confidence"], m["freq"] == o["freq"]
            wins = o["verdict"].isNull() | (m["confidence"] > o["confidence"]) | (same & (m["freq"] > o["freq"])) | (same & even & (m["mined"] < o["mined"]))
            rows = found.withColumn(out, F.when(m["verdict"].isNotNull() & wins, m).otherwise(o)).drop("_m")
        if blocks > 1:
            rows = checkpointed(rows)
    return rows


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) for each row of ``pages``."""
    url = F.col("url")
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    given = given.select("id", document_id(url).alias("document"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("items"))
    given = given.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), 0)).withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), 1))
    bad = label_rows(labels, "quality").withColumnRenamed("y", "good").join(label_rows(labels, "toxic").withColumnRenamed("y", "toxic"), "doc_id")
    known = bad.select(F.col("doc_id").alias("document"), F.when((F.col("good") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("label"))
    labelled = given.where("fixed is null").select("document", "items").join(known, "document").select("items", F.col("label").alias("verdict"))
    labelled = labelled.unionByName(given.where("fixed is not null").select("items", F.col("fixed").alias("verdict")))
    out = judged_by(given, mine(labelled), "items", "m")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", "m.verdict", F.lit("allow")).alias("verdict"), F.array_join("m.mined", " ").alias("mined"), F.col("m.confidence").alias("confidence"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; labels are those of the document that the url names."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
