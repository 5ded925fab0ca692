"""URL filters by association rules.

Fixed host and path rules decide the URLs they fit, and those verdicts are the
labels.  Spark's FP-growth mines combinations of URL tokens that occur with a
verdict; rules of enough support and confidence are kept, less those that a
shorter rule with the same verdict and at least the same confidence covers.
A URL that no fixed rule fits takes the verdict of its best mined rule, found
by an inverted index on the rarest token of each rule; without one it is
allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzyspark.llm.common import written

# fixed values: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MARK = "verdict="
DEFAULT = "allow"
SUPPORT, CONFIDENCE = 0.02, 0.8


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return (F.translate(F.regexp_extract(url, AUTHORITY, 1), UPPER, LOWER), F.regexp_extract(url, AUTHORITY, 2))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of length, rule and verdict, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a URL's tokens, sorted: host labels, path parts and query keys.

    Digits become ``0`` and runs of them one, so numbered pages share tokens."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    tag = lambda t, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(t), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    return F.array_sort(F.array_distinct(F.concat(
        tag("h:", F.split(host, "[.]")), tag("p:", F.split(shape(path), "/")), tag("q:", keys),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled: items (tokens and the verdict's item).  Rules: ante, verdict, confidence, support."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled)
    to = F.col("consequent")[0]
    rules = (model.associationRules.filter(to.startswith(MARK))
             .filter(~F.exists("antecedent", lambda x: x.startswith(MARK)))
             .select(F.array_sort("antecedent").alias("ante"), F.substring(to, len(MARK) + 1, 100).alias("verdict"),
                     F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support")))
    rules = written(rules, "url-rules")
    # prune rules that a rule with one token less covers, as sound and for the same verdict
    shorter = rules.select(F.col("ante").alias("a2"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"))
    parts = rules.withColumn("a2", F.explode(F.transform(
        F.col("ante"), lambda x: F.filter(F.col("ante"), lambda y: y != x))))
    covered = (parts.join(shorter, "a2").filter((F.col("v2") == F.col("verdict")) & (F.col("c2") >= F.col("confidence")))
               .select("ante", "verdict").distinct())
    return rules.join(covered, ["ante", "verdict"], "left_anti")


def match(sets: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """sets: toks.  The best rule of each set: toks, verdict.

    The index holds every rule under its rarest token; a set meets the rules
    of its tokens and keeps those whose tokens it holds all.  Best: highest
    confidence, then support, then most tokens, then block before allow."""
    rare = (rules.withColumn("tok", F.explode("ante")).join(frequency, "tok")
            .groupBy("ante", "verdict", "confidence", "support")
            .agg(F.min(F.struct("n", "tok"))["tok"].alias("tok")))
    hits = (sets.withColumn("tok", F.explode("toks")).join(rare, "tok")
            .filter(F.size(F.array_except("ante", "toks")) == 0))
    best = F.max(F.struct("confidence", "support", F.size("ante").alias("n"), "verdict"))["verdict"]
    return hits.groupBy("toks").agg(best.alias("verdict"))


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A null url, or one without ``://``, has an empty host and path; it fits no
    rule and is allowed unless its remaining tokens say otherwise.  Rows that
    repeat keep a result each; equal rules tie as told above.  Where nothing is
    labelled, all pages without a fixed rule are allowed; an empty table gives
    no rows; further columns are ignored."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("fixed"),
                       tokens(F.col("url"), F.col("host"), F.col("path")).alias("toks"))
    rows = written(rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"),
                               F.col("fixed.verdict").alias("fixed"), "toks"), "urls")
    labelled = rows.filter("fixed IS NOT NULL").select(
        F.concat("toks", F.array(F.concat(F.lit(MARK), F.col("fixed")))).alias("items"))
    open_sets = rows.filter("fixed IS NULL").select("toks").distinct()
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit(DEFAULT)).alias("verdict"))
    frequency = (rows.filter("fixed IS NOT NULL").select(F.explode("toks").alias("tok"))
                 .groupBy("tok").agg(F.count(F.lit(1)).alias("n")))
    best = match(open_sets, mine(labelled, support, confidence), frequency).withColumnRenamed("verdict", "mined")
    found = rows.filter("fixed IS NULL").join(best, "toks", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("mined", F.lit(DEFAULT)).alias("verdict"))
    return rows.filter("fixed IS NOT NULL").select("page_id", "host", "path", "rule", F.col("fixed").alias("verdict")).unionByName(found)
