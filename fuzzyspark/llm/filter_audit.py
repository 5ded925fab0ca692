"""Filter interaction audit by difference arrays over the Lehmer ranks of filter orders.

A document is a mask of the filters it fails.  Applied in some order, the
filters remove it at the first of them that is in its mask.  Orders that begin
alike are neighbours in the lexicographic order of permutations: a prefix of
s filters covers the (n - s)! ranks from its Lehmer rank on.  So the orders
that remove a mask at step s are a few intervals of ranks, one for every
prefix of s - 1 filters outside the mask and one filter in it.  Documents are
counted by part and mask, the counts are added at the intervals' ends, and a
running sum over the ranks gives every order's totals.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.llm.common import lookup, text_of, written

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Rank of the first permutation of 0..n-1, in lexicographic order, that begins with ``prefix``."""
    return sum(sum(x < f and x not in prefix[:i] for x in range(n)) * factorial(n - 1 - i) for i, f in enumerate(prefix))


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, end rank): the orders of n filters that remove a mask's documents at that step."""
    out = []
    for mask in range(1, 1 << n):
        inside = [f for f in range(n) if mask >> f & 1]
        outside = [f for f in range(n) if not mask >> f & 1]
        for s in range(1, len(outside) + 2):
            for before in permutations(outside, s - 1):
                for f in inside:
                    at = lehmer_rank((*before, f), n)
                    out.append((mask, s, at, at + factorial(n - s)))
    return out


def text_failures(text: Column) -> Column:
    """The mask of filters A to D; E needs the other documents."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [F.size(words) < MIN_WORDS,
             F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * MIN_DISTINCT,
             upper * 100 > F.length(text).cast("long") * MAX_UPPER,
             text.rlike(SYMBOLS)]
    return sum((x.cast("int") * (1 << i) for i, x in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by source and set of failed filters.

    Repeated rows are counted before anything is joined, so neither a text nor
    a doc_id that many rows share meets in one task."""
    slim = written(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                               text_failures(text_of()).alias("mask"), F.unhex(F.sha2(text_of(), 256)).alias("sha")), "failures")
    rows = slim.groupBy("doc_id", "part", "mask", "sha").agg(F.count(F.lit(1)).alias("n"))
    first = written(slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .filter("last > first").drop("last"), "copies")
    marks = written(labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic")).filter("is_good OR is_toxic"), "marks")
    rows = lookup(rows, first, ["sha"], F.col("doc_id"), first.count())
    rows = lookup(rows, marks, ["doc_id"], F.col("sha"), marks.count())
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("n"), counted("is_good").alias("good"), counted("is_toxic").alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counts: part, mask, n, good, toxic (bit i of mask: filter i fails).

    One row per part, order of the filters and step, zeros included: kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.  The
    rows of a part are a fixed number, (number of orders) x (number of steps)."""
    spark, n = counts.sparkSession, len(filters)
    counts = written(counts, "masks")
    orders = ["".join(p) for p in permutations(filters)]
    steps = F.broadcast(spark.createDataFrame(removal_intervals(n), "mask int, step int, first int, end int"))
    ends = (counts.join(steps, "mask")
            .select("part", "step", "n", "good", "toxic", F.explode(F.array(
                F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")),
                F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))).alias("e")))
    added = lambda c: F.sum(F.col(c) * F.col("e.sign")).alias(c)
    diff = ends.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(added("n"), added("good"), added("toxic"))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)) for i in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = (parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    at = grid.join(diff, ["part", "step", "rank"], "left")
    w = Window.partitionBy("part", "step").orderBy("rank")
    running = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    order = F.element_at(F.array(*[F.lit(o) for o in orders]), F.col("rank") + 1)
    out = (at.withColumns({"removed": running("n"), "good_lost": running("good"), "toxic_lost": running("toxic"), "filter_order": order})
           .withColumn("letter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
           .withColumn("i", F.expr(f"locate(letter, '{filters}')")))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    long = lambda c: c.cast("long")
    return out.select(
        "part", "filter_order", "step", long(F.col("total") - F.sum("removed").over(so_far)).alias("kept"),
        long(F.col("removed")).alias("removed"), long(F.element_at("fails", F.col("i")) - F.col("removed")).alias("redundant"),
        long(F.element_at("alone", F.col("i"))).alias("unique_fails"), long(F.col("good_lost")).alias("good_lost"),
        long(F.col("toxic_lost")).alias("toxic_lost"),
        long(F.sum("removed").over(Window.partitionBy("part", "letter"))).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents in all 120 orders; see ``interactions``.

    A null text counts as empty (it fails A alone), a null source is the part
    of the empty string.  Rows that repeat count each.  E compares doc_ids: a
    null id is no copy and makes none, rows of one id are no copies of each
    other.  A document with several labels is good (toxic) if any says so; a
    null or missing label says neither.  An empty table gives no rows; further
    columns are ignored."""
    return interactions(masks(docs, labels))


def oracle() -> str:
    """DuckDB SQL for ``audit``: the first failed filter of every mask in every order, one by one."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN len(words) < {MIN_WORDS} THEN 'A' END,
         CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 'B' END,
         CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {MAX_UPPER} * length(text) THEN 'C' END,
         CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 'D' END,
         CASE WHEN doc_id > first THEN 'E' END) AS failed
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS letter, substr(filter_order, 1, s - 1) AS before
  FROM o, range(1, 6) t(s)),
r AS (SELECT m.part, s.filter_order, s.step, s.letter, n, good, toxic, failed,
  contains(failed, letter) AS fails, before <> '' AND length(translate(failed, before, '')) < length(failed) AS gone
  FROM m, s),
t AS (SELECT part, filter_order, step, letter,
  sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM t"""
