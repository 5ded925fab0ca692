"""Mixing sources to target weights by hash-threshold histograms.

Each source has a budget of words.  A budget is met by whole passes over the
source plus one part pass: the documents whose hash lies below a threshold.
Thresholds are nested, so a larger budget keeps what a smaller one took.  The
threshold is found without a sort: words are summed by source and leading
hash bits, the bucket that holds the budget's end is located, and only that
bucket is summed again by its next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.llm.common import hash60, lookup, numbered, packed, sql_hash60, text_of, unpacked, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: hash bits, and bits resolved by one histogram
HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sums: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """sums: source, source_size.  Adds target, the words to take from each source.

    Sources in code point order, null last, weigh as ``weights`` repeats; they
    share the sum of all sizes, none above ``max_passes`` times its size.  The
    share per weight rises with every round of resharing until no further
    source is above its limit; each round is one small aggregate."""
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = numbered(sums, [], order, "sources", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight)
                     .withColumn("limit", F.col("source_size") * max_passes), "targets")
    share = 0.0
    while True:
        full = F.col("limit") <= F.lit(share) * F.col("weight")
        r = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("limit"))),
                       F.sum(F.when(~full, F.col("weight")))).first()
        nxt = (r[0] - (r[1] or 0)) / r[2] if r[2] else share
        if nxt <= share:
            break
        share = nxt
    return ranked.select("source", "source_size",
                         F.least(F.lit(share) * F.col("weight"), F.col("limit").cast("double")).alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """slim: source, size, h.  budgets: source, part (words of the part pass).

    Adds theta: documents with h < theta make up the part pass, as near to the
    budget as whole hash values allow."""
    state = budgets.select("source", "part", F.lit(0).cast("long").alias("low"),
                           F.lit(0).cast("long").alias("before"), (F.col("part") > 0).alias("open"))
    bits = HASH_BITS
    while bits > 0:
        bits -= LEVEL_BITS
        width = F.lit(1 << bits).cast("long")
        span = 1 << (bits + LEVEL_BITS)
        inside = slim if span == 1 << HASH_BITS else lookup(
            slim, state.filter("open").select("source", "low"), ["source"], F.col("h"), n_sources, "inner"
        ).filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(span))).drop("low")
        hist = inside.groupBy("source", F.expr(f"h div {1 << bits}").alias("b")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.coalesce(F.sum("words").over(w), F.lit(0)))
        key = F.col("s.source").eqNullSafe(F.col("x.source"))
        end = (hist.alias("x").join(state.filter("open").alias("s"), key)
               .withColumn("at", F.col("s.before") + F.col("x.below"))
               .filter((F.col("at") <= F.col("s.part")) & (F.col("at") + F.col("x.words") > F.col("s.part")))
               .select(F.col("s.source").alias("source"), F.col("at"), F.col("x.b").alias("b"),
                       F.col("x.words").alias("words"), F.col("x.n").alias("n")))
        rest = F.col("s.part") - F.col("at")
        last = (F.col("n") == 1) | F.lit(bits == 0)
        take = last & (rest * 2 > F.col("words"))
        state = written(
            state.alias("s").join(end.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select(
                F.col("s.source").alias("source"), F.col("s.part").alias("part"),
                F.when(F.col("n").isNull(), F.col("s.low"))
                .otherwise((F.col("b") + take.cast("long")) * width).alias("low"),
                F.coalesce(F.col("at"), F.col("s.before")).alias("before"),
                (F.col("s.open") & F.col("n").isNotNull() & ~last).alias("open")), "thresholds")
        if state.filter("open").isEmpty():
            break
    return state.select("source", F.col("low").alias("theta"))


def _key(doc_id: Column, text: Column) -> Column:
    return hash60(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text))))


def distinct_hashes(rows: DataFrame) -> DataFrame:
    """rows: source, size, h and others.  Gives all but the first of the rows that share a hash within a
    source one of their own, by size, so that a budget's end can lie between them."""
    keys = ["source", "h"]
    shared = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit(True).alias("shared")), "shared")
    n = shared.count()
    if not n:
        return rows
    rows = written(rows, "hashed").withColumn("tie", F.monotonically_increasing_id())  # by files: the same in every run of a task
    marked = lookup(rows, shared, keys, F.col("tie"), n)
    nth = numbered(marked.filter("shared"), keys, [F.col("size").asc(), F.col("tie").asc()], "repeats", "nth")
    apart = nth.withColumn("h", F.when(F.col("nth") == 0, F.col("h")).otherwise(
        hash60(F.concat_ws("#", F.col("h").cast("string"), F.col("nth").cast("string"))))).drop("nth")
    return marked.filter("shared IS NULL").unionByName(apart).drop("shared", "tie")


def plan_mix(rows: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES):
    """rows: source, size, h.  (plan, number of sources): plan has source, source_size, target, passes and
    theta by source."""
    slim = written(rows.select("source", "size", "h"), "sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, max_passes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(targets.withColumn("passes", whole)
                   .withColumn("part", F.col("target") - F.col("passes") * F.col("source_size")), "budgets")
    n = plan.count()
    theta = thresholds(slim, plan.select("source", "part"), n)
    plan = plan.alias("p").join(theta.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").select(
        "p.source", "source_size", "target", "passes", "theta")
    return written(plan, "mix"), n


def mix(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken.

    size counts the words of the text (null: 0); taken is size times the
    passes over the document, 0 to ``max_passes``.  A null source is a source
    of its own, the last.  The hash is of the doc_id (of the text where it is
    null), so reruns agree; rows that repeat it are numbered by size and taken
    one by one.  Empty texts take nothing; an empty table gives no rows;
    further columns are ignored."""
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"),
                       _key(F.col("doc_id"), text_of()).alias("h"))
    slim = distinct_hashes(written(slim, "sizes"))
    plan, n = plan_mix(slim, weights, max_passes)
    taken = F.col("size") * (F.col("passes") + (F.col("h") < F.col("theta")).cast("long"))
    return lookup(slim, plan, ["source"], F.col("h"), n).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken; see ``mix``.

    Returns the columns of ``docs``, whatever their names.  Documents without
    words, null and empty texts, stay once: no budget counts them."""
    rows = packed(docs).select("row", F.col("row.source").cast("string").alias("source"), word_count(text_of("row.text")).alias("size"),
                               _key(F.col("row.doc_id"), text_of("row.text")).alias("h"))
    rows = distinct_hashes(rows)
    plan, n = plan_mix(rows, weights, max_passes)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("passes") + (F.col("h") < F.col("theta")).cast("int"))
    taken = lookup(rows, plan, ["source"], F.col("h"), n)
    return unpacked(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))))


def oracle(weights=WEIGHTS, max_passes: int = MAX_PASSES) -> str:
    """DuckDB SQL for ``mix`` over ``documents``: the same mix by a sorted running sum."""
    key = "coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))"
    case = " ".join(f"WHEN {i} THEN {float(w)!r}" for i, w in enumerate(weights))
    return f"""
WITH RECURSIVE first AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         {sql_hash60(key)} AS h FROM documents),
nth AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY size) - 1 AS nth FROM first),
slim AS (SELECT doc_id, source, size, CASE WHEN nth = 0 THEN h ELSE {sql_hash60("h || '#' || nth")} END AS h FROM nth),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
ranked AS (SELECT source, source_size, source_size * {max_passes} AS cap,
  CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {case} END AS weight FROM sums),
shares AS (
  SELECT 0 AS i, CAST(-1 AS DOUBLE) AS prev, CAST(0 AS DOUBLE) AS share
  UNION ALL
  SELECT i + 1, share, (SELECT (sum(source_size) - coalesce(sum(CASE WHEN cap <= share * weight THEN cap END), 0))
    / coalesce(sum(CASE WHEN cap > share * weight THEN weight END), 1) FROM ranked)
  FROM shares WHERE share > prev AND i < 1000),
targets AS (SELECT source, source_size, least((SELECT max(share) FROM shares) * weight, CAST(cap AS DOUBLE)) AS target FROM ranked),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
groups AS (SELECT source, h, sum(size) AS words FROM slim GROUP BY source, h),
runs AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before FROM groups),
picked AS (SELECT r.source, r.h, (r.before <= b.target - b.passes * b.source_size
    AND (r.before + r.words <= b.target - b.passes * b.source_size
         OR (b.target - b.passes * b.source_size - r.before) * 2 > r.words)) AS part
  FROM runs r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, b.source_size, b.target,
  CAST(s.size * (b.passes + CASE WHEN p.part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN picked p ON s.source IS NOT DISTINCT FROM p.source AND s.h = p.h"""
