"""Document fingerprints by consistent weighted sampling.

A document is a bag of words, each weighing its number of occurrences.  For
every sample and word, a hash of the word draws r and c from Gamma(2, 1) and b
from [0, 1); a word of weight S scores

    t = floor(ln S / r + b),   ln a = ln c - r (t - b + 1),

and the sample of a document is the (word, t) with the least a.  Two documents
take the same sample with the probability of their generalised Jaccard
similarity, sum(min(S, S')) / sum(max(S, S')), so the share of equal samples
estimates it.  A sample is kept as 32 bits hashed from its ln a, which word, t
and number of the sample determine.

The edited text of a document takes its last half from the next document: the
texts are shuffled once by document, the halves once to their receivers, and
words, weights and samples are counted where the texts then lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzyspark.llm.common import lookup, numbered, text_of, written

SAMPLES = 32
WORD = r"[^\x20\x09-\x0D]+"
#: code points of text in a task
TASK_CHARS = 4 << 20
#: copies of a repeated row that are put out together
COPIES = 65_536


def _keys(docs: DataFrame) -> DataFrame:
    """k1, k2: 120 bits of the SHA-256 of doc_id and text, the same for repeated rows alone."""
    sha = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text_of()), 256)
    bits = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return docs.select("doc_id", text_of().alias("text"), sha.alias("sha")).select(
        "doc_id", "text", bits(1).alias("k1"), bits(16).alias("k2"))


def chain(keyed: DataFrame) -> DataFrame:
    """Distinct rows in descending order of doc_id: k1, k2, doc_id, n_chars, copies, and n1, n2, the next one's
    keys.  The first follows the last; null ids are last; texts of one id go by their keys."""
    slim = written(keyed.select("k1", "k2", "doc_id", F.length("text").cast("long").alias("n_chars")), "sizes")
    groups = slim.groupBy("k1", "k2").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"),
                                          F.count(F.lit(1)).alias("copies"))
    groups = written(numbered(groups, [], [F.col("doc_id").desc_nulls_last(), F.col("k1").asc(), F.col("k2").asc()], "order"), "order")
    n = max(groups.count(), 1)
    nxt = groups.select(F.pmod(F.col("slot") - 1, F.lit(n)).alias("slot"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    return written(groups.join(nxt, "slot").drop("slot"), "chain")


def _texts(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """k1, k2, text: one row for repeated ones, dealt to tasks of about TASK_CHARS code points."""
    chars = links.agg(F.sum("n_chars")).first()[0] or 0
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(chars) // TASK_CHARS))
    rows = keyed.select("k1", "k2", "text")
    repeated = links.filter("copies > 1").select("k1", "k2", F.lit(True).alias("again"))
    n = repeated.count()
    if n:  # repeated rows are reduced before they are dealt
        marked = lookup(rows, repeated, ["k1", "k2"], F.monotonically_increasing_id(), n)
        once = marked.filter("again").groupBy("k1", "k2").agg(F.first("text").alias("text"))
        rows = marked.filter("again IS NULL").drop("again").unionByName(once)
    return rows.repartition(parts, "k1", "k2")


def _draws(term: Column, k: Column) -> list[Column]:
    """r and ln c of two Gamma(2, 1) draws and b from [0, 1), by 24, 32 and 16 bits a uniform."""
    h, g = F.xxhash64(term, k), F.xxhash64(term, k, F.lit(1))
    unit = lambda x, bits: (x.cast("double") + 0.5) / float(1 << bits)
    cut = lambda x, at, bits: unit(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")), bits)
    gamma = lambda u, v: -F.log(u * v)
    return [gamma(cut(h, 0, 24), cut(h, 24, 24)).alias("draw_r"), F.log(gamma(cut(g, 0, 32), cut(g, 32, 32))).alias("draw_ln_c"),
            cut(h, 48, 16).alias("draw_b")]


def samples(terms: DataFrame, keys: list[str], weights: list[str], n_samples: int = SAMPLES) -> DataFrame:
    """terms: keys, term (a long) and columns of integer weights.  By keys, an array of samples for each
    column; a column without weight above 0 has zeros.
    Columns are not called nth, term or draw_r, draw_ln_c, draw_b."""
    logs = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(w) for w in weights]
    drawn = (terms.select(*keys, "term", *logs).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
             .select(*keys, "nth", *weights, *_draws(F.col("term"), F.col("nth"))))
    t = lambda w: F.floor(F.col(w) / F.col("draw_r") + F.col("draw_b")).cast("double")
    least = drawn.groupBy(*keys, "nth").agg(*[F.min(F.col("draw_ln_c") - F.col("draw_r") * (t(w) - F.col("draw_b") + 1.0)).alias(w) for w in weights])
    code = lambda w: F.when(F.col(w).isNull(), F.lit(0)).otherwise(F.shiftright(F.xxhash64(w), 32).cast("int")).alias(w)
    rows = F.sort_array(F.collect_list(F.struct("nth", *weights)))
    return (least.select(*keys, "nth", *map(code, weights)).groupBy(*keys).agg(rows.alias("s"))
            .select(*keys, *[F.col(f"s.{w}").alias(w) for w in weights]))


def _signatures(keyed: DataFrame, links: DataFrame, n_samples: int) -> DataFrame:
    """k1, k2, the SHA-256 of the texts edited by the next and by an own copy, and the samples of the
    text and of both: own, by_next, by_copy."""
    texts = _texts(keyed, links)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    give = links.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"),
                        half.alias("half"), "copies")
    gifts = texts.join(give, ["k1", "k2"]).select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), "half", "copies",
                                                  F.substring("text", F.lit(1), F.col("half")).alias("gift"))
    keep = F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("half"))
    pairs = texts.join(gifts, ["k1", "k2"]).select(
        "k1", "k2", "text", "gift", (F.col("copies") > 1).alias("again"), keep.alias("keep"),
        F.when(F.col("copies") > 1, F.substring("text", F.lit(1), F.col("half"))).alias("own_gift"))
    edited = pairs.select("k1", "k2", F.sha2(F.concat("keep", "gift"), 256).alias("sha_next"),
                          F.sha2(F.concat("keep", "own_gift"), 256).alias("sha_copy"))
    # the words up to the last white space of what is kept count for all texts
    same = pairs.withColumn("same", F.regexp_extract("keep", r"(?s)^.*[\x20\x09-\x0D]", 0))
    behind = lambda c: F.substring(F.col(c), F.length("same") + 1, F.length(c))
    run = lambda x, own, nxt, copy: F.struct(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)).alias("words"),
                                             F.lit(own).alias("own"), F.lit(nxt).alias("by_next"), copy.cast("int").alias("by_copy"))
    none = F.lit(False)
    runs = same.select("k1", "k2", F.explode(F.array(
        run(F.col("same"), 1, 1, F.col("again")), run(behind("text"), 1, 0, none),
        run(F.concat(behind("keep"), F.col("gift")), 0, 1, none),
        run(F.when(F.col("again"), F.concat(behind("keep"), F.col("own_gift"))).otherwise(""), 0, 0, F.col("again")))).alias("run"))
    weights = ["own", "by_next", "by_copy"]
    words = runs.select("k1", "k2", *[f"run.{w}" for w in weights], F.explode("run.words").alias("word"))
    terms = words.groupBy("k1", "k2", F.xxhash64("word").alias("term")).agg(*[F.sum(w).alias(w) for w in weights])
    return edited.join(samples(terms, ["k1", "k2"], weights, n_samples), ["k1", "k2"], "left")


def fingerprints(docs: DataFrame, n_samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    Words are runs of characters other than white space, lower-cased.  A null
    text counts as empty; a text without words has a fingerprint of zeros, and
    two such are alike (1.0).  Documents follow each other by descending
    doc_id, null ids last, several texts of one id in a fixed order; copies of
    a repeated row follow each other, so all but the last of them are edited
    by the row itself and are 1.0 near the next.  A single document is its own
    next.  An empty table gives no rows; further columns are ignored."""
    keyed = _keys(docs)
    links = chain(keyed)
    sig = written(_signatures(keyed, links, n_samples), "samples")
    nothing = F.array_repeat(F.lit(0), n_samples)
    filled = sig.select("k1", "k2", "sha_next", "sha_copy", *[F.coalesce(w, nothing).alias(w) for w in ("own", "by_next", "by_copy")])
    nxt = filled.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("own").alias("next_own"))
    met = links.join(filled, ["k1", "k2"]).join(nxt, ["n1", "n2"])
    code = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")
    near = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / float(n_samples)
    row = lambda sha, edit, after: [
        "doc_id", "n_chars", F.col(sha).alias("edited_sha256"), code("own").alias("fingerprint"), code(edit).alias("edited_fingerprint"),
        near("own", edit).alias("near_edited"), after.alias("near_next")]
    last = met.select(*row("sha_next", "by_next", near("own", "next_own")))
    # the earlier copies of a repeated row, of which there may be very many
    blocks = (met.filter("copies > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 2) / COPIES))))
              .repartition("k1", "k2", "block")
              .withColumn("n", F.least(F.lit(COPIES), F.col("copies") - 1 - F.col("block") * COPIES).cast("int")))
    earlier = blocks.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select(*row("sha_copy", "by_copy", F.lit(1.0)))
    return last.unionByName(earlier)
