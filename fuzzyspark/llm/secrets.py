"""Secret scans by multipart credential linking.

Base finds (assignments, access ids, hexadecimal runs) stand alone.  Weak
candidates, too short or too plain to report by themselves, are reported when
complementary parts lie in their scope, a stretch of ``radius`` code points to
either side:

* a weak access id (or a named user or client id) beside a secret,
* a weak secret (a short assignment) beside an access id,
* an endpoint beside both an access id and a secret,

where two weak parts vouch for each other only together with an endpoint.
Scopes meet parts by an interval join on (document, bin): the parts are first
summed up to their least start and greatest end by bin and role, so a
candidate meets a few rows however many parts its scope holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.llm.common import text_of, written

# fixed values: the base patterns; the group of the value and the least length of it
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 18)
HEX = (r"[0-9a-f]{16,}", 0, 16)
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
# further parts of a credential
USER = (r"(?i:client_?id|access_?key_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", 0, 1)
ENDPOINT = (r"[a-z][a-z0-9+.-]{0,30}://[^\x00-\x20\"'<>|]+", 0, 1)
PARTS = {**BASE, "user": USER, "endpoint": ENDPOINT}
#: kinds as listed, which orders spans of equal start
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
#: least lengths of the weak forms
WEAK_ACCESS, WEAK_SECRET = 8, 6
RADIUS = 200


def _marks(text: Column, kind: str, pattern: str, group: int) -> Column:
    """All matches of a pattern: kind, number, code points before it since the last match, its
    length, and the length of its value.  The texts between matches are those of ``split``."""
    rx = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    lens = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda x: F.length(x))
    vals = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), lambda x: F.length(x)) if group else lens
    return F.transform(F.arrays_zip(lens.alias("n"), F.slice(gaps, F.lit(1), F.size(lens)).alias("gap"), vals.alias("v")),
                       lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"),
                                             x["n"].alias("n"), x["v"].alias("v")))


def part_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, part, start, end, v: every match of every pattern, by code points.

    th is a hash of the text; rows that repeat a doc_id and its text count once."""
    marks = F.concat(*[_marks(F.col("text"), k, p, g) for k, (p, g, _) in PARTS.items()])
    rows = (docs.select("doc_id", F.col("th"), F.explode(marks).alias("m"))
            .select("doc_id", "th", "m.*").dropDuplicates(["doc_id", "th", "kind", "i"]))
    w = Window.partitionBy("doc_id", "th", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(w)
    return rows.select("doc_id", "th", F.col("kind").alias("part"), (end - F.col("n")).cast("long").alias("start"),
                       end.cast("long").alias("end"), "v")


def link(parts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The spans to report: doc_id, th, kind, start, end."""
    part, v = F.col("part"), F.col("v")
    strong = F.coalesce(*[F.when((part == k) & (v >= least), F.lit(k)) for k, (_, _, least) in BASE.items()])
    weak = (F.when((part == "access") & (v >= WEAK_ACCESS), "weak_access").when(part == "user", "weak_access")
            .when((part == "assign") & (v >= WEAK_SECRET), "weak_secret").when(part == "endpoint", "endpoint"))
    spans = parts.withColumn("kind", F.coalesce(strong, weak)).filter("kind IS NOT NULL")
    spans = spans.withColumn("strong", strong.isNotNull())
    role = F.when(F.col("kind").isin("access", "weak_access"), "access").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    spans = written(spans.select("doc_id", "th", "kind", "start", "end", "strong", role.alias("role")), "spans")
    bins = lambda a, b: F.sequence(F.floor(a / radius), F.floor(b / radius))
    held = (spans.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"))))
            .groupBy("doc_id", "th", "bin", "role").agg(
                F.min("start").alias("a"), F.max("end").alias("b"),
                F.min(F.when(F.col("strong"), F.col("start"))).alias("sa"),
                F.max(F.when(F.col("strong"), F.col("end"))).alias("sb")))
    lo, hi = F.greatest(F.col("start") - radius, F.lit(0)), F.col("end") + radius
    scopes = (spans.filter("NOT strong").withColumn("lo", lo).withColumn("hi", hi)
              .withColumn("bin", F.explode(bins(F.col("lo"), F.col("hi")))))
    met = scopes.alias("s").join(held.alias("h"), F.col("s.doc_id").eqNullSafe(F.col("h.doc_id"))
                                 & (F.col("s.th") == F.col("h.th")) & (F.col("s.bin") == F.col("h.bin"))
                                 & (F.col("h.b") >= F.col("s.lo")) & (F.col("h.a") <= F.col("s.hi"))
                                 & (F.col("h.role") != F.col("s.role")))
    sure = (F.col("h.sb") >= F.col("s.lo")) & (F.col("h.sa") <= F.col("s.hi"))
    has = lambda r: F.max((F.col("h.role") == r).cast("int")) == 1
    has_sure = lambda r: F.max(((F.col("h.role") == r) & F.coalesce(sure, F.lit(False))).cast("int")) == 1
    seen = met.groupBy("s.doc_id", "s.th", "s.kind", "s.start", "s.end").agg(
        has("access").alias("acc"), has("secret").alias("sec"), has("endpoint").alias("ep"),
        has_sure("access").alias("acc_sure"), has_sure("secret").alias("sec_sure"))
    ep = F.col("ep")
    keep = (F.when(F.col("kind") == "weak_access", F.col("sec_sure") | (F.col("sec") & ep))
            .when(F.col("kind") == "weak_secret", F.col("acc_sure") | (F.col("acc") & ep))
            .otherwise(F.col("acc") & F.col("sec")))
    cols = ["doc_id", "th", "kind", "start", "end"]
    return spans.filter("strong").select(*cols).unionByName(seen.filter(keep).select(*cols))


def scan(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document.

    spans lists kind:start:end of base and linked spans by start, then kind.
    A null text counts as empty: no spans, the digest of the empty string.
    Rows that repeat a doc_id and its text get the same result each; a null
    doc_id is a value like any other; an empty table gives no rows; further
    columns are ignored."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    found = link(part_spans(rows), radius)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("rank"), "kind", "end")
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    per = found.groupBy("doc_id", "th").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(span)).alias("all"))
    base = F.filter(F.col("all"), lambda x: x["rank"] <= len(BASE))
    per = per.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), *[f"n_{k}" for k in BASE],
                     F.array_join(F.transform(base, name), ",").alias("base"),
                     F.array_join(F.transform(F.col("all"), name), ",").alias("spans"))
    out = rows.select("doc_id", "th").join(per, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    return out.select("doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
                      F.sha2(F.coalesce(F.col("base"), F.lit("")), 256).alias("base_sha256"),
                      F.coalesce(F.col("spans"), F.lit("")).alias("spans"))
