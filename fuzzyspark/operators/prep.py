"""Data-preparation operators (projection, null handling, pivots, collapse,
label lookup, enrichment, fingerprints)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzyspark.sources import views as V

URI_TAIL_RE = r"[/#]([^/?#]*)(?:\?[^#]*)?$"
HOST_RE = r"^[a-z]+://([^/]+)"
YEAR_RE = r"^\+?(\d{4})"


def dropna(df: DataFrame, how: str, subset: list[str]) -> DataFrame:
    return df.na.drop(how=how, subset=subset)


def nullable_titles(spark, d) -> DataFrame:
    t = V.page_titles(spark, d)
    return t.select("id", F.nullif("title", F.lit("")).alias("title"), F.nullif("lang", F.lit("")).alias("lang"))


def label_filter(df: DataFrame, col: str, keep: list) -> DataFrame:
    """Keep rows whose label is in ``keep``; drop the label column."""
    return df.where(F.col(col).isin(keep)).drop(col)


def drop_by_regex(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


def collapse_values(df: DataFrame, keys: list[str], col: str, sep: str) -> DataFrame:
    """Distinct values per key, sorted, joined by ``sep``."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(col)), sep).alias(col))


def uri_tail(df: DataFrame, id_col: str, url: str) -> DataFrame:
    return df.select(id_col, F.regexp_extract(url, HOST_RE, 1).alias("host"),
                     F.regexp_extract(url, URI_TAIL_RE, 1).alias("tail"))


def pivot_props(triples: DataFrame, entity: str, prop: str, value: str, names: list[str]) -> DataFrame:
    """Entity rows from (entity, property, value) triples: one column per
    named property, the largest value kept, null where an entity has none."""
    return triples.groupBy(entity).agg(*[
        F.max(F.when(F.col(prop) == n, F.col(value))).alias(n) for n in names])


def normalize_props(events: DataFrame) -> DataFrame:
    """Claim-value normaliser: time → 4-digit year, quantity → "amount unit",
    nested JSON value → its scalar."""
    return events.select(
        "event_id",
        F.regexp_extract(F.col("ts").cast("string"), YEAR_RE, 1).alias("year"),
        F.concat_ws(" ", F.col("value").cast("string"), F.col("event_type")).alias("quantity"),
        F.get_json_object("props", "$.k").alias("k"))


def variant_project(df: DataFrame, id_col: str, cols: list[str], variant: str) -> DataFrame:
    """Distinct rows of the 1col, 2col or full projection.  A row of 1col or
    2col needs all its values, a row of full at least one."""
    if variant == "1col":
        keep = cols[:1]
    elif variant == "2col":
        keep = cols[:2]
    else:
        keep = cols
    return df.select(id_col, *keep).na.drop(how="all" if variant == "full" else "any", subset=keep).distinct()


def label_lookup(nation: DataFrame, region: DataFrame) -> DataFrame:
    """Replace a foreign id by its label; fall back to "name (id)"."""
    j = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    label = F.coalesce(F.col("r_name"), F.concat(F.col("n_name"), F.lit(" ("),
                                                 F.col("n_regionkey").cast("string"), F.lit(")")))
    return j.select("n_nationkey", "n_name", label.alias("region_label"))


def gt_enrich(gt: DataFrame, left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    l = left.select(*[F.col(c).alias(c + "_l") for c in left.columns])
    r = right.select(*[F.col(c).alias(c + "_r") for c in right.columns])
    return (gt.join(l, gt["id_l"] == l[id_col + "_l"]).join(r, gt["id_r"] == r[id_col + "_r"])
            .drop(id_col + "_l", id_col + "_r") if id_col != "id" else
            gt.join(l, "id_l").join(r, "id_r"))


def enrich_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """(kind, id_l, id_r) pairs with both tables' columns, suffixed."""
    l = left.select(*[F.col(c).alias(c + "_l") for c in left.columns if c != id_col],
                    F.col(id_col).cast("string").alias("__l"))
    r = right.select(*[F.col(c).alias(c + "_r") for c in right.columns if c != id_col],
                     F.col(id_col).cast("string").alias("__r"))
    return (pairs.join(l, pairs["id_l"] == l["__l"], "left").join(r, pairs["id_r"] == r["__r"], "left")
            .drop("__l", "__r"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: Σ xxhash64(row) as a decimal."""
    return df.select(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint"),
                     F.count(F.lit(1)).alias("rows"))


def packed_split(df: DataFrame, id_col: str, a: str, b: str, sep: str) -> DataFrame:
    """Two packed lists split on ``sep`` and paired by position."""
    z = F.arrays_zip(F.split(a, sep).alias("a"), F.split(b, sep).alias("b"))
    return (df.select(id_col, F.posexplode(z).alias("pos", "ab"))
            .select(id_col, "pos", F.col("ab.a").alias(a), F.col("ab.b").alias(b)))
