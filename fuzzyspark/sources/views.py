"""Fuzzy-join inputs derived from the driver tables.

The ``pages`` table holds raw web pages whose ``<title>`` element is a short
entity-like name with exact and near copies across pages.  Every page is
used: pages with an even id form the reference side L (one row per distinct
title, smallest id kept, so L is duplicate-free) and pages with an odd id
form the query side R.  ``fj_gt`` is the weak ground truth of exact title
equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

TITLE_RE = r"<title>(.*?)</title>"
LANG_RE = r"^[a-z]+://[^/]+/([a-z]+)/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"),
                    F.regexp_extract("html", TITLE_RE, 1).alias("title"),
                    F.regexp_extract("url", LANG_RE, 1).alias("lang"))


def fj_left(spark: SparkSession, sf_dir: str, with_lang: bool = False) -> DataFrame:
    t = page_titles(spark, sf_dir).where(F.col("id") % 2 == 0)
    if with_lang:
        return t.groupBy("title", "lang").agg(F.min("id").alias("id")).select("id", "title", "lang")
    return t.groupBy("title").agg(F.min("id").alias("id")).select("id", "title")


def fj_right(spark: SparkSession, sf_dir: str, with_lang: bool = False) -> DataFrame:
    t = page_titles(spark, sf_dir).where(F.col("id") % 2 == 1)
    return t.select("id", "title", "lang") if with_lang else t.select("id", "title")


def fj_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = fj_left(spark, sf_dir)
    right = fj_right(spark, sf_dir)
    return (left.join(right, "title")
            .select(left["id"].alias("id_l"), F.col("title").alias("title_l"),
                    right["id"].alias("id_r"), F.col("title").alias("title_r")))


# SQL (DuckDB) twins of the views above, used as CTEs by the oracle queries.
SQL_VIEWS = {
    "fj_titles": "SELECT page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, "
                 "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS lang FROM pages",
    "fj_left": "SELECT min(id) AS id, title FROM fj_titles WHERE id % 2 = 0 GROUP BY title",
    "fj_left2": "SELECT min(id) AS id, title, lang FROM fj_titles WHERE id % 2 = 0 GROUP BY title, lang",
    "fj_right": "SELECT id, title FROM fj_titles WHERE id % 2 = 1",
    "fj_right2": "SELECT id, title, lang FROM fj_titles WHERE id % 2 = 1",
    "fj_gt": "SELECT l.id AS id_l, l.title AS title_l, r.id AS id_r, r.title AS title_r "
             "FROM fj_left l JOIN fj_right r ON l.title = r.title",
}
