"""Tokens of records stay where their record was dealt, and are codes once they meet others."""

import re

import pytest
from pyspark.sql import functions as F

from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import pairs as P
from fuzzyspark.operators.space import from_name

JFS = ["lower_threeGram_idfWeight_cosineDistance", "lower_splitBySpace_idfWeight_maxincDistance",
       "lower_splitBySpace_uniformWeight_diceDistance"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sides(spark):
    left = [(1, "red red car"), (2, "blue car"), (3, "red boat\u0001x"), (4, None), (4, "green car"), (None, "lost")]
    right = [(10, "red car car"), (11, "unseen words"), (12, ""), (13, "blue red car"), (13, "boat\u0001x")]
    return (spark.createDataFrame(left, "id long, v string"), spark.createDataFrame(right, "id long, v string"))


def distances(left, right):
    ps = P.PairSpace(left, right, "id", ["v"], [from_name(n) for n in JFS], stem=False, persist=False)
    lr = left.select(F.col("id").alias("id_l")).distinct().crossJoin(right.select(F.col("id").alias("id_r")).distinct())
    return sorted(map(repr, map(tuple, ps.pair_distances(None, lr, fill=False).collect()))), ps


def test_profiles_hold_codes_and_do_not_shuffle_tokens(sides):
    _, ps = distances(*sides)
    assert dict(ps.records.dtypes)["prof"].startswith("map<string,struct<tk:array<bigint>")
    assert not re.search(r"hashpartitioning\([^)]*\bid#[^)]*token#", plan(ps.records))


def test_a_vocabulary_that_is_not_broadcast_gives_the_same_distances(sides, monkeypatch):
    few, _ = distances(*sides)
    monkeypatch.setattr(P, "VOCAB_BROADCAST_ROWS", 0)
    assert distances(*sides)[0] == few


def test_distances_weigh_tokens_that_l_lacks(spark):
    left = spark.createDataFrame([(1, "a b"), (2, "a c")], "id long, v string")
    right = spark.createDataFrame([(9, "b b z")], "id long, v string")
    ps = P.PairSpace(left, right, "id", ["v"], [from_name("lower_splitBySpace_uniformWeight_jaccardDistance")], stem=False, persist=False)
    got = ps.pair_distances(None, spark.createDataFrame([(1, 9), (2, 9)], "id_l long, id_r long"), fill=False).collect()
    assert {(r["id_l"], round(r["d0_0"], 6)) for r in got} == {(1, round(1 - 1 / 3, 6)), (2, 1.0)}


def test_postings_do_not_shuffle_tokens_by_record(sides, monkeypatch):
    norm = B.normalize_records(sides[0], "id", ["v"], stem=False)
    post = B.left_postings(norm, 6)
    assert not re.search(r"hashpartitioning\(id_l#\d+L?, token#", plan(post))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    few = rows(post)
    monkeypatch.setattr(B, "HOT_BROADCAST_ROWS", 0)
    assert rows(B.left_postings(norm, 6)) == few
