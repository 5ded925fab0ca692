"""Work on pairs in the cells of a grid: the results of plain joins, and the plans that keep it off the shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import cells as C
from fuzzyspark.operators import rules as NR


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tokens(spark):
    """Tokens of L with weights, two of them held by (nearly) all, of R, and ids that are null or repeated."""
    rnd = random.Random(3)
    l = [(i, t, round(rnd.uniform(-0.2, 2), 3)) for i in range(40) for t in {"a", "b", *rnd.sample("cdefghij", 2)}]
    r = [(i, t) for i in range(100, 130) for t in {"a", *rnd.sample("cdefghijxy", 3)}]
    l += [(None, "a", 0.5), (7, "a", 0.25), (50, "only", 1.0)]
    r += [(None, "b"), (None, "a"), (101, "a"), (140, "nowhere")]
    return (spark.createDataFrame(l, "id_l long, token string, w double"), spark.createDataFrame(r, "id_r long, token string"))


def joined(tokens):
    return (tokens[1].join(tokens[0], "token").groupBy("id_l", "id_r")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 9).alias("w")))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_pair_sums_are_those_of_the_token_join(tokens, monkeypatch):
    post, rtok = tokens
    want = rows(joined(tokens))
    sums = lambda **kw: rows(B.pair_sums(rtok, post, **kw).select("id_l", "id_r", "n", F.round("w", 9)))
    assert sums() == want
    assert sums(salt_rows=4) == want, "many cells"
    monkeypatch.setattr(B, "RUN", 16)
    assert sums() == want, "many runs"
    assert rows(B.token_join(rtok, post, by_pair=True).select("id_l", "id_r", "n", F.round("w", 9))) == want


def test_records_that_share_nothing_have_no_pairs(spark, tokens):
    strange = spark.createDataFrame([(1, "never"), (2, "seen")], "id_r long, token string")
    assert B.pair_sums(strange, tokens[0]).count() == 0
    assert B.pair_sums(strange, tokens[0], 3).count() == 0


def test_pair_sums_keep_the_k_best_with_ties(tokens):
    post, rtok = tokens
    scores = lambda df: df.select("id_l", "id_r", F.round("w", 9).alias("score"))
    for salt in (B.SALT_ROWS, 6):
        few = B.pair_sums(rtok, post, 3, salt)
        assert rows(B.top_k(scores(few), 3)) == rows(B.top_k(scores(joined(tokens)), 3))
    assert B.pair_sums(rtok, post, 3).count() < joined(tokens).count()


def test_no_row_for_each_match_of_a_token(tokens):
    """The matches of a token, up to |L| x |R|, were rows of a join that the sum then shuffled."""
    post, rtok = tokens
    lnorm = post.select(F.col("id_l").alias("id"), F.lit("x").alias("value"))
    out = B.block_scores(lnorm, lnorm.where("id < 5"), 42, postings=post)
    assert "Join" not in plan(out) and "FlatMapGroupsInArrow" in plan(out)


def test_overlap_pairs_sends_on_only_what_reaches_the_share(spark):
    l = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "id long, token string")
    r = spark.createDataFrame([(9, "a", 1.0), (9, "b", 3.0), (9, "z", 1.0), (8, "a", 0.0), (7, "q", 1.0)], "id long, token string, w double")
    pairs = lambda *a: {tuple(x) for x in B.overlap_pairs(l.withColumn("w", F.lit(7.0)), r, *a).collect()}
    assert pairs(0.8) == {(1, 9), (1, 8), (2, 8)}
    assert pairs(0.2) == {(1, 9), (2, 9), (1, 8), (2, 8)}
    assert pairs(0.8, 3.0) == {(1, 9), (2, 9), (1, 8), (2, 8)}
    # the prefix of r's heaviest tokens, which was joined before, cannot leave out 2 here
    both = spark.createDataFrame([(9, "a", 1.0), (9, "b", 1.0), (9, "c", 1.0)], "id long, token string, w double")
    assert {tuple(x) for x in B.overlap_pairs(l, both, 0.6).collect()} == {(1, 9)}


@pytest.mark.parametrize("cell", [1, 4096])
def test_attached_records_are_those_of_two_joins(spark, monkeypatch, cell):
    monkeypatch.setattr(C, "CELL_RECORDS", cell)
    left = spark.createDataFrame([(i, f"l{i}") for i in range(6)] + [(2, "twice"), (None, "none")], "id long, v string")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(3, 9)] + [(5, "twice"), (None, "none"), (6, None)], "id int, v string")
    pairs = [(a, b, a * 10) for a in range(7) for b in range(2, 10)] + [(2, 5, 1), (None, 5, 0), (2, None, 0)]
    pairs = spark.createDataFrame(pairs, "id_l long, id_r long, x int")
    got = C.attach_records(pairs, left, right).select("id_l", "id_r", "x", "l.v", F.col("r.v").alias("w"))
    want = pairs.join(left.withColumnRenamed("id", "id_l"), "id_l").join(right.select(F.col("id").alias("id_r"), F.col("v").alias("w")), "id_r")
    assert rows(got) == rows(want.select("id_l", "id_r", "x", "v", "w"))
    assert "Join" not in plan(got)


@pytest.mark.parametrize("share", [1, 4, 1 << 40])
def test_best_pairs_by_matrix_are_those_of_single_matches(monkeypatch, share):
    """Every match of every pair was a number of its own, though most are of a few tokens."""
    monkeypatch.setattr(B, "HOT_SHARE", share)
    rng, found = np.random.default_rng(share), 0
    for trial in range(60):
        n_left, n_right, n_tok = int(rng.integers(2, 40)), int(rng.integers(1, 12)), int(rng.integers(2, 25))
        k = int(rng.integers(1, n_left))
        lists = []
        for n in (n_left, n_right):  # tokens of a record may repeat, weights be nothing or less
            held = [rng.integers(0, n_tok + len(lists), rng.integers(1, 8)) for _ in range(n)]
            tok = np.concatenate(held)
            lists.append((np.concatenate([[0], np.cumsum([len(x) for x in held])]), tok, rng.choice([-0.5, 0.0, 0.25, 0.5, 1.5], len(tok))))
        want = {}
        for r in range(n_right):
            n, w = np.zeros(n_left, int), np.zeros(n_left)
            for l in range(n_left):
                for i in range(lists[0][0][l], lists[0][0][l + 1]):
                    for j in range(lists[1][0][r], lists[1][0][r + 1]):
                        if lists[0][1][i] == lists[1][1][j]:
                            n[l] += 1
                            w[l] += lists[0][2][i] * lists[1][2][j]
            met = np.flatnonzero(n)
            least = np.sort(w[met])[-k] if len(met) >= k else -np.inf
            want.update({(int(l), r): (int(n[l]), round(float(w[l]), 9)) for l in met if w[l] >= least - 2e-10})
        got = [x for part in B._best_runs(lists, n_left, k) for x in zip(*(c.tolist() for c in part))]
        assert len(got) == len(want) and {(l, r): (n, round(w, 9) + 0.0) for l, r, n, w in got} == {p: (n, w + 0.0) for p, (n, w) in want.items()}
        found += len(got)
    assert found > 1000


def test_few_rules_are_broadcast(spark):
    sets = spark.createDataFrame([(1, ["red", "car"]), (2, ["blue", "car"])], "id long, toks array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "id_l long, id_r long")
    rules = spark.createDataFrame([("red", "blue")], "a string, b string")
    got = NR.violations(pairs, sets, sets, rules)
    assert {tuple(x) for x in got.collect()} == {(1, 2)}
    assert "strategy=broadcast" in plan(got)
