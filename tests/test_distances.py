import math
import random

import pytest
from pyspark.sql import functions as F

from fuzzyspark.functions import distances as D
from fuzzyspark.functions.distances import _runs, jaro_distance, jaro_winkler_similarities
from fuzzyspark.operators.pairs import PairSpace
from fuzzyspark.operators.space import JoinFunction, resolve

SETS = ["jaccardDistance", "cosineDistance", "diceDistance", "maxincDistance", "intersectDistance",
        "containJaccardDistance", "containCosineDistance", "containDiceDistance"]


def _dist(spark, lvals, rvals, pairs, weight):
    L = spark.createDataFrame(lvals, "id long, v string")
    R = spark.createDataFrame(rvals, "id long, v string")
    jfs = [JoinFunction("lower", "splitBySpace", weight, d) for d in SETS]
    ps = PairSpace(L, R, "id", ["v"], jfs, stem=False, persist=False)
    lr = spark.createDataFrame(pairs, "id_l long, id_r long")
    rows = ps.pair_distances(None, lr, fill=False).collect()
    return {(r["id_l"], r["id_r"]): [round(r[f"d{i}_0"], 6) for i in range(len(SETS))] for r in rows}


def test_uniform_hand_values(spark):
    # left documents define weights only for idf; uniform ignores them
    out = _dist(spark, [(1, "a b c"), (2, "a b")], [(10, "b c d"), (11, "a b b c")],
                [(1, 10), (2, 11)], "uniformWeight")
    assert out[(1, 10)] == [0.5, 0.333333, 0.333333, 0.333333, 0.666667, 1.0, 1.0, 1.0]
    assert out[(2, 11)] == [0.333333, 0.133975, 0.2, 0.0, 0.6, 0.333333, 0.133975, 0.2]


def test_idf_hand_values(spark):
    # N = 4 left records with df(a)=1, df(b)=3, df(c)=4; unseen d -> ln 4
    left = [(1, "a b c"), (2, "b c"), (3, "b c"), (4, "c")]
    out = _dist(spark, left, [(10, "b c d")], [(1, 10)], "idfWeight")
    assert out[(1, 10)] == [1.120209, 0.951301, 1.273267, 1.47477, 1.136633, 1.0, 1.0, 1.0]


def test_empty_token_lists_are_null_then_filled(spark):
    L = spark.createDataFrame([(1, "a"), (2, "   ")], "id long, v string")
    R = spark.createDataFrame([(10, "a"), (11, "")], "id long, v string")
    jf = JoinFunction("lower", "splitBySpace", "uniformWeight", "jaccardDistance")
    ps = PairSpace(L, R, "id", ["v"], [jf], stem=False, persist=False)
    lr = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "id_l long, id_r long")
    raw = {(r["id_l"], r["id_r"]): r["d0_0"] for r in ps.pair_distances(None, lr, fill=False).collect()}
    assert raw[(1, 10)] == pytest.approx(0.0, abs=1e-8) and raw[(1, 11)] is None and raw[(2, 10)] is None
    filled = {(r["id_l"], r["id_r"]): r["d0_0"] for r in ps.pair_distances(None, lr).collect()}
    assert filled[(1, 11)] == pytest.approx(0.0, abs=1e-8) and filled[(2, 10)] == pytest.approx(0.0, abs=1e-8)


def jaro_winkler_similarity(a, b):
    """The definition, character by character."""
    taken, pairs = set(), []
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    for i, ch in enumerate(a):
        j = next((j for j, other in enumerate(b) if other == ch and j not in taken and abs(i - j) <= reach), None)
        if j is not None:
            taken.add(j)
            pairs.append(ch)
    m = len(pairs)
    if m == 0:
        return 0.0
    t = sum(x != b[j] for x, j in zip(pairs, sorted(taken))) // 2
    sim = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(len(a), len(b), 4) and a[same] == b[same]:
        same += 1
    return sim + same * 0.1 * (1 - sim) if sim > 0.7 else sim


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(7)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    for alphabet, n in (("ab", 9), ("abcdef gh", 24), ("aé日\U0001F600\x00", 12)):
        left, right = [word(alphabet, n) for _ in range(3000)], [word(alphabet, n) for _ in range(3000)]
        assert list(jaro_winkler_similarities(left, right)) == pytest.approx([jaro_winkler_similarity(*p) for p in zip(left, right)], abs=1e-12)
    assert list(jaro_winkler_similarities([], [])) == [] and list(jaro_winkler_similarities([""], [""])) == [0.0]


def test_runs_of_lengths_are_bounded():
    lengths = sorted([1] * 500 + [7] * 30 + [90, 250, 4000], reverse=True)
    starts = _runs(lengths, 100)
    for lo, hi in zip(starts, starts[1:] + [len(lengths)]):
        assert hi - lo == 1 or (hi - lo) * lengths[lo] <= 100
    assert _runs([]) == [] and _runs([0, 0]) == [0]


def test_jaro_distance_column(spark):
    long = "x" * 3000
    rows = [("martha", "marhta"), ("martha", "marhta"), (None, "a"), ("a", None), ("", "a"), (long, long + "y"), (None, None), ("a", "b")]
    got = [r["d"] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(
        jaro_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    want = [None if not x or not y else pytest.approx(1 - jaro_winkler_similarity(x, y)) for x, y in rows]
    assert got == want


@pytest.mark.parametrize("a,b,d", [("martha", "marhta", 0.038889), ("dwayne", "duane", 0.16),
                                   ("abcd", "axyz", 0.5), ("same", "same", 0.0)])
def test_jaro_winkler_hand_values(a, b, d):
    assert round(1 - jaro_winkler_similarities([a], [b])[0], 6) == d


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_char_distances_match_brute_force_on_pages(spark, sf):
    from fuzzyspark.plans.catalog import QUERIES
    from fuzzyspark.sources import views as V
    L = {r["id"]: r["title"].lower() for r in V.fj_left(spark, sf).collect()}
    R = {r["id"]: r["title"].lower() for r in V.fj_right(spark, sf).collect()}
    edit = QUERIES["dist_edit"](spark, sf).collect()
    jaro = {(r["id_l"], r["id_r"]): r["d"] for r in QUERIES["dist_jaro"](spark, sf).collect()}
    assert edit
    for r in edit:
        a, b = L[r["id_l"]], R[r["id_r"]]
        assert r["d"] == _lev(a, b)
        assert jaro[(r["id_l"], r["id_r"])] == round(1 - jaro_winkler_similarity(a, b), 6)


def test_space_sizes():
    assert len(resolve("sm")) == 14
    assert len(resolve("md")) == 102
    assert len(resolve("lg")) == 136
    names = [j.name for j in resolve("sm")]
    assert "lower_None_None_jaroDistance" in names
    assert len(set(names)) == 14


def test_embedding_distances(spark):
    from fuzzyspark.functions.distances import embed_cosine_distance, embed_l2_distance
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(embed_cosine_distance(F.col("a"), F.col("b")).alias("c"),
                     embed_l2_distance(F.col("a"), F.col("b")).alias("e")).collect()
    assert rows[0]["c"] == pytest.approx(1.0) and rows[0]["e"] == pytest.approx(math.sqrt(2))
    assert rows[1]["c"] == pytest.approx(0.0) and rows[1]["e"] == pytest.approx(0.0)


def test_shared_tokens_are_found_once_a_pair(spark):
    """The intersection was evaluated for each of its three sums, and the weight of a token three times."""
    prof = "struct<tk:array<bigint>,dup:map<bigint,int>,n:int,s:double,nrm:double>"
    code = lambda number, df: (number << D.DF_BITS) | df
    x, y, z = code(1, 3), code(2, 1), code(3, 7)
    rows = [(([x, y], {}, 2, 1.0, 1.0), ([y, x, z], {}, 3, 1.0, 1.0)), (([x, y], {x: 4}, 2, 1.0, 1.0), ([x], {x: 2}, 1, 1.0, 1.0)),
            (([z], {}, 1, 1.0, 1.0), ([x], {}, 1, 1.0, 1.0)), (None, ([x], {}, 1, 1.0, 1.0))]
    df = spark.createDataFrame(rows, f"l {prof}, r {prof}")
    got = df.select(D.pair_stats(F.col("l"), F.col("r"), True, 10).alias("s"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") <= 1
    w = {c: math.log(10 / (n + 1)) for c, n in ((x, 3), (y, 1), (z, 7))}
    a, b, c, d = (r["s"] for r in got.collect())
    assert (a["ni"], a["I"], a["dot"]) == (2, pytest.approx(w[x] + w[y]), pytest.approx(w[x] ** 2 + w[y] ** 2))
    assert (b["ni"], b["I"], b["dot"]) == (1, pytest.approx(w[x]), pytest.approx(8 * w[x] ** 2))
    assert (c["ni"], c["I"], c["dot"]) == (0, 0.0, 0.0) and d["I"] is None
