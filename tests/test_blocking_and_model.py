import os

import pytest
from pyspark.sql import functions as F

from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import evaluate as E
from fuzzyspark.operators import model as M
from fuzzyspark.operators import validate as VA
from fuzzyspark.sources import views as V

from conftest import TRIPLES


def test_salting_does_not_change_blocking(spark, sf):
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    ln = B.normalize_records(L, "id", ["title"], stem=False)
    rn = B.normalize_records(R, "id", ["title"], stem=False)
    n = L.count()
    a = {tuple(r) for r in B.block_normalized(ln, rn, n, keep_score=True).collect()}
    b = {tuple(r) for r in B.block_normalized(ln, rn, n, salt_rows=2, keep_score=True).collect()}
    assert a == b and a


def test_topk_keeps_ties(spark):
    scores = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.5), (3, 10, 0.5), (4, 10, 0.1)],
                                   "id_l long, id_r long, score double")
    got = {r["id_l"] for r in B.top_k(scores, 2).collect()}
    assert got == {1, 2, 3}


def test_fit_invariants(spark, sf):
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    model, res = M.fit(L, R, "id")
    rows = res.collect()
    rids = [r["id_r"] for r in rows]
    assert len(rids) == len(set(rids)), "many-to-one"
    if model.configs:
        assert model.precision_est > 0.9
        pred = M.predict(model, L, R, "id").collect()
        assert {(r["id_l"], r["id_r"]) for r in pred} == {(r["id_l"], r["id_r"]) for r in rows}


def test_partition_count_invariance(spark, sf):
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    a = {tuple(r) for r in M.fit(L, R, "id")[1].select("id_l", "id_r").collect()}
    b = {tuple(r) for r in M.fit(L.repartition(3), R.repartition(5), "id")[1].select("id_l", "id_r").collect()}
    assert a == b


def test_model_roundtrip(spark, sf, tmp_path):
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    model, _ = M.fit(L, R, "id")
    model.save(spark, str(tmp_path / "m"))
    back = M.FuzzyJoinModel.load(spark, str(tmp_path / "m"))
    assert back.configs == model.configs and back.column_weights == model.column_weights


def test_splits(spark, sf):
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    a = VA.fold_assignment(L, R, "id", 5).where("side = 'R'").groupBy("fold").count().collect()
    sizes = sorted((r["fold"], r["count"]) for r in a)
    n = R.count()
    q, rem = divmod(n, 5)
    assert [s for _, s in sizes] == [q + 1] * rem + [q] * (5 - rem)
    s = VA.split_assignment(L, R, "id", 0.75).where("side = 'L' and part = 'train'").count()
    assert s == int(0.75 * L.count())


def test_evaluate_nan_on_empty(spark):
    gt = spark.createDataFrame([(1, 2)], "id_l long, id_r long")
    pred = spark.createDataFrame([], "id_l long, id_r long")
    res = E.evaluate(gt, pred)
    assert res["precision"] != res["precision"] and res["recall"] == 0.0


def _triple(spark, name):
    d = os.path.join(TRIPLES, name)
    if not TRIPLES or not os.path.exists(os.path.join(d, "left.csv")):
        pytest.skip("TRIPLES_DIR not set")
    rd = lambda f, s: spark.read.schema(s).option("header", True).option("quote", '"') \
        .option("escape", '"').option("multiLine", True).csv(os.path.join(d, f))
    return (rd("left.csv", "id string, title string"), rd("right.csv", "id string, title string"),
            rd("gt.csv", "id_l string, title_l string, id_r string, title_r string"))


@pytest.mark.parametrize("name", ["TennisTournament"])
def test_quality_on_a_labelled_triple(spark, name):
    L, R, gt = _triple(spark, name)
    model, res = M.fit(L, R, "id")
    pred = res.select(F.col("id_l"), F.col("id_r"))
    sc = E.evaluate(gt, pred)
    assert model.precision_est is None or model.precision_est > 0.9
    ids = [r["id_r"] for r in pred.collect()]
    assert len(ids) == len(set(ids))
    print(name, sc)


class LenDiff:
    """A custom join function: absolute length difference."""
    name = "lenDiff"

    def distance(self, left, right):
        return F.abs(F.length(left) - F.length(right)).cast("double")


def test_custom_join_function(spark):
    from fuzzyspark.operators.pairs import PairSpace
    L = spark.createDataFrame([(1, "abc"), (2, "a")], "id long, v string")
    R = spark.createDataFrame([(10, "abcde")], "id long, v string")
    ps = PairSpace(L, R, "id", ["v"], [LenDiff()], stem=False, persist=False)
    lr = spark.createDataFrame([(1, 10), (2, 10)], "id_l long, id_r long")
    got = {(r["id_l"], r["id_r"]): r["d0_0"] for r in ps.pair_distances(None, lr).collect()}
    assert got == {(1, 10): 2.0, (2, 10): 4.0}


def test_custom_function_and_blocker_are_kept_for_predict(spark):
    L = spark.createDataFrame([(i, "x" * (5 * i + 1)) for i in range(8)], "id long, v string")
    R = spark.createDataFrame([(10 + i, "x" * (5 * i + 1)) for i in range(8)], "id long, v string")

    class Everything:
        calls = 0

        def block(self, left, right, id_col, cols):
            Everything.calls += 1
            return left.select(F.col(id_col).alias("id_l"), F.lit(1).alias("k")).join(
                right.select(F.col(id_col).alias("id_r"), F.lit(1).alias("k")), "k").select("id_l", "id_r")

    model, res = M.fit(L, R, "id", join_function_space=[LenDiff()], blocker=Everything(), precision_target=0.5)
    want = {(r["id_l"], r["id_r"]) for r in res.collect()}
    assert want == {(i, 10 + i) for i in range(8)}
    before = Everything.calls
    assert {(r["id_l"], r["id_r"]) for r in M.predict(model, L, R, "id").collect()} == want
    assert Everything.calls > before


def test_containment_and_word_set_pairs(spark):
    import itertools
    import random
    rng = random.Random(3)
    sets = {i: sorted(rng.sample("abcdefg", rng.randint(0, 4))) for i in range(60)}
    df = lambda ids: spark.createDataFrame([(i, sets[i]) for i in ids], "id long, toks array<string>")
    got = sorted(tuple(r) for r in B.containment_pairs(df(range(30)), df(range(30, 60))).collect())
    assert got == [(x, y) for x, y in itertools.product(range(30), range(30, 60))
                   if sets[x] and sets[y] and (set(sets[x]) <= set(sets[y]) or set(sets[y]) <= set(sets[x]))]
    L = spark.createDataFrame([(1, "b a"), (2, "a c")], "id long, v string")
    R = spark.createDataFrame([(5, "A, b b!"), (6, "a")], "id long, v string")
    assert [tuple(r) for r in B.WordSetBlocker().block(L, R, "id", ["v"]).collect()] == [(1, 5)]


def test_sinks_and_summaries(spark, tmp_path):
    from fuzzyspark.sources import io
    pairs = spark.createDataFrame([(1, 2)], "id_l long, id_r long")
    out = str(tmp_path / "ds1" / "0" / "fit")
    io.write_predictions(out, pairs, pairs, pairs.limit(0), pairs.limit(0))
    assert spark.read.parquet(f"{out}/pred_tp").count() == 1 and spark.read.parquet(f"{out}/pred_fp").count() == 0
    io.write_learned(spark, out, M.FuzzyJoinModel([("f", 0.5)], {"v": 1.0}, None, 0.9))
    assert spark.read.parquet(f"{out}/join_configs").first()["threshold"] == 0.5
    io.write_summary(spark, out, {"precision": 0.5, "seconds": 3, "space": "sm"})
    r = io.collect_summaries(spark, str(tmp_path / "*/*/*/summary.csv")).first()
    assert (r["dataset"], r["attempt"], r["pipeline"], r["space"], float(r["precision"])) == ("ds1", "0", "fit", "sm", 0.5)
    assert io.load_optional(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert io.read_json_lines(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(FileNotFoundError):
        io.load_named(spark, str(tmp_path), "nothing")


def test_metrics_row(spark):
    gt = spark.createDataFrame([(1, 2), (3, 4)], "id_l long, id_r long")
    r = E.metrics(gt, spark.createDataFrame([(1, 2), (5, 6), (7, 8)], "id_l long, id_r long")).first()
    assert (r.n_pred, r.n_gt, r.n_tp) == (3, 2, 1) and r.fscore == pytest.approx(2 * (1 / 3) * 0.5 / (1 / 3 + 0.5))
    assert E.metrics(gt, gt.limit(0)).first().precision is None


def test_json_and_csv_readers(spark, tmp_path):
    from fuzzyspark.sources import io
    (tmp_path / "b.json").write_text('{"results": {"bindings": [{"entId": {"value": "Q1", "type": "uri"}}, '
                                     '{"entId": {"value": "Q2", "type": "uri"}}]}}')
    rows = io.read_bindings(spark, str(tmp_path / "b.json")).collect()
    assert [r["entId"]["value"] for r in rows] == ["Q1", "Q2"]
    d = tmp_path / "ds"
    d.mkdir()
    (d / "left.csv").write_text('id,title\n1,"A, B"\n2,C\n')
    (d / "right.csv").write_text('id,title\n5,"A B"\n')
    (d / "gt.csv").write_text('id_l,title_l,id_r,title_r\n1,"A, B",5,A B\n')
    left, right, gt = io.load_triple(spark, str(d))
    assert [r["title"] for r in left.orderBy("id").collect()] == ["A, B", "C"]
    assert gt.count() == 1


def test_reward_is_precision_times_matches(spark, sf):
    from fuzzyspark.operators import greedy as G
    g = spark.createDataFrame([(1, {0: (1, [1.0])}), (2, {0: (2, [0.5])})],
                              "id_r long, m map<int, struct<l: long, ps: array<double>>>")
    res = G.run_greedy(g, 0.7)
    n = G.resolve_matches(g, res.configs).count()
    assert round(res.precision * n, 6) == round(1.5 / 2 * 2, 6)


def test_streaming_apply_matches_batch_predict(spark, sf, tmp_path):
    from fuzzyspark.streaming import apply as SA
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    model, _ = M.fit(L, R, "id")
    if not model.configs:
        pytest.skip("no join learned at this size")
    src = str(tmp_path / "r")
    R.write.parquet(src)
    stream = spark.readStream.schema(R.schema).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = SA.start(model, L, stream, "id", out, ck, trigger_seconds=None)
    q.awaitTermination(300)
    got = {(r["id_l"], r["id_r"]) for r in spark.read.parquet(out).collect()}
    want = {(r["id_l"], r["id_r"]) for r in M.predict(model, L, R, "id").collect()}
    assert got == want


def test_new_column_weights_keep_ratios():
    assert M.new_weights(None, [0, 0.5, 1]) == [[1.0]]
    got = M.new_weights([0.5, 0.5], [0.0, 0.1, 0.2, 1.0])
    assert got == [[pytest.approx(0.45), pytest.approx(0.45), 0.1], [pytest.approx(0.4), pytest.approx(0.4), 0.2]]


def test_multi_column_fit(spark, sf):
    L, R = V.fj_left(spark, sf, True), V.fj_right(spark, sf, True)
    model, res = M.fit(L, R, "id", on=["title", "lang"])
    ids = [r["id_r"] for r in res.collect()]
    assert len(ids) == len(set(ids))
    if model.configs:
        assert sum(model.column_weights.values()) == pytest.approx(1.0)
        assert set(model.column_weights) <= {"title", "lang"}


def test_minhash_blocker_finds_similar_sets(spark):
    """Against all pairs: nothing below the threshold, nearly all at or above it; copies, blanks and a common set."""
    import random

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeiou") for _ in range(6)) for _ in range(60)]
    base = [" ".join(rng.sample(words, 6)) for _ in range(60)]
    near = [b.replace(b.split()[0], b.split()[0] + "x", 1) for b in base]
    L = [(i, t) for i, t in enumerate(base + base[:5] + ["", None])]
    R = [(1000 + i, t) for i, t in enumerate(near + base[:20] + [base[0]] * 200 + ["", None])]
    dl, dr = (spark.createDataFrame(x, "id long, title string") for x in (L, R))
    got = {(r.id_l, r.id_r): r.jaccard for r in B.MinHashBlocker(0.6, stem=False).block(dl, dr, "id", ["title"], True).collect()}
    assert {tuple(r) for r in B.MinHashBlocker(0.6, stem=False, salt_rows=2).block(dl, dr, "id", ["title"]).collect()} == set(got)
    sets = [{r["id"]: set(r["t"]) for r in B.normalize_records(d, "id", ["title"], False).where("value <> ''")
             .select("id", B.block_tokens("value").alias("t")).collect()} for d in (dl, dr)]
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets[0].items() for b, y in sets[1].items()}
    want = {k: v for k, v in want.items() if v >= 0.6}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert len(want) > 300 and len(got) / len(want) > 0.95
    assert B.MinHashBlocker().block(dl.limit(0), dr, "id", ["title"]).collect() == []


def test_train_score_writes_a_run(spark, sf, tmp_path):
    from fuzzyspark.sources import io

    L, R, out = V.fj_left(spark, sf), V.fj_right(spark, sf), str(tmp_path / "titles" / "0" / "auto")
    row = VA.train_score(L, R, V.fj_gt(spark, sf), "id", out, distance_threshold_space=5).first().asDict()
    kept = io.collect_summaries(spark, str(tmp_path / "*" / "*" / "*" / "summary.csv")).first().asDict()
    assert (kept["dataset"], kept["attempt"], kept["pipeline"]) == ("titles", "0", "auto")
    assert all(float(kept[k]) == pytest.approx(v) for k, v in row.items() if v is not None)  # summaries are read as text
    back = M.FuzzyJoinModel.load(spark, f"{out}/model")
    assert len(back.configs or []) == row["n_configs"] == spark.read.parquet(f"{out}/join_configs").count()
    n = {k: spark.read.parquet(f"{out}/{k}").count() for k in ("pred", "pred_tp", "pred_fp", "pred_fn")}
    assert n["pred"] == n["pred_tp"] + n["pred_fp"] == row["n_pred_test"] and n["pred_tp"] + n["pred_fn"] == row["n_gt_test"]


# ------------------------------------------------------------ held reference
def _held_model():
    return M.FuzzyJoinModel([("lower_splitBySpace_idfWeight_jaccardDistance", 0.35), ("lower_threeGram_uniformWeight_diceDistance", 0.3)],
                            {"title": 1.0}, None, None, {"on": ["title"], "stem": False})


def _triples(df):
    return {(r["id_l"], r["id_r"], round(r["p"], 9)) for r in df.collect()}


def test_held_reference_predicts_as_the_whole_join(spark, sf, tmp_path):
    from fuzzyspark.operators.reference import HeldReference
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    model, path = _held_model(), str(tmp_path / "held")
    want = _triples(M.predict_matches(model, L, R, "id"))
    held = M.hold(model, L, "id", path, buckets=3)
    assert want and _triples(M.predict_matches(model, held, R, "id")) == want
    held.forget(spark)
    back = HeldReference.load(spark, path)
    assert back.n_left == L.count() and _triples(M.predict_matches(model, back, R, "id")) == want
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(M.predict(model, back, R, "id")) == rows(M.predict(model, L, R, "id"))


def test_held_reference_of_a_fit(spark, sf, tmp_path):
    """Rules, weights and null distances of the fit go into the held state; both paths give the matches of the fit."""
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    space = {"preprocess_methods": ["lower"], "tokenize_methods": ["threeGram"], "token_weights": ["idfWeight"],
             "char_distance_functions": ["editDistance"], "set_distance_functions": ["jaccardDistance"]}
    model, res = M.fit(L, R, "id", join_function_space=space, distance_threshold_space=8)
    assert model.configs and set(model.params["null_fill"]) >= {jf for jf, _ in model.configs}
    held = M.hold(model, L, "id", str(tmp_path / "held"))
    got = {(r["id_l"], r["id_r"]) for r in M.predict(model, held, R, "id").collect()}
    assert got == {(r["id_l"], r["id_r"]) for r in res.collect()}


def test_held_predictions_do_not_depend_on_the_batch(spark, sf, tmp_path):
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    R = R.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "...")], R.schema))
    model = _held_model()
    held = M.hold(model, L, "id", str(tmp_path / "held"))
    whole = _triples(M.predict_matches(model, held, R, "id"))
    parts = [_triples(M.predict_matches(model, held, R.where(F.pmod(F.hash("id"), F.lit(3)) == i), "id")) for i in range(3)]
    assert whole == set().union(*parts)


def test_held_prediction_leaves_l_alone(spark, sf, tmp_path):
    """The records of L are read in their buckets: no shuffle, no second blocking of L."""
    L, R = V.fj_left(spark, sf), V.fj_right(spark, sf)
    held = M.hold(_held_model(), L, "id", str(tmp_path / "held"), buckets=3)
    pairs = R.select(F.col("id").alias("id_r"), F.col("id").alias("id_l")).hint("merge")
    plan = pairs.join(held.records.select(F.col("id").alias("id_l"), "toks"), "id_l")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_held_reference_edge_cases(spark, tmp_path):
    """Empty R, empty L, another model, and a custom blocker."""
    schema = "id long, title string"
    L = spark.createDataFrame([(1, "red fox den"), (2, "blue whale song"), (3, None)], schema)
    R = spark.createDataFrame([(7, "red fox den"), (8, "blue whale sung"), (9, None)], schema)
    model = _held_model()
    held = M.hold(model, L, "id", str(tmp_path / "a"))
    assert M.predict(model, held, R.limit(0), "id").count() == 0
    empty = M.hold(model, L.limit(0), "id", str(tmp_path / "b"))
    assert M.predict(model, empty, R, "id").count() == 0
    other = _held_model()
    other.configs = other.configs[:1]
    with pytest.raises(ValueError):
        M.predict(other, held, R, "id").count()
    words = B.WordSetBlocker()
    held = M.hold(model, L, "id", str(tmp_path / "c"), blocker=words)
    got = _triples(M.predict_matches(model, held, R, "id", blocker=words))
    assert (1, 7, 1.0) in got and got == _triples(M.predict_matches(model, L, R, "id", blocker=words))
