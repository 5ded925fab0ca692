import pytest
from pyspark.sql import functions as F

from fuzzyspark.operators import greedy as G
from fuzzyspark.operators import precision as P
from fuzzyspark.operators import rules as NR

G_SCHEMA = "id_r long, m map<int, struct<l: long, ps: array<double>>>"


def _G(spark, configs):
    """configs: list of {r: (l, p)}; config i becomes join function i, one threshold."""
    per_r = {}
    for j, cfg in enumerate(configs):
        for r, (l, p) in cfg.items():
            per_r.setdefault(r, {})[j] = (l, [p])
    return spark.createDataFrame([(r, m) for r, m in per_r.items()], G_SCHEMA)


A = {1: (1, 1.0), 2: (2, 1.0)}
B = {1: (1, 1.0), 2: (2, 1.0), 3: (3, 0.5)}
C = {3: (4, 1.0), 4: (4, 0.25)}


@pytest.mark.parametrize("configs,target,kept,prec", [
    ([A, B], 0.8, [0, 1], 0.833333),
    ([A, B], 0.9, [0], 1.0),
    ([A, B, C], 0.8, [0, 1], 0.833333),
    ([A, B, C], 0.6, [0, 1, 2], 0.65),
])
def test_greedy_hand_cases(spark, configs, target, kept, prec):
    g = _G(spark, configs).cache()
    res = G.run_greedy(g, target)
    assert [j for j, _ in res.configs] == kept
    assert round(res.precision, 6) == prec
    m = {r["id_r"]: r["id_l"] for r in G.resolve_matches(g, res.configs).collect()}
    if len(configs) == 3 and target == 0.8:
        assert m[3] == 3
    if target == 0.6:
        assert m[3] == 4 and m[4] == 4


def _matches(configs, chosen):
    """Definition: r joins the l of its chosen config of highest p, the earliest on ties."""
    best = {}
    for place, j in enumerate(chosen):
        for r, (l, p) in configs[j].items():
            best[r] = max(best.get(r, (0.0, 0, None)), (p, -place, l))
    return {r: l for r, (_, _, l) in best.items()}


def _measure(configs, chosen):
    """(TP, n) of a set of configs: the sum over r of its highest p, and the number of distinct (r, l)."""
    tops, pairs = {}, set()
    for j in chosen:
        for r, (l, p) in configs[j].items():
            tops[r] = max(tops.get(r, 0.0), p)
            pairs.add((r, l))
    return sum(tops.values()), len(pairs)


def _best_chain(configs, target, patience=0.05):
    """Every extension of the chosen set is measured as a whole; the last prefix above the target counts."""
    chosen, kept = [], None
    while True:
        n = _measure(configs, chosen)[1]
        options = [(j, *_measure(configs, [*chosen, j])) for j in range(len(configs))]
        options = [(round(tp / (m - tp + 1e-9), 9), -j, tp / (m + 1e-9)) for j, tp, m in options if m > n]
        if not options:
            return kept
        _, j, precision = max(options)
        chosen.append(-j)
        if precision > target:
            kept = (list(chosen), precision, _matches(configs, chosen))
        if precision < target - patience:
            return kept


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_greedy_matches_definition(spark, partitions):
    import random
    rng = random.Random(7)
    for _ in range(2):
        configs = []
        for _j in range(5):
            cfg = {}
            for r in range(1, 13):
                if rng.random() < 0.5:
                    cfg[r] = (rng.randint(1, 4), rng.choice([1.0, 0.5, 1 / 3, 0.25]))
            configs.append(cfg)
        target = rng.choice([0.5, 0.6, 0.7])
        want = _best_chain(configs, target)
        g = _G(spark, configs).repartition(partitions).cache()
        res = G.run_greedy(g, target)
        if want is None:
            assert res.configs is None
            continue
        assert [j for j, _ in res.configs] == want[0]
        assert res.precision == pytest.approx(want[1])
        got = {r["id_r"]: r["id_l"] for r in G.resolve_matches(g, res.configs).collect()}
        assert got == want[2]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_small_searches_take_one_task_and_few_jobs(spark, monkeypatch, kind):
    """Each step of a search was a job, however few its records."""
    import random
    rng, nj, nt, rows = random.Random(11), 4, 6, []
    for w in range(3):
        for r in range(60):
            ls, ps = [], []
            for _ in range(nj):
                first, n = rng.randint(0, nt), rng.randint(0, 3)
                ls.append(None if first == nt else rng.randint(1, 9))
                ps += [None if t < first else 1 / (1 + n + (t - first) // 2) for t in range(nt)]
            rows.append((w, r, [x if x is None or kind == "long" else f"l{x}" for x in ls], ps, nt))
    rows.append((5, 1, [None] * nj, [None] * (nj * nt), nt))  # a search without proposals has no result
    g = spark.createDataFrame(rows, f"w int, id_r long, ls array<{kind}>, ps array<double>, nt int").repartition(3).cache()
    sc = spark.sparkContext
    sc.setJobGroup(f"small {kind}", "small")
    small = G.run_greedy_many(g, 0.5)
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"small {kind}"))
    sc.setJobGroup(f"steps {kind}", "steps")
    monkeypatch.setattr(G, "TASK_BYTES", 0)
    steps = G.run_greedy_many(g, 0.5)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(small) == sorted(steps) == [0, 1, 2]
    most = max(len(x.selected) for x in steps.values())
    assert most > 8 and jobs < most
    for w, want in steps.items():
        got = small[w]
        assert (got.selected, got.n_keep) == (want.selected, want.n_keep)
        assert got.precision == pytest.approx(want.precision) and got.last_precision == pytest.approx(want.last_precision)
        assert [(h["j"], h["t"], h["n"]) for h in got.history] == [(h["j"], h["t"], h["n"]) for h in want.history]


def test_ball_count_hand_value(spark):
    dist = spark.createDataFrame(
        [("LL", 11, 100, "x", 0.1), ("LL", 12, 100, "x", 0.3), ("LL", 13, 100, "x", 0.5),
         ("LR", 100, 1, "x", 0.1)], "side string, id_l long, id_r long, jf string, d double")
    near = P.nearest(dist)
    thr = P.threshold_table(spark, {"x": [0.15]})
    balls = P.ball_counts(dist, near, thr)
    assert balls.first()["cum"] == [2]
    m = P.local_precision(near, balls, thr).first()
    assert m["ps"] == [pytest.approx(1 / 3)]


def test_nearest_tie_takes_smallest_id(spark):
    dist = spark.createDataFrame([("LR", 5, 1, "x", 0.2), ("LR", 3, 1, "x", 0.2), ("LR", 9, 1, "x", 0.1),
                                  ("LR", 4, 2, "x", 0.3), ("LR", 2, 2, "x", 0.3)],
                                 "side string, id_l long, id_r long, jf string, d double")
    got = {r["id_r"]: r["id_l"] for r in P.nearest(dist).collect()}
    assert got == {1: 9, 2: 2}


def test_negative_rules(spark):
    L = spark.createDataFrame([(1, "2008 us open"), (2, "2009 us open"), (3, "2008"), (4, "2009")],
                              "id long, title string")
    R = spark.createDataFrame([(10, "2009 us open tennis"), (11, "us open 2008 tennis")], "id long, title string")
    ls = NR.token_sets(L, "id", ["title"], stem=False)
    rs = NR.token_sets(R, "id", ["title"], stem=False)
    ll = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "id_l long, id_r long")
    rules = {(r["a"], r["b"]) for r in NR.learn(ll, ls).collect()}
    assert rules == {("2008", "2009"), ("2009", "2008")}
    lr = spark.createDataFrame([(1, 10), (1, 11)], "id_l long, id_r long")
    kept = {(r["id_l"], r["id_r"]) for r in NR.apply(lr, ls, rs, NR.learn(ll, ls)).collect()}
    assert kept == {(1, 11)}
