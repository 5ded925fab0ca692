"""Learn a fuzzy join (fit) and apply it (predict)."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import greedy as G
from fuzzyspark.operators import precision as P
from fuzzyspark.operators import rules as NR
from fuzzyspark.operators import reference as RF
from fuzzyspark.operators.pairs import PairSpace, to_long
from fuzzyspark.operators.space import JoinFunction, from_name, resolve
from fuzzyspark.session import checkpoint_dir, reliable_checkpoint

RULE_SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@dataclass
class FuzzyJoinModel:
    configs: list | None                 # ordered [(jf name, threshold)]
    column_weights: dict | None          # {column: weight}
    rules: DataFrame | None              # (a, b)
    precision_est: float | None
    params: dict = field(default_factory=dict)
    history: list = field(default_factory=list)
    blocker: object | None = None        # as fitted; the token blocker is also kept in params
    custom: dict = field(default_factory=dict)   # custom join functions by name

    def save(self, spark: SparkSession, path: str):
        """Model directory of two Spark tables: params (one JSON row) and rules.

        A custom blocker and custom join functions are code; pass them to
        ``load`` again."""
        meta = {"configs": self.configs, "column_weights": self.column_weights,
                "precision_est": self.precision_est, "params": self.params}
        spark.createDataFrame([(json.dumps(meta),)], "params string").write.mode("overwrite").parquet(f"{path}/params")
        rules = self.rules if self.rules is not None else spark.createDataFrame([], RULE_SCHEMA)
        rules.write.mode("overwrite").parquet(f"{path}/rules")

    @staticmethod
    def load(spark: SparkSession, path: str, blocker=None, custom_jfs=()) -> "FuzzyJoinModel":
        meta = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
        cfg = [tuple(c) for c in meta["configs"]] if meta["configs"] else None
        return FuzzyJoinModel(cfg, meta["column_weights"], spark.read.parquet(f"{path}/rules"), meta["precision_est"],
                              meta["params"], blocker=blocker, custom={j.name: j for j in custom_jfs})

    def fitted_blocker(self):
        """The blocker of the fit, or None for the default one."""
        kept = self.params.get("blocker")
        return self.blocker or (B.TokenBlocker(**kept) if kept else None)


def join_columns(left: DataFrame, right: DataFrame, id_col: str, on=None) -> list[str]:
    if on is not None:
        return [on] if isinstance(on, str) else list(on)
    return sorted((set(left.columns) & set(right.columns)) - {id_col})


def augment(left: DataFrame, left_aug: DataFrame | None) -> DataFrame:
    """L ∪ extra reference rows, distinct (missing columns → null)."""
    if left_aug is None:
        return left
    return left.unionByName(left_aug, allowMissingColumns=True).distinct()


@dataclass
class Prepared:
    ll: DataFrame
    lr: DataFrame
    rules: DataFrame
    ps: PairSpace
    long: DataFrame
    cols: list


def _cut(df: DataFrame, checkpoint: bool) -> DataFrame:
    """Stage boundary: a reliable checkpoint in the shared checkpoint folder
    (short plans, survives executor loss), else a materialised persist."""
    if checkpoint:
        return reliable_checkpoint(df)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def prepare(left, right, id_col, cols, jfs, blocker=None, pretrained_rules=None,
            stem=True, checkpoint=True, null_fill=None) -> Prepared:
    """Blocking, rule learning + pruning, and every distance (long form).

    The candidate pairs, the rules and the distance table are each cut at a
    checkpoint, so downstream plans stay short whatever came before."""
    blocker = blocker or B.TokenBlocker(stem=stem)
    ll, lr, lnorm, rnorm = B.block_pairs(blocker, left, right, id_col, cols)
    if lnorm is not None:
        lsets, rsets = NR.word_sets(lnorm), NR.word_sets(rnorm)
    else:
        lsets = NR.token_sets(left, id_col, cols, stem)
        rsets = NR.token_sets(right, id_col, cols, stem)
    ll = _cut(ll, checkpoint)
    rules = _cut(NR.merge(pretrained_rules, NR.learn(ll, lsets)), checkpoint)
    lr = _cut(NR.apply(lr, lsets, rsets, rules), checkpoint)
    for df in (lnorm, rnorm, getattr(blocker, "last_postings", None)):
        if df is not None:
            df.unpersist()
    ps = PairSpace(left, right, id_col, cols, jfs, stem)
    # the wide table (one row per pair) is the stage boundary; the filling of
    # its nulls and the long form are narrow projections of it
    wide = ps.pair_distances(ll, lr, null_fill=null_fill, cut=lambda df: _cut(df, checkpoint))
    ps.unpersist()
    long = to_long(wide, ps)
    return Prepared(ll, lr, rules, ps, long, cols)


def _build_G(spark, dist, ts_map, checkpoint=True):
    near = P.nearest(dist)
    thr = P.threshold_table(spark, ts_map)
    balls = P.ball_counts(dist, near, thr)
    m = P.local_precision(near, balls, thr)
    nj, nt = len(ts_map), max((len(v) for v in ts_map.values()), default=1)
    return G.materialize_G(P.per_r(m), checkpoint, nj, nt), thr


def run_weights(spark, prep: Prepared, weights: list[list[float]], target: float, grid: list[float], checkpoint=True) -> list[dict]:
    """The greedy result of every weight vector, found together: the number of the vector is a part of
    the key of distances, thresholds and gains, so each step of the search is one job for all of them.

    A vector without candidate pairs has no result."""
    # read from the distance table each time: as rows of a function and a weight it is many times as large
    dist = P.weighted_all(prep.long, len(prep.cols), weights)
    near = P.nearest(dist).persist(StorageLevel.MEMORY_AND_DISK)
    ts_all = P.threshold_grid(near, grid)
    ts: dict[int, dict] = {}
    for key, values in ts_all.items():
        w, jf = key.split("|", 1)
        ts.setdefault(int(w), {})[jf] = values
    if not ts:
        near.unpersist()
        return []
    thr = P.threshold_table(spark, ts_all)
    # j counts the functions of one vector, in order of their names
    numbers = {f"{w}|{jf}": j for w, names in ts.items() for j, jf in enumerate(sorted(names))}
    place = spark.createDataFrame([(k, int(k.split("|", 1)[0]), j) for k, j in numbers.items()], "jf string, w int, j int")
    m = P.local_precision(near, P.ball_counts(dist, near, thr), thr.drop("j").join(F.broadcast(place), "jf"), "w")
    nj, nt = max(map(len, ts.values())), max(len(v) for v in ts_all.values())
    Gdf = G.materialize_G(P.per_r(m, "w"), checkpoint, nj, nt)
    near.unpersist()
    found = G.run_greedy_many(Gdf, target)
    kept = {w: r.configs for w, r in found.items() if r.configs}
    n_r = G.matched(Gdf, kept) if kept else {}
    out = []
    for w in sorted(ts):
        res = found.get(w) or G.GreedyResult()
        out.append({"w": w, "weights": weights[w], "greedy": res, "G": Gdf, "names": sorted(ts[w]), "ts": ts[w],
                    "reward": res.precision * n_r.get(w, 0) if res.configs else float("-inf")})
    return out


def new_weights(old: list[float] | None, grid: list[float]) -> list[list[float]]:
    """Weights for one more column keeping the old ratios: [(1−w)·old…, w]."""
    if old is None:
        return [[1.0]]
    return [[(1 - nw) * w for w in old] + [nw] for nw in grid[1:-1]]


def fit(left: DataFrame, right: DataFrame, id_col: str, on=None, precision_target: float = 0.9,
        join_function_space="sm", distance_threshold_space=50, column_weight_space=10,
        blocker=None, left_aug: DataFrame | None = None, stem: bool = True,
        checkpoint: bool = True, negative_rules: DataFrame | None = None):
    """Learn the join; returns ``(model, result)``.

    ``negative_rules`` are rules learned before; those of L are added to them.

    ``result`` holds the matched L and R rows (columns suffixed ``_l`` /
    ``_r``) sorted by the R id, or an empty frame of that schema when the
    target cannot be met.
    """
    spark = left.sparkSession
    left = augment(left, left_aug)
    cols = join_columns(left, right, id_col, on)
    jfs = resolve(join_function_space)
    grid = P.linspace(distance_threshold_space) if isinstance(distance_threshold_space, int) \
        else list(distance_threshold_space)
    wgrid = P.linspace(column_weight_space) if isinstance(column_weight_space, int) \
        else list(column_weight_space)
    prep = prepare(left, right, id_col, cols, jfs, blocker, negative_rules, stem, checkpoint)

    best_reward, best = float("-inf"), None
    base_cols: list[str] = []
    base_w = None
    for _ in range(len(cols)):
        options = [(c, w) for c in cols if c not in base_cols for w in new_weights(base_w, wgrid)]
        lists = [[dict(zip(base_cols + [c], w)).get(cc, 0.0) for cc in cols] for c, w in options]
        step_best = None
        for r in run_weights(spark, prep, lists, precision_target, grid, checkpoint):
            c, w = options[r["w"]]
            if step_best is None or r["reward"] > step_best["reward"]:
                step_best = {**r, "columns": base_cols + [c], "wlist_sel": w}
        if step_best is None or step_best["reward"] <= best_reward:
            if step_best is not None:
                step_best["G"].unpersist()
            break
        if best is not None:
            best["G"].unpersist()
        best_reward, best = step_best["reward"], step_best
        base_cols, base_w = step_best["columns"], step_best["wlist_sel"]

    params = {"id_column": id_col, "on": cols, "stem": stem,
              "join_function_space": join_function_space if isinstance(join_function_space, (str, dict)) else None,
              "precision_target": precision_target}
    if isinstance(blocker, B.TokenBlocker):
        params["blocker"] = {k: getattr(blocker, k) for k in ("num_candidates", "weighting", "stem", "salt_rows")}
    kept = {"blocker": blocker, "custom": {j.name: j for j in jfs if not isinstance(j, JoinFunction)}}
    if best is None or best["greedy"].configs is None:
        model = FuzzyJoinModel(None, None, prep.rules, None, params, **kept)
        return model, empty_result(left, right)
    names = best["names"]
    configs = [(names[j], best["ts"][names[j]][t]) for j, t in best["greedy"].configs]
    weights = dict(zip(best["columns"], best["wlist_sel"]))
    params["null_fill"] = {r["jf"]: {c: r[f"d_{i}"] for i, c in enumerate(cols)}
                           for r in RF.maxima(prep.long.where(F.col("side") == "LR"), len(cols))}
    model = FuzzyJoinModel(configs, weights, prep.rules, best["greedy"].precision, params,
                           best["greedy"].history, **kept)
    model.matches = G.resolve_matches(best["G"].where(F.col("w") == best["w"]), best["greedy"].configs)
    return model, materialize(model.matches, left, right, id_col)


def empty_result(left: DataFrame, right: DataFrame) -> DataFrame:
    fields = [T.StructField(f.name + "_l", f.dataType) for f in left.schema.fields] + \
             [T.StructField(f.name + "_r", f.dataType) for f in right.schema.fields]
    return left.sparkSession.createDataFrame([], T.StructType(fields))


def materialize(matches: DataFrame, left: DataFrame, right: DataFrame, id_col: str,
                distinct: bool = False) -> DataFrame:
    """Matched pairs with the full L and R rows, sorted by the R id."""
    lcols = [F.col(c).alias(c + "_l") for c in left.columns]
    rcols = [F.col(c).alias(c + "_r") for c in right.columns]
    out = (matches.select(F.col("id_l").alias("__l"), F.col("id_r").alias("__r"))
           .join(left.select(*lcols), F.col("__l") == F.col(id_col + "_l"))
           .join(right.select(*rcols), F.col("__r") == F.col(id_col + "_r"))
           .select(*[c + "_l" for c in left.columns], *[c + "_r" for c in right.columns]))
    if distinct:
        out = out.distinct()
    return out.orderBy(id_col + "_r")


@dataclass
class Applied:
    """A learned model bound to the columns of an input."""
    cols: list
    jfs: list                # the join functions its configs name
    blocker: object
    weights: list
    thresholds: dict         # {function: ascending thresholds}
    configs: list            # [(function's number, threshold's number)] in the model's order


def _bind(model: FuzzyJoinModel, cols: list, blocker=None, custom_jfs=None) -> Applied:
    custom = {**model.custom, **{j.name: j for j in (custom_jfs or [])}}
    ts: dict[str, set] = {}
    for jf, t in model.configs:
        ts.setdefault(jf, set()).add(round(float(t), P.DIGITS))
    ts_map = {k: sorted(v) for k, v in ts.items()}
    order = sorted(ts_map)
    cfg = [(order.index(jf), ts_map[jf].index(round(float(t), P.DIGITS))) for jf, t in model.configs]
    return Applied(cols, [custom.get(n) or from_name(n) for n in ts],
                   blocker or model.fitted_blocker() or B.TokenBlocker(stem=model.params.get("stem", True)),
                   [float((model.column_weights or {}).get(c, 0.0)) for c in cols], ts_map, cfg)


def hold(model: FuzzyJoinModel, left: DataFrame, id_col: str, path: str | None = None, on=None,
         left_aug: DataFrame | None = None, blocker=None, custom_jfs=None, buckets: int | None = None) -> RF.HeldReference:
    """All that predictions of a learned model need of L, as tables under
    ``path`` (a new folder in the checkpoint folder by default).

    Pass the result to ``predict`` in place of L; ``RF.HeldReference.load``
    reads it in another session.  ``buckets`` is the number of buckets of its
    tables, the session's shuffle partitions by default."""
    if not model.configs:
        raise ValueError("a model without configs joins nothing; there is no state of L to hold")
    left = augment(left, left_aug)
    cols = join_columns(left, left, id_col, on or model.params.get("on"))
    m = _bind(model, cols, blocker, custom_jfs)
    path = path or f"{checkpoint_dir(left.sparkSession)}/held-{uuid.uuid4().hex}"
    return RF.build(path, left, id_col, cols, m.jfs, m.blocker, model.params.get("stem", True), m.weights, m.thresholds,
                    model.rules, model.params.get("null_fill"), buckets)


def _predict_held(model: FuzzyJoinModel, held: RF.HeldReference, right: DataFrame, id_col: str, blocker=None,
                  checkpoint: bool = True, custom_jfs=None) -> DataFrame:
    """``predict_matches`` against a held L: blocking, rules, profiles and distances of R's records only."""
    m = _bind(model, held.meta["on"], blocker, custom_jfs)
    if id_col != held.meta["id_column"] or m.weights != held.meta["weights"] or m.thresholds != held.meta["thresholds"]:
        raise ValueError("the reference is held for another model or id column")
    lr, rsets = held.block(m.blocker, right)
    lr = _cut(NR.apply(lr, held.records.select("id", "toks"), rsets, held.rules), checkpoint)
    ps = PairSpace(None, right, id_col, m.cols, m.jfs, held.meta["stem"], held=held)
    wide = _cut(ps.pair_distances(None, lr, null_fill=held.meta["null_fill"]), checkpoint)
    ps.unpersist()
    near = P.nearest(P.weighted(to_long(wide, ps), len(m.cols), m.weights))
    thr = P.threshold_table(right.sparkSession, m.thresholds)
    g = G.materialize_G(P.per_r(P.local_precision(near, held.balls, thr)), checkpoint, len(m.thresholds),
                        max(map(len, m.thresholds.values())))
    return G.resolve_matches(g, m.configs)


def predict_matches(model: FuzzyJoinModel, left: DataFrame | RF.HeldReference, right: DataFrame, id_col: str,
                    on=None, blocker=None, checkpoint: bool = True, custom_jfs=None) -> DataFrame:
    """Apply a learned UOC with its absolute thresholds: ``(id_l, id_r, p)``."""
    if isinstance(left, RF.HeldReference):
        return _predict_held(model, left, right, id_col, blocker, checkpoint, custom_jfs)
    cols = join_columns(left, right, id_col, on or model.params.get("on"))
    m = _bind(model, cols, blocker, custom_jfs)
    prep = prepare(left, right, id_col, cols, m.jfs, m.blocker, model.rules, model.params.get("stem", True), checkpoint,
                   model.params.get("null_fill"))
    Gdf, _ = _build_G(left.sparkSession, P.weighted(prep.long, len(cols), m.weights), m.thresholds, checkpoint)
    return G.resolve_matches(Gdf, m.configs)


def predict(model: FuzzyJoinModel, left: DataFrame | RF.HeldReference, right: DataFrame, id_col: str, on=None,
            left_aug: DataFrame | None = None, blocker=None, checkpoint: bool = True,
            custom_jfs=None) -> DataFrame:
    """Matched rows of a learned model.

    ``left`` is L, or the state of L that ``hold`` keeps; with the latter
    ``on`` and ``left_aug`` are those it was built with."""
    held = isinstance(left, RF.HeldReference)
    rows = left.rows if held else augment(left, left_aug)
    if not model.configs:
        return empty_result(rows, right)
    m = predict_matches(model, left if held else rows, right, id_col, on, blocker, checkpoint, custom_jfs)
    return materialize(m, rows, right, id_col, distinct=True)


def fuzzy_join(left, right, id_col, on=None, **kw) -> DataFrame:
    """Learn and run the join in one call; returns the matched rows."""
    return fit(left, right, id_col, on, **kw)[1]
