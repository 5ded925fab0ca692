"""Splits, k-fold, cross-validation, curves and grid search.

Row order comes from a seeded md5 key, so a split is stable under any
re-partitioning and reproducible in SQL.  Positions are assigned by
``global_index`` (range partitioning + per-partition counts) — never by a
single-partition window.
"""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.operators import evaluate as E
from fuzzyspark.operators import model as M
from fuzzyspark.session import scratch
from fuzzyspark.sources import io as IO


def order_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def global_index(df: DataFrame, keys: list[str], n_parts: int | None = None) -> DataFrame:
    """0-based position of every row in ``keys`` order, computed in parallel."""
    spark = df.sparkSession
    n_parts = n_parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = (df.repartitionByRange(n_parts, *keys).withColumn("_pid", F.spark_partition_id())
              .persist(StorageLevel.MEMORY_AND_DISK))
    counts = sorted((r["_pid"], r["n"]) for r in parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offs, acc = [], 0
    for pid, n in counts:
        offs.append((pid, acc))
        acc += n
    off = spark.createDataFrame(offs or [(0, 0)], "_pid int, _off long")
    w = Window.partitionBy("_pid").orderBy(*keys)
    return (parted.join(F.broadcast(off), "_pid")
            .withColumn("_idx", F.col("_off") + F.row_number().over(w) - 1)
            .drop("_pid", "_off"))


def _indexed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    keyed = df.withColumn("_key", order_key(id_col, seed))
    return global_index(keyed, ["_key", id_col])


def split_assignment(left, right, id_col, train_size=0.75, seed=0) -> DataFrame:
    """``(side, id, part)``; train = first ⌊train_size·n⌋ rows in key order.
    ``train_size == 1`` puts every row in both parts."""
    out = []
    for side, df in (("L", left), ("R", right)):
        n = df.count()
        ix = _indexed(df.select(id_col), id_col, seed)
        if train_size >= 1:
            part = F.explode(F.array(F.lit("train"), F.lit("test")))
        else:
            part = F.when(F.col("_idx") < int(train_size * n), "train").otherwise("test")
        out.append(ix.select(F.lit(side).alias("side"), F.col(id_col).alias("id"), part.alias("part")))
    return out[0].unionByName(out[1])


def fold_of(idx: F.Column, n: int, k: int) -> F.Column:
    """Fold of position idx when n rows are cut in k nearly equal folds
    (the first n mod k folds one row longer)."""
    q, r = divmod(n, k)
    big = r * (q + 1)
    return F.when(idx < big, (idx / F.lit(max(q + 1, 1))).cast("int")).otherwise(
        (F.lit(r) + ((idx - big) / F.lit(max(q, 1))).cast("int")))


def fold_assignment(left, right, id_col, n_splits=5, seed=0) -> DataFrame:
    out = []
    for side, df in (("L", left), ("R", right)):
        n = df.count()
        ix = _indexed(df.select(id_col), id_col, seed)
        out.append(ix.select(F.lit(side).alias("side"), F.col(id_col).alias("id"),
                             fold_of(F.col("_idx"), n, n_splits).alias("fold")))
    return out[0].unionByName(out[1])


def head_fraction(df: DataFrame, id_col: str, q: float, seed=0) -> DataFrame:
    """First ⌊q·n⌋ rows in seeded key order."""
    n = df.count()
    ix = _indexed(df, id_col, seed)
    return ix.where(F.col("_idx") < int(q * n)).drop("_key", "_idx")


def restrict_gt(gt: DataFrame, lids: DataFrame, rids: DataFrame, id_col: str = "id") -> DataFrame:
    """Ground-truth pairs whose l is in ``lids`` and r in ``rids``."""
    return (gt.join(lids.select(F.col(id_col).alias("id_l")), "id_l", "left_semi")
            .join(rids.select(F.col(id_col).alias("id_r")), "id_r", "left_semi"))


def train_test_split(left, right, gt, id_col, train_size=0.75, seed=0, stable_left=False):
    a = split_assignment(left, right, id_col, train_size, seed).persist()
    def part(side, p, df):
        ids = a.where((F.col("side") == side) & (F.col("part") == p)).select(F.col("id").alias(id_col))
        return df.join(ids, id_col, "left_semi")
    ltr = left if stable_left else part("L", "train", left)
    lte = left if stable_left else part("L", "test", left)
    rtr, rte = part("R", "train", right), part("R", "test", right)
    return ((ltr, rtr), restrict_gt(gt, ltr, rtr, id_col)), ((lte, rte), restrict_gt(gt, lte, rte, id_col))


def kfold(left, right, gt, id_col, n_splits=5, seed=0, stable_left=False):
    """Yield ((L_train, R_train), gt_train), ((L_test, R_test), gt_test) per fold."""
    a = fold_assignment(left, right, id_col, n_splits, seed).persist()
    for k in range(n_splits):
        def part(side, test, df):
            cond = (F.col("fold") == k) if test else (F.col("fold") != k)
            ids = a.where((F.col("side") == side) & cond).select(F.col("id").alias(id_col))
            return df.join(ids, id_col, "left_semi")
        ltr = left if stable_left else part("L", False, left)
        lte = left if stable_left else part("L", True, left)
        rtr, rte = part("R", False, right), part("R", True, right)
        yield ((ltr, rtr), restrict_gt(gt, ltr, rtr, id_col)), ((lte, rte), restrict_gt(gt, lte, rte, id_col))


def _fit_score(train, test, id_col, fit_kw, label):
    (ltr, rtr), gtr = train
    (lte, rte), gte = test
    with scratch():
        model, res = M.fit(ltr, rtr, id_col, **fit_kw)
        tr = E.evaluate(gtr, res.select(F.col(id_col + "_l").alias("id_l"), F.col(id_col + "_r").alias("id_r")))
        pred = M.predict(model, lte, rte, id_col)
        te = E.evaluate(gte, pred.select(F.col(id_col + "_l").alias("id_l"), F.col(id_col + "_r").alias("id_r")))
    row = {"run": label, "precision_est": model.precision_est}
    row.update({f"{k}_train": v for k, v in tr.items()})
    row.update({f"{k}_test": v for k, v in te.items()})
    return row


def _rows_df(spark, rows):
    keys = sorted({k for r in rows for k in r})
    data = [tuple(None if r.get(k) is None else (str(r[k]) if k == "run" else float(r[k])) for k in keys)
            for r in rows]
    schema = ", ".join(f"`{k}` {'string' if k == 'run' else 'double'}" for k in keys)
    return spark.createDataFrame(data, schema)


def train_score(left, right, gt, id_col, out_dir, train_size=0.75, seed=0, stable_left=True, **fit_kw) -> DataFrame:
    """The train-and-score job: fit on the train part, score both parts, and write to ``out_dir`` the
    model (``model/``), the learned weights and configs, the predictions of the test part with their
    true and false positives and false negatives, and one summary row, which is also returned.

    A score without a denominator is null; a target that no config meets gives no predictions."""
    spark = left.sparkSession
    train, test = train_test_split(left, right, gt, id_col, train_size, seed, stable_left)
    (ltr, rtr), gtr = train
    (lte, rte), gte = test
    pairs = lambda df: df.select(F.col(id_col + "_l").alias("id_l"), F.col(id_col + "_r").alias("id_r"))
    model, res = M.fit(ltr, rtr, id_col, **fit_kw)
    model.save(spark, f"{out_dir}/model")
    IO.write_learned(spark, out_dir, model)
    pred = M.predict(model, lte, rte, id_col)
    made = pairs(pred)
    IO.write_predictions(out_dir, pred, *E.tp_fp_fn(gte, made))
    row = {"n_configs": float(len(model.configs or [])), "precision_est": model.precision_est, "train_size": float(train_size)}
    for part, truth, found in (("train", gtr, pairs(res)), ("test", gte, spark.read.parquet(f"{out_dir}/pred").transform(pairs))):
        row.update({f"{k}_{part}": v for k, v in E.metrics(truth, found).first().asDict().items()})
    IO.write_summary(spark, out_dir, row)
    return _rows_df(spark, [row])


def cross_validate(left, right, gt, id_col, n_splits=5, seed=0, stable_left=False, **fit_kw) -> DataFrame:
    """Per fold: fit on the other folds, score on train and on the held-out fold."""
    rows = [_fit_score(tr, te, id_col, fit_kw, f"fold{k}")
            for k, (tr, te) in enumerate(kfold(left, right, gt, id_col, n_splits, seed, stable_left))]
    return _rows_df(left.sparkSession, rows)


def learning_curve(left, right, gt, id_col, sizes=(0.25, 0.5, 0.75, 1.0), seed=0, **fit_kw) -> DataFrame:
    rows = []
    for s in sizes:
        tr, te = train_test_split(left, right, gt, id_col, s, seed, stable_left=True)
        rows.append(_fit_score(tr, te, id_col, fit_kw, f"size{s}"))
    return _rows_df(left.sparkSession, rows)


def augment_curve(left, right, gt, left_aug, id_col, rates=(0.0, 0.7, 1.0), seed=0, **fit_kw) -> DataFrame:
    rows = []
    for q in rates:
        aug = head_fraction(left_aug, id_col, q, seed) if q > 0 else None
        with scratch():
            model, res = M.fit(left, right, id_col, left_aug=aug, **fit_kw)
            sc = E.evaluate(gt, res.select(F.col(id_col + "_l").alias("id_l"), F.col(id_col + "_r").alias("id_r")))
        rows.append({"run": f"aug{q}", **sc, "precision_est": model.precision_est})
    return _rows_df(left.sparkSession, rows)


def blocker_compare(left, right, gt, id_col, blockers: dict, **fit_kw) -> DataFrame:
    rows = []
    for name, b in blockers.items():
        with scratch():
            model, res = M.fit(left, right, id_col, blocker=b, **fit_kw)
            sc = E.evaluate(gt, res.select(F.col(id_col + "_l").alias("id_l"), F.col(id_col + "_r").alias("id_r")))
        rows.append({"run": name, **sc, "precision_est": model.precision_est})
    return _rows_df(left.sparkSession, rows)


def grid_search(left, right, gt, id_col, param_grid: dict, n_splits=3, seed=0,
                score="f1.0-score", stable_left=False) -> tuple[DataFrame, dict, M.FuzzyJoinModel | None]:
    """Mean held-out score of every parameter combination over k folds;
    returns (results, best parameters, model fitted with them on all rows).
    An undefined score counts as 0; the first of equal combinations is best."""
    keys = sorted(param_grid)
    rows, best, best_score = [], None, float("-inf")
    for combo in itertools.product(*[param_grid[k] for k in keys]):
        params = dict(zip(keys, combo))
        scores = []
        for tr, te in kfold(left, right, gt, id_col, n_splits, seed, stable_left):
            s = _fit_score(tr, te, id_col, params, "cv").get(f"{score}_test")
            scores.append(s if s is not None and s == s else 0.0)
        mean = sum(scores) / len(scores)
        rows.append({"run": str(params), "mean_score": mean})
        if mean > best_score:
            best, best_score = params, mean
    model = M.fit(left, right, id_col, **best)[0] if best is not None else None
    return _rows_df(left.sparkSession, rows), best, model
