"""Precision estimation from L's own density.

For a join function, r's nearest l (the *proxy*) is a correct match with
probability 1 / (1 + #L records within 2·t of the proxy): an L record
crowded by near twins is an unreliable match.  All thresholds are handled
in one pass by bucketing each LL distance by the first threshold whose
ball contains it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 9


def linspace(n: int) -> list[float]:
    return [float(x) for x in np.linspace(0, 1, n)]


def weighted(long: DataFrame, ncols: int, weights) -> DataFrame:
    """``(side, id_l, id_r, jf, d)`` with d = Σ w_c·d_c (rounded)."""
    if isinstance(weights, dict):
        raise TypeError("pass weights as a list aligned with the columns")
    expr = F.lit(0.0)
    for ci in range(ncols):
        w = float(weights[ci]) if ci < len(weights) else 0.0
        if w != 0.0:
            expr = expr + F.lit(w) * F.col(f"d_{ci}")
    return long.select("side", "id_l", "id_r", "jf", F.round(expr, DIGITS).alias("d"))


def weighted_all(long: DataFrame, ncols: int, weights: list[list[float]]) -> DataFrame:
    """``weighted`` for several weight vectors at once: jf is ``w|jf``, w the number of the vector."""
    ds = []
    for w in weights:
        expr = F.lit(0.0)
        for ci in range(ncols):
            if ci < len(w) and float(w[ci]) != 0.0:
                expr = expr + F.lit(float(w[ci])) * F.col(f"d_{ci}")
        ds.append(F.round(expr, DIGITS))
    return (long.select("side", "id_l", "id_r", "jf", F.posexplode(F.array(*ds)).alias("w", "d"))
            .select("side", "id_l", "id_r", F.concat_ws("|", F.col("w").cast("string"), "jf").alias("jf"), "d"))


def nearest(dist: DataFrame) -> DataFrame:
    """Nearest l per (jf, r) among LR pairs; ties → smallest id_l."""
    lr = dist.where(F.col("side") == "LR")
    best = lr.groupBy("jf", "id_r").agg(F.min(F.struct("d", "id_l")).alias("b"))
    return best.select("jf", "id_r", F.col("b.id_l").alias("id_l"), F.col("b.d").alias("d"))


def threshold_grid(near: DataFrame, grid: list[float]) -> dict[str, list[float]]:
    """Per jf: u·(max−min)+min over the nearest distances, u in ``grid``
    (distinct, ascending).  One row per jf reaches the driver."""
    rows = near.groupBy("jf").agg(F.min("d").alias("mn"), F.max("d").alias("mx")).collect()
    out = {}
    for r in rows:
        ts = {round(u * (r["mx"] - r["mn"]) + r["mn"], DIGITS) for u in grid}
        out[r["jf"]] = sorted(ts)
    return out


def threshold_table(spark: SparkSession, ts: dict[str, list[float]]) -> DataFrame:
    """``(jf, j, ts)``: j = rank of jf in name order (the config order)."""
    names = sorted(ts)
    schema = T.StructType([T.StructField("jf", T.StringType()), T.StructField("j", T.IntegerType()),
                           T.StructField("ts", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame([(n, i, [float(x) for x in ts[n]]) for i, n in enumerate(names)], schema)


def ball_counts(dist: DataFrame, near: DataFrame | None, thr: DataFrame) -> DataFrame:
    """``(jf, proxy, cum)``: cum[i] = #LL neighbours of proxy with d ≤ 2·ts[i].

    Counted for the proxies of ``near``, or for all of L without it."""
    ll = dist.where(F.col("side") == "LL").select("jf", F.col("id_r").alias("proxy"), "d")
    if near is not None:
        ll = ll.join(near.select("jf", F.col("id_l").alias("proxy")).distinct(), ["jf", "proxy"], "left_semi")
    # doubled and rounded once a function, not once a pair
    ll = ll.join(F.broadcast(thr.withColumn("radii", F.transform("ts", lambda t: F.round(2 * t, DIGITS)))), "jf")
    bucket = F.size(F.filter("radii", lambda t: t < F.col("d")))
    hist = (ll.select("jf", "proxy", F.size("ts").alias("nt"), bucket.alias("b"))
            .groupBy("jf", "proxy", "nt", "b").agg(F.count(F.lit(1)).alias("cnt"))
            .groupBy("jf", "proxy", "nt").agg(F.collect_list(F.struct("b", "cnt")).alias("h")))
    cum = F.transform(F.sequence(F.lit(0), F.col("nt") - 1),
                      lambda i: F.aggregate(F.filter("h", lambda x: x["b"] <= i),
                                            F.lit(0).cast("long"), lambda a, x: a + x["cnt"]))
    return hist.select("jf", "proxy", cum.alias("cum"))


def local_precision(near: DataFrame, balls: DataFrame, thr: DataFrame, *more: str) -> DataFrame:
    """``(jf, j, id_r, id_l, d, ps)`` and the columns ``more`` of thr; ps[i] = 1/(1+cum[i]) when d ≤ ts[i]."""
    m = (near.join(F.broadcast(thr), "jf")
         .join(balls.withColumnRenamed("proxy", "id_l"), ["jf", "id_l"], "left"))
    ps = F.transform("ts", lambda t, i: F.when(
        F.col("d") <= t,
        1.0 / (1.0 + F.coalesce(F.try_element_at("cum", i + 1), F.lit(0)))).cast("double"))
    return m.select(*more, "jf", "j", "id_r", "id_l", "d", ps.alias("ps"))


def per_r(m: DataFrame, *more: str) -> DataFrame:
    """One row per r (and ``more``): ``m: map<j, struct<l, ps>>`` (at most |JF| entries)."""
    return m.groupBy(*more, "id_r").agg(F.map_from_entries(F.collect_list(
        F.struct("j", F.struct(F.col("id_l").alias("l"), "ps")))).alias("m"))
