"""Distance functions as Spark column expressions.

Set-based distances read two token *profiles* (one per record, built once
per preprocess/tokenize/weight group by :mod:`fuzzyspark.operators.pairs`):

    struct<tk: array<code>, dup: map<code, count > 1>, n: int, s: double, nrm: double>

so that every pair needs only one pass over the left record's tokens.  A code
is the number of a token of L and, in its low bits, the number of L records
that hold it, which give its weight.  Tokens that L lacks have no code: they
count in n, s and nrm and meet nothing.
Let I = Σ w over X∩Y, sx, sy = Σ w over X, Y, U = sx + sy − I, ε = 1e-9.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9
DIST_DIGITS = 9


DF_BITS = 31


def token_code(number: Column, df: Column) -> Column:
    """One bigint of a token's number and the number of L records that hold it."""
    return F.shiftleft(number.cast("long"), DF_BITS).bitwiseOR(df.cast("long"))


def idf_weight(code: Column, n_left: int) -> Column:
    return F.log(F.lit(float(n_left)) / (code.bitwiseAND(F.lit((1 << DF_BITS) - 1)) + 1))


def pair_stats(pl: Column, pr: Column, with_dot: bool = True, n_left: int | None = None) -> Column:
    """struct(ni, I, dot) for two profiles: one hash intersection of the
    token codes, then sums over the shared tokens only.  Tokens weigh by idf
    among ``n_left`` records of L, or 1 without it.

    The shared codes and their weights are bound to lambda variables, so each
    is evaluated once a pair, however often it is named."""
    w = lambda x: F.lit(1.0) if n_left is None else idf_weight(x, n_left)
    once = lambda c, f: F.transform(F.array(c), f)[0]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    cnt = lambda p, x: F.coalesce(F.try_element_at(p["dup"], x), F.lit(1))

    def dot(codes: Column, ws: Column) -> Column:
        if not with_dot:
            return F.lit(0.0)
        single = (F.size(pl["dup"]) == 0) & (F.size(pr["dup"]) == 0)
        counted = F.zip_with(codes, ws, lambda x, v: v * v * cnt(pl, x) * cnt(pr, x))
        return F.when(single, F.aggregate(ws, F.lit(0.0), lambda a, v: a + v * v)).otherwise(total(counted))

    return once(F.array_intersect(pl["tk"], pr["tk"]), lambda codes: once(F.transform(codes, w), lambda ws: F.struct(
        F.size(codes).alias("ni"), total(ws).alias("I"), dot(codes, ws).alias("dot"))))


def set_distance(name: str, pl: Column, pr: Column, st: Column) -> Column:
    """Distance ``name`` from profiles ``pl``, ``pr`` and their pair stats."""
    i_, dot = st["I"], st["dot"]
    u = pl["s"] + pr["s"] - i_
    jac = 1 - i_ / (u + EPS)
    cos = 1 - dot / (pl["nrm"] * pr["nrm"] + EPS)
    dice = 1 - 2 * i_ / (i_ + u + EPS)
    contain = st["ni"] == F.least(pl["n"], pr["n"])
    table = {
        "jaccardDistance": jac,
        "cosineDistance": cos,
        "diceDistance": dice,
        "maxincDistance": 1 - i_ / (F.least(pl["s"], pr["s"]) + EPS),
        "intersectDistance": 1 - i_ / (i_ + u + EPS),
        "containJaccardDistance": F.when(contain, jac).otherwise(F.lit(1.0)),
        "containCosineDistance": F.when(contain, cos).otherwise(F.lit(1.0)),
        "containDiceDistance": F.when(contain, dice).otherwise(F.lit(1.0)),
    }
    d = table[name]
    empty = pl.isNull() | pr.isNull()
    return F.when(empty, F.lit(None).cast("double")).otherwise(d.cast("double"))


def _code_points(values: list[str], pad: int, width: int) -> np.ndarray:
    """One row of code points a value, filled with ``pad``."""
    out = np.full((len(values), width), pad, np.int64)
    for row, v in zip(out, values):
        row[:len(v)] = np.frombuffer(v.encode("utf-32-le"), np.uint32)
    return out


def jaro_winkler_similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity with the Winkler prefix boost (p = 0.1, up to 4
    characters, only when the Jaro similarity exceeds 0.7) of each pair.

    All pairs advance together, one position of the left value a step; an
    empty value has similarity 0."""
    n1, n2 = (np.array([len(v) for v in side], np.int64) for side in (left, right))
    a, b = _code_points(left, -1, int(n1.max(initial=0))), _code_points(right, -2, int(n2.max(initial=0)))
    k, width = len(left), b.shape[1]
    if k == 0 or a.shape[1] == 0 or width == 0:
        return np.zeros(k)
    reach = np.maximum(np.maximum(n1, n2) // 2 - 1, 0)
    rows = np.arange(k)
    met_a, met_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    at = np.arange(width)
    for i in range(a.shape[1]):
        free = (b == a[:, i:i + 1]) & ~met_b & (np.abs(at - i) <= reach[:, None])
        first = free.argmax(1)
        hit = free[rows, first]
        met_a[:, i] = hit
        met_b[rows[hit], first[hit]] = True
    m = met_a.sum(1)
    # the matched characters of both sides, in their orders, stand side by side in a flat list
    moved = np.bincount(np.nonzero(met_a)[0], weights=a[met_a] != b[met_b], minlength=k).astype(np.int64) // 2
    some = np.maximum(m, 1)
    sim = np.where(m > 0, (m / np.maximum(n1, 1) + m / np.maximum(n2, 1) + (m - moved) / some) / 3.0, 0.0)
    head = min(4, a.shape[1], width)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(1)
    return np.where(sim > 0.7, sim + prefix * 0.1 * (1.0 - sim), sim)


# cells (pairs times the longest value) compared at once by the Jaro-Winkler UDF
JARO_CELLS = 1 << 20


def _runs(lengths, cells: int = JARO_CELLS) -> list[int]:
    """Starts of the runs of descending lengths whose rows, each as wide as
    the first of its run, hold at most ``cells``; one longer than that is alone."""
    starts, width = [], 0
    for i, n in enumerate(lengths):
        if not starts or (i - starts[-1] + 1) * width > cells:
            starts.append(i)
            width = max(n, 1)
    return starts


@F.pandas_udf(T.DoubleType())
def _jaro_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"a": a.array, "b": b.array})
    known = pairs.dropna().drop_duplicates()  # each pair of values is compared once in a batch
    known = known.assign(n=np.maximum(known["a"].str.len(), known["b"].str.len()).astype("int64"), d=1.0)
    known = known.sort_values("n", ascending=False, kind="stable")
    starts = _runs(known["n"].tolist())
    for lo, hi in zip(starts, starts[1:] + [len(known)]):
        part = known.iloc[lo:hi]
        known.iloc[lo:hi, known.columns.get_loc("d")] = 1.0 - jaro_winkler_similarities(part["a"].tolist(), part["b"].tolist())
    return pairs.merge(known, on=["a", "b"], how="left")["d"]


def jaro_distance(sl: Column, sr: Column) -> Column:
    """1 − Jaro-Winkler similarity; null when either string is empty."""
    return F.when((F.length(sl) == 0) | (F.length(sr) == 0), F.lit(None).cast("double")) \
        .otherwise(_jaro_distance_udf(sl, sr))


def edit_distance(sl: Column, sr: Column) -> Column:
    """Raw Levenshtein count; null when either string is empty."""
    return F.when((F.length(sl) == 0) | (F.length(sr) == 0), F.lit(None).cast("double")) \
        .otherwise(F.levenshtein(sl, sr).cast("double"))


def char_distance(name: str, sl: Column, sr: Column) -> Column:
    if name == "editDistance":
        return edit_distance(sl, sr)
    if name == "jaroDistance":
        return jaro_distance(sl, sr)
    raise ValueError(f"{name} is an invalid distance function")


# ---- typed / vector distances -------------------------------------------

def _char_cosine(x: Column, y: Column) -> Column:
    """Cosine distance over character multisets of two strings."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    times = lambda cs, c: F.size(F.filter(cs, lambda z: z == c))
    dots = lambda xs, ys: F.aggregate(F.array_distinct(xs), F.lit(0.0),
                                      lambda a, c: a + times(xs, c) * times(ys, c))
    cx, cy = chars(x), chars(y)
    return 1 - dots(cx, cy) / (F.sqrt(dots(cx, cx)) * F.sqrt(dots(cy, cy)) + EPS)


def _date_parts(ts: Column) -> Column:
    return F.array_distinct(F.array(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts),
        (F.dayofweek(ts) + 5) % 7, F.dayofyear(ts), F.lit(-1)))


def typed_distance(x: Column, y: Column) -> Column:
    """Typed distance of two string values.

    Both parse as ISO-like timestamps → Jaccard distance of the date-part
    sets (year, month, day, hour, minute, second, weekday, yearday, −1);
    otherwise cosine distance over characters.
    """
    tx, ty = F.try_to_timestamp(x), F.try_to_timestamp(y)
    px, py = _date_parts(tx), _date_parts(ty)
    jac = 1 - F.size(F.array_intersect(px, py)) / (F.size(F.array_union(px, py)) + EPS)
    return F.when(tx.isNotNull() & ty.isNotNull(), jac).otherwise(_char_cosine(x, y))


def typed_equal_distance(x: Column, y: Column) -> Column:
    """Integer / boolean columns: 0 when equal, else 1."""
    return F.when(x == y, F.lit(0.0)).otherwise(F.lit(1.0))


def embed_cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    return 1 - dot / (na * nb)


def embed_l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda s, v: s + v))


def weighted_distance(dcols: dict[str, Column], weights: dict[str, float]) -> Column:
    """Σ w_c · d_c over join columns; a column without weight counts 0."""
    expr = F.lit(0.0)
    for c, d in dcols.items():
        expr = expr + F.lit(float(weights.get(c, 0.0))) * d
    return expr
