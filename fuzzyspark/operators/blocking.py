"""Candidate generation: top-k token blocking of R (queries) against L.

Plan shape (per blocker call):

* L postings ``(token, id_l, weight)`` from one explode + two aggregations;
* L's records and the distinct values of R are dealt over a grid of cells
  (row by a hash of ``id_l``, column by a hash of ``id_r``), each record with
  its whole list of tokens, so one cell holds all shared tokens of its pairs;
* a cell sums the weights of its pairs in runs of bounded size and sends on
  only the pairs that can be among the k best of their r (``pair_sums``), so
  neither the matches of tokens nor the pairs are shuffled;
* ``rank() <= k`` per ``id_r`` over what the cells sent.

Nothing is collected except the row count of L (to pick ``k``), the sizes
that set the grid and the size of the hot-token list before it is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.functions.text import block_normalize, block_tokens, split_by_space
from fuzzyspark.session import dealt

SCORE_DIGITS = 10
# Token posting lists longer than this are split over several join tasks.
SALT_ROWS = 200_000
# Hot-token tables up to this many rows are broadcast to the R side.
HOT_BROADCAST_ROWS = 1_000_000
# Records and tokens of each side in a cell of the pair grid, and pairs or matches summed at once in it.
CELL_LEFT, CELL_RIGHT, CELL_TOKENS = 131_072, 32_768, 8_000_000
RUN = 1 << 20
# Tokens held by more than 1 / HOT_SHARE of a cell's L records are summed as a matrix, up to HOT_BYTES of it.
HOT_SHARE, HOT_BYTES = 8, 1 << 25
# Rows and columns of the grid that small inputs are cut in, of at least SPREAD_LEAST records, so that they use all cores.
SPREAD_LEFT, SPREAD_RIGHT, SPREAD_LEAST = 1, 6, 512
# Tokens of a block, in which the records of a row or column of the grid travel together.
BLOCK_TOKENS = 1 << 20


class Blocker(Protocol):
    """Pluggable blocker: returns candidate pairs ``(id_l, id_r)``."""

    def block(self, left: DataFrame, right: DataFrame, id_col: str,
              cols: list[str]) -> DataFrame: ...


def default_k(n_left: int, cap: int = 50) -> int:
    return min(math.isqrt(n_left), cap)


def normalize_records(df: DataFrame, id_col: str, cols: list[str],
                      stem: bool = True) -> DataFrame:
    """``(id, value)`` with the blocking normaliser applied to ``cols``."""
    return df.select(F.col(id_col).alias("id"),
                     block_normalize(cols, stem=stem).alias("value"))


def left_postings(lnorm: DataFrame, n_left: int, weighting: str = "tfidf",
                  k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Postings ``(token, id_l, w, df)`` of the non-blank L records.

    ``tfidf``: w = count/len · ln(N/(df+1)).
    ``bm25``: published BM25 on raw counts with idf ln((N-n+.5)/(n+.5)+1),
    n = df+1.  ``bm25_compat``: (k1+1) + k1·(1-b+b·len/avg) times the same
    idf (the term frequency cancels in that form).

    ``tfidf`` gives both factors too, ``tf`` and ``idf``: the many different
    weights are products of few, and an ``idf`` belongs to its token.
    """
    # dealt out by id before the tokens are made, which then stay where they are
    toks = (dealt(lnorm.where(F.length("value") > 0), "id")
            .select(F.col("id").alias("id_l"), block_tokens("value").alias("toks"))
            .select("id_l", F.size("toks").alias("len"), F.explode("toks").alias("token")))
    tf = toks.groupBy("id_l", "token", "len").agg(F.count(F.lit(1)).alias("cnt"))
    df_tok = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).persist(StorageLevel.MEMORY_AND_DISK)
    if df_tok.count() <= HOT_BROADCAST_ROWS:
        df_tok = F.broadcast(df_tok)
    p = tf.join(df_tok, "token")
    n = F.lit(float(n_left))
    factors = []
    if weighting == "tfidf":
        share, idf = F.col("cnt") / F.col("len"), F.log(n / (F.col("df") + 1))
        w, factors = share * idf, [share.alias("tf"), idf.alias("idf")]
    else:
        nq = F.col("df") + 1
        idf = F.log((n - nq + 0.5) / (nq + 0.5) + 1)
        avg_len = tf.select("id_l", "len").distinct().agg(F.avg("len")).first()[0] or 1.0
        norm = F.lit(k1) * (1 - b + b * F.col("len") / F.lit(float(avg_len)))
        if weighting == "bm25":
            w = idf * F.col("cnt") * (k1 + 1) / (F.col("cnt") + norm)
        elif weighting == "bm25_compat":
            w = idf * (F.lit(k1 + 1) + norm)
        else:
            raise ValueError(weighting)
    return p.select("token", "id_l", w.alias("w"), "df", *factors)


def postings_of(post: DataFrame, rnorm: DataFrame) -> DataFrame:
    """The postings of the tokens that R holds.

    R's distinct tokens are counted first and broadcast up to
    ``HOT_BROADCAST_ROWS``; beyond it the join of the blocker finds them."""
    tokens = right_tokens(rnorm).select("token").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    if tokens.count() > HOT_BROADCAST_ROWS:
        tokens.unpersist()
        return post
    return post.join(F.broadcast(tokens), "token", "left_semi")


def right_tokens(rnorm: DataFrame) -> DataFrame:
    """Distinct blocking tokens of every R record ``(id_r, token)``."""
    return dealt(rnorm, "id").select(F.col("id").alias("id_r"),
                                     F.explode(F.array_distinct(block_tokens("value"))).alias("token"))


def _grid(post: DataFrame, rtok: DataFrame, salt_rows: int) -> tuple[int, int]:
    """Rows (blocks of L) and columns (blocks of R) of the pair grid."""
    size = lambda df, c: df.agg(F.approx_count_distinct(c, 0.02), F.count(F.lit(1))).first()
    (n_l, t_l), (n_r, t_r) = size(post, "id_l"), size(rtok, "id_r")
    cut = lambda n, t, cell, spread: max(math.ceil(n / min(cell, salt_rows)), math.ceil(t / CELL_TOKENS),
                                         min(spread, n // SPREAD_LEAST), 1)
    return cut(n_l, t_l, CELL_LEFT, SPREAD_LEFT), cut(n_r, t_r, CELL_RIGHT, SPREAD_RIGHT)


def _match_runs(lists, n_left: int):
    """Sums of a cell by runs of R records: ``(first r, matrix of sums, matrix of counts)``, one row an r.

    ``lists``: tokens and weights of the L records, then of the R records, as (starts, token codes, weights)."""
    (l_at, l_tok, l_w), (r_at, r_tok, r_w) = lists
    order = np.argsort(l_tok, kind="stable")
    holder = np.repeat(np.arange(n_left), np.diff(l_at))[order]
    weight = l_w[order]
    n_tok = int(max(l_tok.max(initial=-1), r_tok.max(initial=-1))) + 1
    first = np.concatenate([[0], np.cumsum(np.bincount(l_tok, minlength=n_tok))])
    found = first[r_tok + 1] - first[r_tok]
    met = np.concatenate([[0], np.cumsum(found)])[r_at]
    lo, n_right = 0, len(r_at) - 1
    while lo < n_right:
        hi = int(np.searchsorted(met, met[lo] + RUN, side="right")) - 1
        hi = max(lo + 1, min(hi, lo + max(1, RUN // n_left), n_right))
        at = slice(r_at[lo], r_at[hi])
        n = found[at]
        ends = np.cumsum(n)
        pos = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[r_tok[at]] - ends + n, n)
        flat = np.repeat(np.repeat(np.arange(hi - lo), np.diff(r_at[lo:hi + 1])), n) * n_left + holder[pos]
        cells = (hi - lo) * n_left
        sums = np.bincount(flat, weight[pos] * np.repeat(r_w[at], n), cells).astype(float).reshape(-1, n_left)
        yield lo, sums, np.bincount(flat, minlength=cells).reshape(-1, n_left)
        lo = hi


def _best_runs(lists, n_left: int, k: int):
    """Pairs of a cell that can be among the k best of an r, ties after rounding included: (l, r, n, w) in runs of R records.

    The weights of frequent tokens, which most matches are of, are multiplied as a matrix; those of the
    others are added to the sums of an r, a token at a time."""
    (l_at, l_tok, l_w), (r_at, r_tok, r_w) = lists
    order = np.argsort(l_tok, kind="stable")
    holder, weight, token = np.repeat(np.arange(n_left), np.diff(l_at))[order], l_w[order], l_tok[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (holder[1:] != holder[:-1])
    if not new.all():  # a token that a record holds twice counts twice
        at = np.flatnonzero(new)
        holder, weight, token = holder[at], np.add.reduceat(weight, at), token[at]
    n_tok = int(max(l_tok.max(initial=-1), r_tok.max(initial=-1))) + 1
    df = np.bincount(token, minlength=n_tok)
    first = np.concatenate([[0], np.cumsum(df)])
    hot = np.flatnonzero(df > n_left // HOT_SHARE)
    hot = hot[np.argsort(-df[hot], kind="stable")][:max(1, HOT_BYTES // (8 * n_left))]
    place = np.full(n_tok, -1)
    place[hot] = np.arange(len(hot))
    dense = np.zeros((len(hot), n_left))
    for row, t in zip(dense, hot):
        row[holder[first[t]:first[t + 1]]] = weight[first[t]:first[t + 1]]
    n_right, step, some = len(r_at) - 1, max(1, RUN // n_left), max(k, n_left // 8)
    times = np.zeros(n_tok, np.int64)
    for lo in range(0, n_right, step):
        hi = min(n_right, lo + step)
        tok, w = r_tok[r_at[lo]:r_at[hi]], r_w[r_at[lo]:r_at[hi]]
        row, col = np.repeat(np.arange(hi - lo), np.diff(r_at[lo:hi + 1])), place[tok]
        asked = np.zeros((hi - lo, len(hot)))
        np.add.at(asked, (row[col >= 0], col[col >= 0]), w[col >= 0])
        sums = asked @ dense
        rare = (col < 0) & (df[tok] > 0)
        of, tok, w = row[rare].tolist(), tok[rare], w[rare].tolist()
        each = list(sums)
        for i, a, b, x in zip(of, first[tok].tolist(), first[tok + 1].tolist(), w):
            each[i][holder[a:b]] += weight[a:b] if x == 1.0 else weight[a:b] * x
        # the k-th best of some L records is no more than that of all
        low = np.partition(sums[:, :some], some - k, axis=1)[:, some - k] - 2 * 10.0 ** -SCORE_DIGITS
        out = []
        for i in range(hi - lo):
            mine = r_tok[r_at[lo + i]:r_at[lo + i + 1]]
            np.add.at(times, mine, 1)
            if low[i] > 0:  # of pairs that share a token, as the sums of others are 0
                l, n = np.flatnonzero(sums[i] >= low[i]), None
            else:
                n = np.bincount(np.repeat(np.arange(n_left), np.diff(l_at)), times[l_tok], n_left).astype(np.int64)
                l = np.flatnonzero(n)
            w_l = sums[i, l]
            if len(l) > k:
                best = w_l >= np.partition(w_l, len(l) - k)[len(l) - k] - 2 * 10.0 ** -SCORE_DIGITS
                l, w_l = l[best], w_l[best]
            if n is None:
                size = l_at[l + 1] - l_at[l]
                starts = np.cumsum(size) - size
                n = np.add.reduceat(times[l_tok[np.arange(int(size.sum())) + np.repeat(l_at[l] - starts, size)]], starts)
            else:
                n = n[l]
            times[mine] = 0
            out.append((l, np.full(len(l), lo + i), n, w_l))
        yield tuple(np.concatenate(x) for x in zip(*out))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records ``(part, id, tokens, ws, idf, least)`` of a task as rows ``(part, block)``.

    A block is a compressed Arrow stream of records of a part, which holds each of their
    tokens and weights once: the copies that go to the cells are a fraction of the records.
    ``idf``, a factor of the weights that each token has, stands once a token in the first record's list."""
    def packed(held):
        table = pa.Table.from_batches(held)
        for part in table["part"].unique().to_pylist():
            rows = table.filter(pc.equal(table["part"], part)).drop_columns("part").combine_chunks()
            token = None
            for i, name in enumerate(rows.column_names):
                lists = rows[name].combine_chunks()
                if name in ("tokens", "ws") and not lists.null_count:
                    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                    coded = lists.flatten().dictionary_encode()
                    token = coded if name == "tokens" else token
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), coded)
                elif name == "idf" and not lists.null_count:
                    of = np.zeros(len(token.dictionary))
                    of[token.indices.to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False)
                    at = np.full(len(rows) + 1, len(of), np.int32)
                    at[0] = 0
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(of))
                rows = rows.set_column(i, name, lists)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["part", "block"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch["tokens"].flatten())
        if n >= BLOCK_TOKENS:
            yield from packed(held)
            held, n = [], 0
    if held:
        yield from packed(held)


def _weighed(block: pa.Table) -> pa.Table:
    """Records ``(id, tokens, ws, least)`` of a block, their weights multiplied by the idf of the tokens."""
    lists = block["ws"].combine_chunks()
    if not lists.null_count:
        ws = lists.flatten().dictionary_decode().to_numpy(zero_copy_only=False)
        if not block["idf"].null_count:
            token = block["tokens"].combine_chunks().flatten().indices.to_numpy(zero_copy_only=False)
            ws = ws * block["idf"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[token]
        lists = pa.ListArray.from_arrays(lists.offsets, pa.array(ws))
        block = block.set_column(block.column_names.index("ws"), "ws", lists)
    return block.drop_columns("idf")


def _cell_pairs(k: int | None):
    """The work on one cell: rows ``(left, block)`` of its records to its pairs ``(id_l, id_r, n, w)``.

    With ``k`` only the pairs that can be among the k best of an r after
    rounding, ties included; where an r has a ``least``, pairs that reach it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {True: [], False: []}
        for batch in batches:
            for left, block in zip(batch["left"].to_pylist(), batch["block"]):
                blocks[left].append(_weighed(pa.ipc.open_stream(block.as_buffer()).read_all()))
        if not (blocks[True] and blocks[False]):
            return
        sides = [pa.concat_tables(blocks[x]) for x in (True, False)]
        flat = [[c.flatten() for c in s["tokens"].chunks] for s in sides]
        codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in pa.chunked_array(flat[0] + flat[1]).unify_dictionaries().chunks]
        lists = []
        for s, c in zip(sides, (np.concatenate(codes[:len(flat[0])]), np.concatenate(codes[len(flat[0]):]))):
            size = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in s["tokens"].chunks])
            ws = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in s["ws"].chunks])
                  if s["ws"].null_count == 0 else np.ones(len(c)))
            lists.append((np.concatenate([[0], np.cumsum(size)]).astype(np.int64), c, ws))
        id_l, id_r = (s["id"].combine_chunks() for s in sides)
        least = sides[1]["least"].to_numpy().astype(float)
        n_left = len(id_l)
        if k is not None and 0 < k < n_left:
            for l, r, n, w in _best_runs(lists, n_left, k):
                reach = ~(w < least[r])
                yield pa.RecordBatch.from_arrays([id_l.take(pa.array(l[reach])), id_r.take(pa.array(r[reach])), pa.array(n[reach]), pa.array(w[reach])],
                                                 ["id_l", "id_r", "n", "w"])
            return
        for lo, sums, counts in _match_runs(lists, n_left):
            hit = counts > 0
            bound = least[lo:lo + len(sums), None]
            hit &= ~(sums < bound)
            r, l = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([id_l.take(pa.array(l)), id_r.take(pa.array(r + lo)), pa.array(counts[hit]), pa.array(sums[hit])],
                                             ["id_l", "id_r", "n", "w"])
    return work


def pair_sums(rtok: DataFrame, post: DataFrame, k: int | None = None, salt_rows: int = SALT_ROWS,
              least: DataFrame | None = None) -> DataFrame:
    """``(id_l, id_r, n, w)``: the number of shared tokens of every pair that shares any, and the sum of their weights.

    The weights are the column ``w`` of the postings (``tf`` times ``idf`` where
    they have these, an idf being the same for all records of a token), or of
    ``rtok``, or both multiplied.  Records go whole to the cells of a grid, so the matches of a
    token, of which there can be as many as pairs, are never rows of Spark.
    ``k`` leaves out pairs that k others of their r surpass; ``least``
    ``(id_r, least)`` those whose sum is smaller (an r without it keeps all)."""
    rows, columns = _grid(post, rtok, salt_rows)
    def whole(df, key):
        none = F.lit(None).cast("array<double>")
        if {"tf", "idf"} <= set(df.columns):
            ws, idf = F.collect_list("tf"), F.collect_list("idf")
        else:
            ws, idf = F.collect_list("w") if "w" in df.columns else none, none
        return df.groupBy(key).agg(F.collect_list("token").alias("tokens"), ws.alias("ws"), idf.alias("idf"))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("double").alias("least")
    left, right = whole(post, "id_l"), whole(rtok, "id_r")
    least = right.withColumn("least", none) if least is None else right.join(least, "id_r", "left")
    packed = lambda df, key, n, least: (df.select(number(key, n).alias("part"), F.col(key).alias("id"), "tokens", "ws", "idf", least)
                                        .mapInArrow(_blocks, "part int, block binary"))
    left = (packed(left, "id_l", rows, none)
            .select(F.lit(True).alias("left"), "block", F.col("part").alias("row"), each(columns).alias("column")))
    right = (packed(least, "id_r", columns, "least")
             .select(F.lit(False).alias("left"), "block", each(rows).alias("row"), F.col("part").alias("column")))
    id_l, id_r = (dict(df.dtypes)[c] for df, c in ((post, "id_l"), (rtok, "id_r")))
    return (left.unionByName(right).select((F.col("row") * columns + F.col("column")).alias("cell"), "left", "block")
            .repartitionById(rows * columns, "cell").groupBy("cell")
            .applyInArrow(_cell_pairs(k), f"id_l {id_l}, id_r {id_r}, n long, w double"))


def token_join(rtok: DataFrame, post: DataFrame, salt_rows: int = SALT_ROWS, by_pair: bool = False) -> DataFrame:
    """``rtok ⋈ postings`` on token, cutting tokens that are frequent on either side.

    ``by_pair`` brings the matches of each pair together, ``(id_l, id_r, n, w)``
    as in ``pair_sums``, without a row for each match.

    A token held by more than ``salt_rows`` records of L or R becomes a grid
    of cells: its postings are spread over ``ceil(df_L / salt_rows)`` rows by
    a hash of ``id_l``, its R records over ``ceil(df_R / salt_rows)`` columns
    by a hash of ``id_r``, and each side is repeated along the other, so a
    cell joins at most about ``salt_rows`` records of each side."""
    if by_pair:
        return pair_sums(rtok, post, salt_rows=salt_rows)
    cells = lambda n: F.ceil(F.col(n) / F.lit(float(salt_rows))).cast("int")
    df_l = post.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salt_rows)
    df_r = rtok.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salt_rows)
    hot = (df_l.select("token", cells("n").alias("nl")).join(df_r.select("token", cells("n").alias("nr")), "token", "full")
           .select("token", F.coalesce("nl", F.lit(1)).alias("nl"), F.coalesce("nr", F.lit(1)).alias("nr"))
           .persist(StorageLevel.MEMORY_AND_DISK))
    n_hot = hot.count()
    if n_hot == 0:
        hot.unpersist()
        return rtok.join(post.drop("df", "tf", "idf"), "token")
    if n_hot <= HOT_BROADCAST_ROWS:
        hot = F.broadcast(hot)
    grid = lambda df: (df.join(hot, "token", "left")
                       .withColumn("nl", F.coalesce("nl", F.lit(1))).withColumn("nr", F.coalesce("nr", F.lit(1))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (grid(post.drop("df", "tf", "idf")).withColumn("row", F.pmod(F.xxhash64("id_l"), F.col("nl")).cast("int"))
            .withColumn("column", each("nr")).drop("nl", "nr"))
    right = (grid(rtok).withColumn("column", F.pmod(F.xxhash64("id_r"), F.col("nr")).cast("int"))
             .withColumn("row", each("nl")).drop("nl", "nr"))
    return right.join(left, ["token", "row", "column"]).drop("row", "column")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Keep every l scoring at least the k-th best score of its r (ties kept)."""
    w = Window.partitionBy("id_r").orderBy(F.col("score").desc())
    return (scores.withColumn("rk", F.rank().over(w))
            .where(F.col("rk") <= k).select("id_l", "id_r", "score"))


def block_scores(lnorm: DataFrame, rnorm: DataFrame, n_left: int,
                 weighting: str = "tfidf", salt_rows: int = SALT_ROWS,
                 postings: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Scores of all pairs that share a token; with ``k``, of those that ``top_k`` can keep."""
    post = postings if postings is not None else left_postings(lnorm, n_left, weighting)
    return (pair_sums(right_tokens(rnorm), post, k, salt_rows)
            .select("id_l", "id_r", F.round("w", SCORE_DIGITS).alias("score")))


def block_normalized(lnorm: DataFrame, rnorm: DataFrame, n_left: int,
                     k: int | None = None, weighting: str = "tfidf",
                     salt_rows: int = SALT_ROWS, keep_score: bool = False,
                     postings: DataFrame | None = None) -> DataFrame:
    """Top-k candidates.  R records of equal value are blocked once: the join
    and the ranking run on one record of each value, whose candidates the
    others share."""
    k = default_k(n_left) if k is None else k
    one = rnorm.groupBy("value").agg(F.min("id").alias("id"))
    best = top_k(block_scores(lnorm, one.select("id", "value"), n_left, weighting, salt_rows, postings, k), k)
    same = rnorm.select("id", "value").join(one.select("value", F.col("id").alias("rep")), "value").select("id", "rep")
    out = (best.withColumnRenamed("id_r", "rep").join(same, "rep")
           .select("id_l", F.col("id").alias("id_r"), "score"))
    return out if keep_score else out.select("id_l", "id_r")


class TokenBlocker:
    """Default blocker (TF-IDF) and its BM25 variants."""

    def __init__(self, num_candidates: int | None = None, weighting: str = "tfidf",
                 stem: bool = True, salt_rows: int = SALT_ROWS):
        self.num_candidates = num_candidates
        self.weighting = weighting
        self.stem = stem
        self.salt_rows = salt_rows

    def block(self, left: DataFrame, right: DataFrame, id_col: str,
              cols: list[str]) -> DataFrame:
        lnorm = normalize_records(left, id_col, cols, self.stem)
        rnorm = normalize_records(right, id_col, cols, self.stem)
        n_left = left.count()
        return block_normalized(lnorm, rnorm, n_left, self.num_candidates,
                                self.weighting, self.salt_rows)


class LookupBlocker:
    """Candidates from a caller-supplied lookup table.

    ``lookup(key, id_l, ordinal)``: for every normalised R value ``key`` the
    ordered candidate L ids (e.g. hits of an external entity search).  The
    first ``k`` hits per R record are kept.
    """

    def __init__(self, lookup: DataFrame, k: int, stem: bool = False):
        self.lookup, self.k, self.stem = lookup, k, stem

    def block(self, left, right, id_col, cols):
        rnorm = normalize_records(right, id_col, cols, self.stem)
        hits = (rnorm.join(self.lookup, rnorm["value"] == self.lookup["key"])
                .where(F.col("ordinal") <= self.k)
                .select("id_l", F.col("id").alias("id_r")))
        return hits.join(left.select(F.col(id_col).alias("id_l")), "id_l", "left_semi")


class WordSetBlocker:
    """Example custom blocker: L and R records with the same set of words."""

    def __init__(self, stem: bool = False):
        self.stem = stem

    def block(self, left, right, id_col, cols):
        def keyed(df, name):
            n = normalize_records(df, id_col, cols, self.stem)
            words = F.array_sort(F.array_distinct(split_by_space("value")))
            return n.select(F.col("id").alias(name), F.array_join(words, " ").alias("w"))
        return keyed(left, "id_l").join(keyed(right, "id_r"), "w").select("id_l", "id_r")


class MinHashBlocker:
    """Candidates by MinHash signatures in bands: pairs whose sets of blocking tokens have a Jaccard
    similarity of ``threshold`` or more.

    A signature has ``bands * rows`` minima of seeded hashes; records that agree on all rows of a band
    meet, are made distinct and are compared by their whole sets, so no pair below the threshold comes
    out.  A pair of similarity s is met with the probability 1 - (1 - s ** rows) ** bands: 0.99 at 0.6
    with the default 32 bands of 4 rows.  Records of equal sets are one representative, so many copies
    of a record are not many members of a band; a band value held by many different sets is cut into a
    grid of cells like a frequent token.  Records without tokens have no candidates."""

    def __init__(self, threshold: float = 0.6, bands: int = 32, rows: int = 4, stem: bool = True, salt_rows: int = SALT_ROWS):
        self.threshold, self.bands, self.rows, self.stem, self.salt_rows = threshold, bands, rows, stem, salt_rows

    def _sets(self, df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
        n = normalize_records(df, id_col, cols, self.stem)
        toks = F.array_sort(F.array_distinct(block_tokens("value")))
        return n.where(F.length("value") > 0).select("id", toks.alias("toks"))

    def _banded(self, sets: DataFrame, name: str) -> DataFrame:
        """(name, token): the band values of each distinct set, one row a band."""
        least = lambda i: F.array_min(F.transform("toks", lambda t: F.xxhash64(t, F.lit(i))))
        bands = [F.xxhash64(F.lit(b), *[least(b * self.rows + r) for r in range(self.rows)]) for b in range(self.bands)]
        return sets.select(F.col("id").alias(name), F.explode(F.array(*bands)).alias("token"))

    def block(self, left, right, id_col, cols, keep_score: bool = False):
        sides = []
        for df in (left, right):
            sets = self._sets(df, id_col, cols)
            reps = sets.groupBy("toks").agg(F.min("id").alias("id")).persist(StorageLevel.MEMORY_AND_DISK)
            members = sets.join(reps.select("toks", F.col("id").alias("rep")), "toks").select("id", "rep")
            sides.append((reps, members))
        (lreps, lmem), (rreps, rmem) = sides
        post = self._banded(lreps, "id_l").withColumn("df", F.lit(0))
        met = token_join(self._banded(rreps, "id_r"), post, self.salt_rows).select("id_l", "id_r").distinct()
        whole = (met.join(lreps.select(F.col("id").alias("id_l"), F.col("toks").alias("x")), "id_l")
                 .join(rreps.select(F.col("id").alias("id_r"), F.col("toks").alias("y")), "id_r"))
        both = F.size(F.array_intersect("x", "y"))
        near = (whole.withColumn("jaccard", both / (F.size("x") + F.size("y") - both))
                .where(F.col("jaccard") >= self.threshold).select(F.col("id_l").alias("rl"), F.col("id_r").alias("rr"), "jaccard"))
        out = (near.join(lmem.select(F.col("id").alias("id_l"), F.col("rep").alias("rl")), "rl")
               .join(rmem.select(F.col("id").alias("id_r"), F.col("rep").alias("rr")), "rr"))
        return out.select("id_l", "id_r", "jaccard") if keep_score else out.select("id_l", "id_r")


def containment_pairs(lsets: DataFrame, rsets: DataFrame) -> DataFrame:
    """All (id_l, id_r) where one token set contains the other; sets: id, toks.

    A contained set's rarest token also stands in the set that contains it,
    so each set is joined by that one token to the other side's tokens and
    then compared in full.  Nothing is cut; sets without tokens have no pair."""
    both = lsets.select(F.explode("toks").alias("token")).unionByName(rsets.select(F.explode("toks").alias("token")))
    freq = both.groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def inside(small: DataFrame, big: DataFrame, a: str, b: str) -> DataFrame:
        rare = (small.select("id", F.explode("toks").alias("token")).join(freq, "token")
                .groupBy("id").agg(F.min(F.struct("n", "token"))["token"].alias("token")))
        probe = small.join(rare, "id").select(F.col("id").alias(a), "token", F.col("toks").alias("x"))
        held = big.select(F.col("id").alias(b), F.col("toks").alias("y"), F.explode("toks").alias("token"))
        return probe.join(held, "token").where(F.size(F.array_except("x", "y")) == 0).select("id_l", "id_r")

    return inside(lsets, rsets, "id_l", "id_r").unionByName(inside(rsets, lsets, "id_r", "id_l")).distinct()


def overlap_pairs(ltok: DataFrame, rtok: DataFrame, share: float, slack: float = 0.0) -> DataFrame:
    """All (id_l, id_r) that share ``share`` of the weight of r, less ``slack``; tokens: id, token, w.

    The shared weight of every pair that shares a token is summed in the cells
    of a grid, which send on the pairs that reach the bound; no pair is lost.
    Tokens must be distinct by id and their weights, which are those of
    ``rtok``, not negative."""
    right = rtok.select(F.col("id").alias("id_r"), "token", "w")
    least = right.groupBy("id_r").agg((F.lit(share) * F.sum("w") - F.lit(slack) - 1e-9).alias("least"))
    return pair_sums(right, ltok.select(F.col("id").alias("id_l"), "token"), least=least).select("id_l", "id_r")


def block_self(blocker, left: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """LL candidates: L blocked against itself, self pairs dropped."""
    return blocker.block(left, left, id_col, cols).where(F.col("id_l") != F.col("id_r"))


def block_pairs(blocker, left: DataFrame, right: DataFrame, id_col: str,
                cols: list[str]):
    """(LL, LR, lnorm, rnorm): LL without self pairs.  The token blocker
    normalises L once and reuses it for both calls."""
    if isinstance(blocker, TokenBlocker):
        lnorm = normalize_records(left, id_col, cols, blocker.stem).persist(StorageLevel.MEMORY_AND_DISK)
        rnorm = normalize_records(right, id_col, cols, blocker.stem).persist(StorageLevel.MEMORY_AND_DISK)
        n_left = lnorm.count()
        # L's postings serve both the LL and the LR blocking
        post = left_postings(lnorm, n_left, blocker.weighting).persist(StorageLevel.MEMORY_AND_DISK)
        blocker.last_postings = post  # released by the caller once the pairs are cut
        ll = block_normalized(lnorm, lnorm, n_left, blocker.num_candidates, blocker.weighting,
                              blocker.salt_rows, postings=post).where(F.col("id_l") != F.col("id_r"))
        lr = block_normalized(lnorm, rnorm, n_left, blocker.num_candidates, blocker.weighting,
                              blocker.salt_rows, postings=post)
        return ll, lr, lnorm, rnorm
    ll = block_self(blocker, left, id_col, cols)
    lr = blocker.block(left, right, id_col, cols)
    return ll, lr, None, None
