"""Approximate nearest neighbours: a navigable small-world graph per shard.

Distinct vectors are dealt to shards by length, and by hash among those of
about one length.  Every shard builds a hierarchy of proximity graphs, kept as flat neighbour arrays, and is searched from the
top layer down with a beam.  Insertions and searches run a batch of vectors in
step, so the work is NumPy on whole batches.  Shard results are rescored in
double precision on the original vectors and merged.

The measure is the inner product.  In the graph each vector has one more
component that brings all of them to the length of the shard's longest, where
the largest inner product is the least distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzyspark.llm.common import written

#: vectors of a shard (beyond it there are more shards) and least shards
SHARD, SHARDS = 4096, 8
#: neighbours kept in the upper layers and in the lowest, beams of building and of searching
LINKS, LINKS0, BUILD_BEAM, SEARCH_BEAM = 12, 24, 48, 256
#: nodes expanded at once, vectors in step, vectors up to which all are compared, queries of a block
EXPAND, STEP, SMALL, BLOCK = 4, 256, 256, 4096
TOP, EVERY = 20, 20


def _largest(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in any order."""
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query, best first; -1 where fewer were reached.  entry: start nodes."""
    n = len(q)
    # products with all nodes at once, which a walk then looks up, cost less than gathering the vectors it meets
    near_all = q @ x[:len(graph)].T
    seen = np.zeros((n, len(graph)), bool)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    first = np.take_along_axis(near_all, np.maximum(ids[:, :width], 0), 1)
    sims[:, :width] = np.where(ids[:, :width] >= 0, first, -np.inf)
    given = np.nonzero(ids[:, :width] >= 0)
    seen[given[0], ids[given]] = True
    done = np.ones((n, beam), bool)
    done[:, :width] = ids[:, :width] < 0
    live = np.arange(n)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        pick = _best(open_sims, min(EXPAND, beam))
        usable = np.isfinite(np.take_along_axis(open_sims, pick, 1))
        alive = usable[:, 0]
        live, pick, usable = live[alive], pick[alive], usable[alive]
        if not len(live):
            break
        r = live[:, None]
        node = ids[r, pick]
        mark = done[r, pick]
        done[r, pick] = mark | usable
        near = np.where(usable[:, :, None], graph[np.maximum(node, 0)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[r, np.maximum(near, 0)]
        at = np.nonzero(fresh)
        seen[live[at[0]], near[at]] = True
        s = np.full(near.shape, -np.inf)
        s[at] = near_all[live[at[0]], near[at]]
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
        all_sims = np.concatenate((sims[live], s), axis=1)
        all_done = np.concatenate((done[live], ~fresh), axis=1)
        keep = _largest(all_sims, beam)
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, links: int) -> np.ndarray:
    """Up to ``links`` candidates of each vector, near it and not nearer to one another; cand: -1 padded."""
    ok = cand >= 0
    vec = x[np.maximum(cand, 0)]
    sims = np.where(ok, np.einsum("bd,bkd->bk", x[own], vec), -np.inf)
    left, out = sims.copy(), np.full((len(own), links), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(min(links, cand.shape[1])):
        best = np.argmax(left, axis=1)
        some = np.isfinite(left[rows, best])
        out[some, k] = cand[rows, best][some]
        between = np.einsum("bd,bkd->bk", vec[rows, best], vec)
        left = np.where((between > sims) & some[:, None], -np.inf, left)
        left[rows, best] = -np.inf
    # fill what is free with the nearest that were passed over
    taken = (cand[:, :, None] == out[:, None, :]).any(axis=2) if links < 64 else np.zeros_like(ok)
    rest = np.where(ok & ~taken, sims, -np.inf)
    free = out < 0
    fill = _best(rest, links)
    value = np.where(np.isfinite(np.take_along_axis(rest, fill, 1)), np.take_along_axis(cand, fill, 1), -1)
    place = np.minimum(np.cumsum(free, axis=1) - 1, value.shape[1] - 1)
    return np.where(free, np.take_along_axis(value, np.maximum(place, 0), 1), out)


class Graph:
    """Layers of neighbour arrays; nodes are ordered by falling level, so a layer's nodes are its first."""

    def __init__(self, sizes: list[int], layers: list[np.ndarray]):
        self.sizes, self.layers = sizes, layers  # from the lowest layer up

    def entries(self, x: np.ndarray, q: np.ndarray, above: int) -> np.ndarray:
        """The nodes to enter layer ``above`` - 1 by, found from the top down to ``above``."""
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.layers) - 1, above - 1, -1):
            entry, _ = beam_search(x, self.layers[layer], q, entry, 8)
        return entry

    def search(self, x: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
        out = [beam_search(x, self.layers[0], q[i:i + STEP], self.entries(x, q[i:i + STEP], 1), beam)[0]
               for i in range(0, len(q), STEP)]
        return np.concatenate(out) if out else np.zeros((0, beam), np.int64)


def levels(n: int, seed: int) -> np.ndarray:
    """Falling levels, geometrically rarer upwards."""
    u = np.random.default_rng(seed).random(n)
    return -np.sort(-np.floor(-np.log(1 - u) / np.log(LINKS)).astype(np.int64))


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """x: vectors of equal length, in the order of insertion."""
    lev = levels(len(x), seed)
    top = int(lev[0]) if len(x) else 0
    sizes = [int(np.searchsorted(-lev, -k, "right")) for k in range(top + 1)]
    layers: list[np.ndarray] = [None] * (top + 1)
    g = Graph(sizes, layers)
    for layer in range(top, -1, -1):
        n, links = sizes[layer], LINKS0 if layer == 0 else LINKS
        nbr = np.full((n, links), -1, np.int64)
        upper = Graph(sizes[layer + 1:], layers[layer + 1:])
        at = 1
        while at < n:
            stop = min(n, at + max(1, min(STEP, at // 4)))
            own = np.arange(at, stop)
            if at <= SMALL:
                sims = x[own] @ x[:at].T
                cand = _best(sims, BUILD_BEAM)
            else:
                # nodes of the layers above that this layer does not hold yet give way to the first
                entry = np.sort(np.where((found := upper.entries(x, x[own], 0)) < at, found, 0), axis=1)
                entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
                cand, _ = beam_search(x, nbr[:at], x[own], entry, BUILD_BEAM)
            chosen = _diverse(x, own, cand, links // 2)
            nbr[own, :links // 2] = chosen
            # links back; a full list is chosen anew
            a, b = chosen[chosen >= 0], np.repeat(own, (chosen >= 0).sum(axis=1))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            node, first, count = np.unique(a, return_index=True, return_counts=True)
            extra = np.full((len(node), int(count.max())), -1, np.int64)
            extra[np.repeat(np.arange(len(node)), count), np.arange(len(a)) - np.repeat(first, count)] = b
            nbr[node] = _diverse(x, node, np.concatenate((nbr[node], extra), axis=1), links)
            at = stop
        layers[layer] = nbr
    return g


def _lift(v: np.ndarray, longest: float) -> np.ndarray:
    v = v / longest
    return np.hstack((v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))[:, None]))


def _lifted(v: np.ndarray) -> np.ndarray:
    v = np.ldexp(v, -np.frexp(np.abs(v).max(initial=0.0))[1])  # no square leaves the range of doubles
    return _lift(v, float(np.sqrt((v * v).sum(axis=1).max(initial=0.0))) or 1.0)


def _scores(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products, and those beyond the range of doubles times 2 ** -1100 (else 0)."""
    with np.errstate(over="ignore", invalid="ignore"):
        score, beyond = v @ q, np.zeros(len(v))
        wide = ~np.isfinite(score)
        if wide.any():
            e, eq = np.frexp(np.abs(v[wide]).max(axis=1))[1], np.frexp(np.abs(q).max())[1]
            t = np.ldexp(v[wide], -e[:, None]) @ np.ldexp(q, -eq)
            score[wide] = np.ldexp(t, e + eq)
            beyond[wide] = np.where(np.isinf(score[wide]), np.ldexp(t, e + eq - 1100), 0.0)
    return score, beyond


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: an id, no null, non-finite or only zero
    components, and the most common number of components.  Of rows that repeat an id, the least vector."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.select("vec_id", vec.alias("vec")).filter(fine).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = written(rows, "vectors")
    dim = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (dim["d"] if dim else 0))


def _index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first").reset_index(drop=True)
    v = np.array(rows["vec"].tolist(), np.float64)
    order = np.random.default_rng(int(key[0])).permutation(len(v))  # levels fall with the node number
    v, ids = v[order], [rows["ids"][i] for i in order]
    g = build(_lifted(v), int(key[0]))
    return pd.DataFrame({"shard": [int(key[0])], "dim": [v.shape[1]], "vecs": [v.ravel()],
                         "ids": [np.concatenate(ids)], "counts": [np.array([len(i) for i in ids], np.int64)],
                         "widths": [[x.shape[1] for x in g.layers]], "neighbours": [[x.ravel() for x in g.layers]]})


INDEX = "shard int, dim int, vecs array<double>, ids array<long>, counts array<long>, widths array<int>, neighbours array<array<long>>"


def _deal(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(first shard, shards) of each band of lengths.  Neighbouring bands share a shard as long as all
    its vectors are compared, so shards stay few however the lengths spread."""
    n, packs = sum(counts.values()), []
    for band in sorted(counts):
        if packs and packs[-1][1] + counts[band] <= SMALL:
            packs[-1][0].append(band)
            packs[-1][1] += counts[band]
        else:
            packs.append([[band], counts[band]])
    out, at = {}, 0
    for bands, c in packs:
        k = max(1, -(-c // SHARD), round(SHARDS * c / n))
        out |= dict.fromkeys(bands, (at, k))
        at += k
    return out


def index(rows: DataFrame, top: int = TOP) -> tuple[DataFrame, int]:
    """The shards' graphs as a written table, and their number.

    A band holds lengths up to four times the least: the component added to a
    much shorter vector would hide its differences.  Equal vectors are one node
    with their ``top`` + 1 smallest ids: ties go to smaller ids and a query
    passes over its own, so no further id is ever returned."""
    w = Window.partitionBy("vec").orderBy("vec_id")
    ids = (rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1)
           .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    most = F.array_max(F.transform("vec", F.abs))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    band = F.floor((F.log2("most") + F.log2(square) / 2 + 1) / 2).cast("int")
    nodes = written(ids.withColumn("most", most).select("vec", "ids", F.col("ids")[0].alias("first"), band.alias("band")), "nodes")
    dealt = _deal({r["band"]: r["count"] for r in nodes.groupBy("band").count().collect()})
    if not dealt:
        return written(rows.sparkSession.createDataFrame([], INDEX), "graphs"), 1
    place = [F.create_map(*[F.lit(x) for b, t in dealt.items() for x in (b, t[i])])[F.col("band")] for i in range(2)]
    shard = (place[0] + F.pmod(F.xxhash64("first"), place[1])).cast("int")
    graphs = nodes.select(shard.alias("shard"), "vec", "ids", "first").groupBy("shard").applyInPandas(_index, INDEX)
    return written(graphs, "graphs"), max(at + k for at, k in dealt.values())


def _search(queries: pd.DataFrame, shard: pd.DataFrame, top: int, beam: int) -> pd.DataFrame:
    cols = ["query_id", "vec_id", "score", "beyond"]
    if not len(queries) or not len(shard):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "beyond": np.zeros(0)})[cols]
    s = shard.iloc[0]
    v = np.asarray(s["vecs"], np.float64).reshape(-1, int(s["dim"]))
    layers = [np.asarray(x, np.int64).reshape(-1, int(w)) for x, w in zip(s["neighbours"], s["widths"])]
    g = Graph([len(x) for x in layers], layers)
    q = np.array(queries["vec"].tolist(), np.float64)
    unit = np.ldexp(q, -np.frexp(np.abs(q).max(axis=1, keepdims=True))[1])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = g.search(_lifted(v), np.hstack((unit, np.zeros((len(q), 1)))), beam)
    counts = np.asarray(s["counts"], np.int64)
    start = np.cumsum(counts) - counts
    ids = np.asarray(s["ids"], np.int64)
    out = []
    for i, own in enumerate(queries["query_id"].tolist()):
        node = found[i][found[i] >= 0]
        score, beyond = _scores(v[node], q[i])
        n = counts[node]
        vec = ids[np.repeat(start[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        score, beyond = np.repeat(score, n)[vec != own], np.repeat(beyond, n)[vec != own]
        vec = vec[vec != own]
        best = np.lexsort((vec, -beyond, -score))[:top]
        out.append(pd.DataFrame({"query_id": own, "vec_id": vec[best], "score": score[best], "beyond": beyond[best]}))
    return pd.concat(out)[cols]


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every vector whose id is divisible by ``every``.

    A query's candidates are all rows but its own id; all of them are returned
    where there are fewer than ``top``.  Equal scores rank by id; a product beyond
    the range of doubles is given as infinity and ranks by its size.  Rows that
    take no part are told in ``usable``; an empty table gives no rows; further
    columns are ignored."""
    rows = usable(vectors)
    graphs, shards = index(rows, top)
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = queries.select(F.col("vec_id").alias("query_id"), "vec", block.alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    served = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = asked.groupBy("shard", "block").cogroup(served.groupBy("shard", "block")).applyInPandas(
        lambda q, s: _search(q, s, top, beam), "query_id long, vec_id long, score double, beyond double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
