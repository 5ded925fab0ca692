"""Greedy selection of a union of (join function, threshold) configs.

The per-r table ``G(w, id_r, ls, ps)`` is built once and checkpointed.  The
gains of all configs are summed over G once; a step then touches only the
records whose state its config changes (a higher precision, or a new l), and
sends the differences of their gains, by config, to the gains table of at most
|JF|·T numbers.  The state of a record after a prefix of selected configs is a
pure function of that prefix (best precision = max over the selected configs,
joined l's = the l's those configs propose), so there is no state table and no
growing lineage.

``w`` numbers searches that share the table, such as those of several column
weights.  They advance together, one job a step for all of them.  Where the
records of a search take up to ``TASK_BYTES``, one task holds them and makes
all of its steps, the searches side by side in one job.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzyspark.session import reliable_checkpoint

PATIENCE = 0.05
# bytes of precisions in a partition of the per-r table
PART_BYTES = 1 << 24
# bytes of precisions up to which the records of a search are searched in one task; and records looked at together there
TASK_BYTES, TASK_ROWS = 1 << 26, 512
# places to which profits are compared
DIGITS = 9


def densify(G: DataFrame, nj: int | None = None, nt: int | None = None) -> DataFrame:
    """Map layout ``m: map<j, struct<l, ps>>`` → dense layout
    ``ls: array<l>`` (|JF|) and ``ps: array<double>`` (|JF|·T, config
    c = j·T + t), which the per-iteration scan explodes inside codegen."""
    if "w" not in G.columns:
        G = G.withColumn("w", F.lit(0))
    if "ps" in G.columns:
        return G
    if nj is None or nt is None:
        sizes = G.select(F.max(F.array_max(F.map_keys("m"))).alias("nj"),
                         F.max(F.array_max(F.transform(F.map_values("m"), lambda v: F.size(v["ps"])))).alias("nt")).first()
        nj, nt = int(sizes["nj"] or 0) + 1, int(sizes["nt"] or 0)
    m = F.col("m")
    ls = F.transform(F.sequence(F.lit(0), F.lit(nj - 1)), lambda j: F.try_element_at(m, j)["l"])
    pad = lambda j: F.coalesce(F.try_element_at(m, j)["ps"], F.array().cast("array<double>"))
    ps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(nj - 1)), lambda j: F.concat(
        pad(j), F.array_repeat(F.lit(None).cast("double"), F.lit(nt) - F.size(pad(j))))))
    return G.select("w", "id_r", ls.alias("ls"), ps.alias("ps"), F.lit(nt).alias("nt"))


def _dims(G: DataFrame) -> tuple[int, int]:
    """(T, |JF|) of a dense G."""
    r = G.select("nt", F.size("ls").alias("nj")).head(1)
    return (int(r[0]["nt"]), int(r[0]["nj"])) if r else (1, 0)


def _nt(G: DataFrame) -> int:
    return _dims(G)[0]


def _sel_literal(selected: list[tuple[int, int]], nt: int) -> Column:
    return F.array(*[F.struct(F.lit(j * nt + t).alias("c"), F.lit(j).alias("j"), F.lit(k).alias("k"))
                     for k, (j, t) in enumerate(selected)])


def _p_at(s: Column) -> Column:
    return F.try_element_at(F.col("ps"), s["c"] + 1)


def _l_at(s: Column) -> Column:
    return F.try_element_at(F.col("ls"), s["j"] + 1)


def _by_search(rows: dict[int, list[int]]) -> str:
    """SQL of the integers of the row's search, null for a search beyond them: an array literal of array
    literals, which code generation references, so the generated code is the same in every step."""
    n = max(rows, default=0) + 1
    arrays = (f"cast(array({', '.join(map(str, rows.get(w, [])))}) AS array<int>)" for w in range(n))
    return f"get(array({', '.join(arrays)}), w)"


def _state(selected: dict[int, list], nt: int, ltype: str) -> tuple[str, str]:
    """SQL of (p_cur, known) of every record after the selected configs of its search.

    ps of one jf is non-null exactly from the first threshold ≥ d on, so
    "r has a proposal from jf js" is one null test at the largest selected
    threshold of js; the proposed l's of those jfs are r's known ones."""
    top = {w: {} for w in selected}
    for w, configs in selected.items():
        for j, t in configs:
            top[w][j] = max(t, top[w].get(j, -1))
    sel = _by_search({w: [j * nt + t for j, t in configs] for w, configs in selected.items()})
    act = _by_search({w: [j * nt + m[j] for j in sorted(m)] for w, m in top.items()})
    return (f"coalesce(array_max(transform({sel}, c -> element_at(ps, c + 1))), 0D)",
            f"cast(transform(filter({act}, c -> element_at(ps, c + 1) IS NOT NULL), "
            f"c -> element_at(ls, cast(c div {nt} AS int) + 1)) AS array<{ltype}>)")


def _l_type(G: DataFrame) -> str:
    return G.schema["ls"].dataType.elementType.simpleString()


def config_gains(G: DataFrame, selected, nt: int | None = None) -> list:
    """Gains of every config after ``selected``, in one scan of G: sorted
    (j, t, ΔTP, Δn).

    ΔTP = Σ max(0, p − p_cur), Δn = #r whose proposed l is new for r.  The
    state is evaluated once per r inside an ``inline`` generator (a plain
    projection would be pushed past the explode and re-evaluated per row).
    The plans are written as SQL text, which costs a call a clause and not one
    an expression; they are built anew in every step."""
    G = densify(G)
    return [g[1:] for g in _all_gains(G, {0: list(selected)}, nt or _nt(G))]


def _all_gains(G: DataFrame, selected: dict[int, list], nt: int) -> list:
    """Sorted (w, j, t, ΔTP, Δn) of a dense G."""
    p_cur, known = _state(selected, nt, _l_type(G))
    agg = (G.selectExpr("w", f"inline(array(struct({p_cur} AS pc, {known} AS cs, ls, ps)))")
           .selectExpr("w", "pc", "cs", "ls", "posexplode(ps) AS (c, p)").where("p IS NOT NULL")
           .selectExpr("w", "c", "greatest(p - pc, 0D) AS dtp",
                       f"if(coalesce(array_contains(cs, element_at(ls, cast(c div {nt} AS int) + 1)), false), 0, 1) AS dn")
           .groupBy("w", "c").agg({"dtp": "sum", "dn": "sum"}).toDF("w", "c", "dtp", "dn").collect())
    return sorted((r["w"], r["c"] // nt, r["c"] % nt, r["dtp"], r["dn"]) for r in agg)


def gain_changes(G: DataFrame, selected: dict[int, list], added: dict[int, tuple[int, int]], nt: int) -> list:
    """(w, j, t, change of ΔTP, change of Δn) by which adding ``added`` after ``selected`` alters the gains.

    Only the records whose state changes are exploded: those that the added
    config lifts above their best precision, or joins to an l new to them."""
    p_cur, known = _state({w: selected.get(w, []) for w in added}, nt, _l_type(G))
    star = _by_search({w: [j * nt + t] for w, (j, t) in added.items()})
    agg = (G.selectExpr("*", f"get({star}, 0) AS star").selectExpr("*", "get(ps, star) AS p1").where("p1 IS NOT NULL")
           .selectExpr("w", f"inline(array(struct({p_cur} AS pc, {known} AS cs, p1, get(ls, cast(star div {nt} AS int)) AS l1, ls, ps)))")
           .selectExpr("*", "NOT coalesce(array_contains(cs, l1), false) AS fresh").where("fresh OR p1 > pc")
           .selectExpr("w", "pc", "p1", "l1", "fresh", "ls", "posexplode(ps) AS (c, p)").where("p IS NOT NULL")
           .selectExpr("w", "c", "greatest(p - greatest(pc, p1), 0D) - greatest(p - pc, 0D) AS dtp",
                       f"if(fresh AND element_at(ls, cast(c div {nt} AS int) + 1) = l1, -1, 0) AS dn")
           .where("dtp <> 0 OR dn <> 0")
           .groupBy("w", "c").agg({"dtp": "sum", "dn": "sum"}).toDF("w", "c", "dtp", "dn").collect())
    return [(r["w"], r["c"] // nt, r["c"] % nt, r["dtp"], r["dn"]) for r in agg]


@dataclass
class GreedyResult:
    selected: list = field(default_factory=list)      # full selection order
    n_keep: int = 0                                   # prefix meeting the target
    precision: float | None = None                    # its estimated precision
    last_precision: float | None = None
    history: list = field(default_factory=list)

    @property
    def configs(self):
        return self.selected[: self.n_keep] if self.n_keep else None


def _best(gains, tp, n):
    """The config of the highest profit, the first in (jf, threshold) order on
    ties.  Profits are compared to ``DIGITS`` places, so that the order in
    which a cluster sums the gains cannot decide."""
    best = None
    for j, t, dtp, dn in gains:
        if dn == 0:
            continue
        tpn, nn = tp + dtp, n + dn
        profit = round(tpn / (nn - tpn + 1e-9), DIGITS)
        if best is None or profit > best[0]:
            best = (profit, j, t, dtp, dn, tpn / (nn + 1e-9))
    return best


def run_greedy(G: DataFrame, target: float, patience: float = PATIENCE) -> GreedyResult:
    """Add the most profitable config until none adds a match or the estimated
    precision is more than ``patience`` below the target."""
    return run_greedy_many(G, target, patience).get(0) or GreedyResult()


def run_greedy_many(G: DataFrame, target: float, patience: float = PATIENCE) -> dict[int, GreedyResult]:
    """The greedy result of every search ``w`` of G, all of them advanced by one job a step, or in a task each where they are small."""
    G = densify(G)
    nt, nj = _dims(G)
    most = G.groupBy("w").count().agg(F.max("count")).first()[0] or 0
    if 0 < most * nj * nt * 8 <= TASK_BYTES:
        rows = G.select("w", "ls", "ps").groupBy("w").applyInArrow(_search_task(nt, target, patience), "w int, found string").collect()
        return {r["w"]: GreedyResult(**{k: [tuple(c) for c in v] if k == "selected" else v for k, v in json.loads(r["found"]).items()}) for r in rows}
    gains: dict[int, dict] = {}
    for w, j, t, dtp, dn in _all_gains(G, {}, nt):
        gains.setdefault(w, {})[j, t] = (dtp, dn)
    return _advance(gains, lambda before, added: gain_changes(G, before, added, nt), target, patience)


def _advance(gains: dict[int, dict], changes, target: float, patience: float) -> dict[int, GreedyResult]:
    """The steps of all searches from their first gains; ``changes(before, added)``: those of ``gain_changes``."""
    out = {w: GreedyResult() for w in gains}
    sums = dict.fromkeys(gains, (0.0, 0))
    live = sorted(gains)
    while live:
        before, added = {w: list(out[w].selected) for w in live}, {}
        for w in live:
            tp, n = sums[w]
            best = _best([(j, t, *gains[w][j, t]) for j, t in sorted(gains[w])], tp, n)
            if best is None:
                continue
            profit, j, t, dtp, dn, avg = best
            res, sums[w] = out[w], (tp + dtp, n + dn)
            res.selected.append((j, t))
            res.history.append({"j": j, "t": t, "profit": profit, "precision": avg, "n": n + dn})
            res.last_precision = avg
            if avg > target:
                res.n_keep, res.precision = len(res.selected), avg
            if avg >= target - patience:
                added[w] = (j, t)
        for w, j, t, dtp, dn in (changes(before, added) if added else []):
            a, b = gains[w][j, t]
            gains[w][j, t] = (a + dtp, b + dn)
        live = sorted(added)
    return out


class _Records:
    """The records of one search in a task, with the best precision of each so far."""

    def __init__(self, ls: pa.Array, ps: pa.Array, n: int, nt: int):
        self.nt = nt
        self.ps = ps.to_numpy(zero_copy_only=False).reshape(n, -1)
        self.ls = ls.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(n, -1)
        self.best = np.zeros(n)

    def _listed(self, dtp: np.ndarray, dn: np.ndarray, some: np.ndarray) -> list:
        return [(0, int(c) // self.nt, int(c) % self.nt, float(dtp[c]), int(dn[c])) for c in np.flatnonzero(some)]

    def gains(self) -> list:
        """``_all_gains`` of no selected config."""
        dtp, dn = np.zeros(self.ps.shape[1]), np.zeros(self.ps.shape[1], np.int64)
        for p in (self.ps[i:i + TASK_ROWS] for i in range(0, len(self.ps), TASK_ROWS)):
            dtp += np.nansum(np.maximum(p, 0.0), axis=0)
            dn += (~np.isnan(p)).sum(axis=0)
        return self._listed(dtp, dn, dn > 0)

    def changes(self, selected: list, added: tuple[int, int]) -> list:
        """``gain_changes`` of a config added after ``selected``; the best precisions go on to those after it."""
        j, t = added
        top: dict[int, int] = {}
        for a, b in selected:
            top[a] = max(b, top.get(a, -1))
        p1, l1 = self.ps[:, j * self.nt + t], self.ls[:, j]
        met = ~np.isnan(p1)
        known = np.zeros(len(met), bool)
        for a, b in top.items():
            known |= ~np.isnan(self.ps[:, a * self.nt + b]) & (self.ls[:, a] == l1) & (l1 >= 0)
        fresh, better = met & ~known, met & (np.where(met, p1, 0.0) > self.best)
        dtp, dn = np.zeros(self.ps.shape[1]), np.zeros(self.ps.shape[1], np.int64)
        rows = np.flatnonzero(better)
        for at in (rows[i:i + TASK_ROWS] for i in range(0, len(rows), TASK_ROWS)):
            p, old, new = self.ps[at], self.best[at, None], p1[at, None]
            dtp += np.nansum(np.maximum(p - new, 0.0) - np.maximum(p - old, 0.0), axis=0)
        rows = np.flatnonzero(fresh)
        for at in (rows[i:i + TASK_ROWS] for i in range(0, len(rows), TASK_ROWS)):
            same = (self.ls[at] == l1[at, None]) & (l1[at, None] >= 0)
            dn -= (np.repeat(same, self.nt, axis=1) & ~np.isnan(self.ps[at])).sum(axis=0)
        self.best[better] = p1[better]
        return self._listed(dtp, dn, (dtp != 0) | (dn != 0))


def _search_task(nt: int, target: float, patience: float):
    """The whole search of the records of one ``w``, as a row (w, result in JSON); none where no config has a record."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ls, ps = (pa.concat_arrays([c.flatten() for c in rows[x].chunks]) for x in ("ls", "ps"))
        held = _Records(ls, ps, len(rows), nt)
        gains = {(j, t): (dtp, dn) for _, j, t, dtp, dn in held.gains()}
        found = _advance({0: gains} if gains else {}, lambda before, added: held.changes(before[0], added[0]), target, patience)
        return pa.table({"w": pa.array([key[0].as_py()] * len(found), pa.int32()),
                         "found": pa.array([json.dumps(asdict(r)) for r in found.values()], pa.string())})
    return run


def matched(G: DataFrame, configs: dict[int, list]) -> dict[int, int]:
    """Records with a proposal from the configs of their search, by search, in one job."""
    G = densify(G)
    nt = _nt(G)
    sel = _by_search({w: [j * nt + t for j, t in c] for w, c in configs.items()})
    return {r["w"]: r["n"] for r in G.where(f"exists({sel}, c -> element_at(ps, c + 1) IS NOT NULL)").groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def resolve_matches(G: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """Per r the l of the config with the highest local precision, earliest
    config on ties: ``(id_l, id_r, p)``."""
    G = densify(G)
    nt = _nt(G)
    sel = _sel_literal(configs, nt)
    cand = F.filter(F.transform(sel, lambda s: F.struct(
        _p_at(s).alias("p"), (-s["k"]).alias("nk"), _l_at(s).alias("l"))),
        lambda x: x["p"].isNotNull())
    best = F.array_max(cand)
    return (G.select("id_r", best.alias("b")).where(F.col("b").isNotNull())
            .select(F.col("b.l").alias("id_l"), "id_r", F.col("b.p").alias("p")))


def materialize_G(G: DataFrame, checkpoint: bool = True, nj: int | None = None,
                  nt: int | None = None) -> DataFrame:
    """Dense G, persisted, lineage cut once (reliable checkpoint), in partitions of about ``PART_BYTES``.

    A table that fits one partition is summed without a shuffle in every step."""
    G = densify(G, nj, nt)
    if checkpoint:
        G = reliable_checkpoint(G.repartition("w", "id_r"))
    g = G.persist(StorageLevel.MEMORY_AND_DISK)
    rows = g.count()
    n_t, n_j = (nt, nj) if nt and nj else _dims(g)
    return g.coalesce(max(1, -(-rows * n_j * n_t * 8 // PART_BYTES)))
