"""Distances of candidate pairs under a join-function space.

Work is shared the way the space is structured:

1. ``records``: every L and R record once, with the preprocessed string of
   each (preprocess method, column) — the only place the stemmer runs;
   persisted.
2. ``profiles``: one explode over all (group, column) token lists, the
   numbers and frequencies of L's tokens, one regroup → per record a map
   ``key → profile``.  Records are dealt out by id before their tokens are
   made, so the tokens themselves are not shuffled.
3. ``pair_distances``: both records attached to the LL and the LR pairs in
   the cells of a grid, one projection computing every (join function,
   column) distance, nulls filled with the per-(side, function) maximum.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzyspark.functions import distances as D
from fuzzyspark.functions.text import as_text, preprocess, tokenize
from fuzzyspark.operators.cells import attach_records
from fuzzyspark.operators.space import JoinFunction
from fuzzyspark.session import dealt

# L's tokens are broadcast up to this number; beyond it a join by token finds them.
VOCAB_BROADCAST_ROWS = 500_000


def _key(group, ci):
    return f"{group[0]}|{group[1]}|{group[2]}|{ci}"


class PairSpace:
    """Record-level state for one (L, R, columns, join functions) problem.

    ``right`` may be absent (L alone).  With ``held``, a kept state of L, only
    the records of R are prepared, weighed by the tokens of L kept there."""

    def __init__(self, left: DataFrame | None, right: DataFrame | None, id_col: str, cols: list[str],
                 jfs: list, stem: bool = True, persist: bool = True, held=None):
        self.id_col, self.cols, self.jfs, self.stem = id_col, cols, jfs, stem
        self.builtin = [j for j in jfs if isinstance(j, JoinFunction)]
        self.custom = [j for j in jfs if not isinstance(j, JoinFunction)]
        self.pres = sorted({j.preprocess for j in self.builtin})
        self.groups = sorted({j.group for j in self.builtin if j.is_set},
                             key=lambda g: (g[0], g[1], g[2] or ""))
        self.n_left = None
        self.held, self.vocab = held, None
        self._persisted = []
        sides = [self._records(df, side) for df, side in ((None if held else left, "L"), (right, "R")) if df is not None]
        base = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        if persist:
            base = base.persist(StorageLevel.MEMORY_AND_DISK)
        self.base = base
        self.records = self._with_profiles(base)
        if persist:
            self.records = self.records.persist(StorageLevel.MEMORY_AND_DISK)

    def _pcol(self, pre, ci):
        return f"s_{self.pres.index(pre)}_{ci}"

    def _records(self, df: DataFrame, side: str) -> DataFrame:
        sel = [F.lit(side).alias("side"), F.col(self.id_col).alias("id")]
        for ci, c in enumerate(self.cols):
            txt = as_text(c)
            sel.append(F.col(c).alias(f"v_{ci}"))
            for pre in self.pres:
                sel.append(preprocess(txt, pre, self.stem).alias(self._pcol(pre, ci)))
        return df.select(*sel)

    def _with_profiles(self, base: DataFrame) -> DataFrame:
        if not self.groups:
            return base.withColumn("prof", F.create_map().cast(
                "map<string,struct<tk:array<bigint>,dup:map<bigint,int>,n:int,s:double,nrm:double>>"))
        lists = []
        for g in self.groups:
            pre, tok, _ = g
            for ci in range(len(self.cols)):
                toks = tokenize(F.col(self._pcol(pre, ci)), tok)
                lists.append(F.transform(toks, _tagger(_key(g, ci))))
        n_left = self.held.n_left if self.held else base.where(F.col("side") == "L").count()
        self.n_left = n_left
        # from here on a record's rows stay in the partition of its id
        base = dealt(base, "side", "id")
        ex = (base.select("side", "id", F.explode(F.concat(*lists)).alias("kt"))
              .select("side", "id", "kt.key", "kt.token")
              .groupBy("side", "id", "key", "token").agg(F.count(F.lit(1)).cast("int").alias("c")))
        idf_keys = [_key(g, ci) for g in self.groups if g[2] == "idfWeight" for ci in range(len(self.cols))]
        lnN = math.log(n_left) if n_left > 0 else 0.0
        self.vocab = self.held.vocab if self.held else vocabulary(ex.where(F.col("side") == "L"))
        known = self.vocab
        if known.count() <= VOCAB_BROADCAST_ROWS:
            known = F.broadcast(known)
        w = F.when(F.col("key").isin(idf_keys), F.coalesce(D.idf_weight(F.col("code"), n_left), F.lit(lnN))).otherwise(F.lit(1.0))
        ex = ex.join(known, ["key", "token"], "left").select("side", "id", "key", "token", "c", "code", w.alias("w"))
        # Counts above one (rare) go to a small map used by the cosine dot.
        more = (F.col("c") > 1) & F.col("code").isNotNull()
        prof = (ex.groupBy("side", "id", "key").agg(
            F.collect_list("code").alias("tk"),
            F.map_from_entries(F.collect_list(F.when(more, F.struct("code", "c")))).alias("dup"),
            F.count(F.lit(1)).cast("int").alias("n"),
            F.sum("w").alias("s"),
            F.sqrt(F.sum((F.col("w") * F.col("c")) ** 2)).alias("nrm"))
            .groupBy("side", "id").agg(F.map_from_entries(F.collect_list(
                F.struct("key", F.struct("tk", "dup", "n", "s", "nrm")))).alias("prof")))
        return base.join(prof, ["side", "id"], "left")

    # -- pair level ------------------------------------------------------
    def dist_columns(self) -> list[tuple[str, str, int]]:
        """(output column, join function name, column index) triples."""
        out = []
        for fi, jf in enumerate(self.jfs):
            for ci in range(len(self.cols)):
                out.append((f"d{fi}_{ci}", jf.name, ci))
        return out

    def pair_distances(self, ll: DataFrame | None, lr: DataFrame | None,
                       fill: bool = True, null_fill: dict | None = None, cut=None) -> DataFrame:
        """Wide table ``(side, id_l, id_r, d{f}_{c}…)`` for LL ∪ LR pairs.

        ``null_fill`` {function: {column: distance}} stands for null LR
        distances in place of the maxima of the pairs at hand.  ``cut`` keeps
        the distances while the maxima are found (a persist by default); the
        result reads what it returns."""
        # Stage 1: each record's profile for every (group, column) is looked
        # up once, before the records are attached to the pairs; stage 2: pair
        # stats (the token intersection) once per (group, column); stage 3:
        # every distance as arithmetic on those.
        # Separate projections keep Catalyst from re-inlining the shared
        # non-cheap expressions into each distance.
        keys = sorted({(_key(jf.group, ci), jf.group, ci) for jf in self.builtin if jf.is_set
                       for ci in range(len(self.cols))})
        kix = {k: i for i, (k, _, _) in enumerate(keys)}
        strs = sorted({self._pcol(jf.preprocess, ci) for jf in self.builtin if not jf.is_set
                       for ci in range(len(self.cols))})
        fields = [F.try_element_at("prof", F.lit(k)).alias(f"p{i}") for k, i in kix.items()] + [F.col(c) for c in strs]
        if self.custom:
            fields += [F.col(f"v_{ci}") for ci in range(len(self.cols))]
        names = [f"p{i}" for i in kix.values()] + strs + ([f"v_{ci}" for ci in range(len(self.cols))] if self.custom else [])
        of = lambda recs, side: recs.where(F.col("side") == side).select("side", "id", *fields)
        lrec = of(self.held.records if self.held else self.records, "L")
        parts = []
        for side, pairs, right in (("LL", ll, "L"), ("LR", lr, "R")):
            if pairs is None:
                continue
            pairs = pairs.select("id_l", "id_r")
            # of a kept L, only the records that the pairs name are moved
            mine = lrec.join(pairs.select(F.col("id_l").alias("id")).distinct(), "id", "left_semi") if self.held else lrec
            parts.append(attach_records(pairs, mine, of(self.records, right)).select(F.lit(side).alias("side"), "*"))
        j = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        alias = lambda x, c: ("p" + x + c[1:]) if c.startswith("p") else f"{x}_{c}"
        s1 = j.select("side", "id_l", "id_r", *[F.col(f"{x}.{c}").alias(alias(x, c)) for c in names for x in "lr"])
        keep = [c for c in s1.columns]
        cos_keys = {kix[_key(jf.group, ci)] for jf in self.builtin if jf.is_set and "osine" in jf.distance
                    for ci in range(len(self.cols))}
        s2 = s1.select(*keep, *[D.pair_stats(F.col(f"pl{i}"), F.col(f"pr{i}"), i in cos_keys,
                                             self.n_left if group[2] == "idfWeight" else None).alias(f"st{i}")
                               for i, (_, group, _) in enumerate(keys)])
        out = [F.col("side"), F.col("id_l"), F.col("id_r")]
        for name, _, ci in self.dist_columns():
            jf = self._jf(name)
            if not isinstance(jf, JoinFunction):
                e = jf.distance(F.col(f"l_v_{ci}"), F.col(f"r_v_{ci}")).cast("double")
            elif jf.is_set:
                i = kix[_key(jf.group, ci)]
                e = D.set_distance(jf.distance, F.col(f"pl{i}"), F.col(f"pr{i}"), F.col(f"st{i}"))
            else:
                c = self._pcol(jf.preprocess, ci)
                e = D.char_distance(jf.distance, F.col(f"l_{c}"), F.col(f"r_{c}"))
            out.append(F.round(e, D.DIST_DIGITS).alias(name))
        wide = s2.select(*out)
        if not fill:
            return wide
        given = {c: (null_fill or {}).get(name, {}).get(self.cols[ci]) for c, name, ci in self.dist_columns()}
        if ll is None and None not in given.values():
            return wide.select("side", "id_l", "id_r", *[F.coalesce(F.col(c), F.lit(float(v))).alias(c) for c, v in given.items()])
        # the fill needs two passes (per-side maxima, then coalesce), over
        # distances that are computed and kept once
        if cut is None:
            wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(wide)
        else:
            wide = self._counted(wide, cut)
        return fill_nulls(wide, given)

    def _counted(self, wide: DataFrame, cut) -> DataFrame:
        """``wide`` after a cut that holds the distances as whole numbers of their last digit, about half as large.

        Built-in distances are rounded to that digit, so the numbers give them back as they were; others are kept as they are."""
        unit, counted = float(10 ** D.DIST_DIGITS), {c for c, _, _ in self.dist_columns() if self._jf(c) in self.builtin}
        each = lambda f: [f(c).alias(c) if c in counted else F.col(c) for c in wide.columns]
        kept = cut(wide.select(*each(lambda c: F.rint(F.col(c) * F.lit(unit)).cast("long"))))  # rint: no decimals are made of it
        return kept.select(*each(lambda c: F.col(c) / F.lit(unit)))

    def _jf(self, column: str):
        return self.jfs[int(column[1:].split("_")[0])]

    def unpersist(self):
        for df in self._persisted:
            df.unpersist()
        self.records.unpersist()
        self.base.unpersist()


def vocabulary(ex: DataFrame) -> DataFrame:
    """``(key, token, code)`` of the tokens ``(id, key, token)`` of L's records, each id's distinct.

    Tokens are numbered in their order, over ranges."""
    from fuzzyspark.operators.validate import global_index  # which imports this module
    df = ex.groupBy("key", "token").agg(F.count(F.lit(1)).alias("df"))
    return global_index(df, ["key", "token"]).select("key", "token", D.token_code(F.col("_idx"), F.col("df")).alias("code"))


def _tagger(key: str):
    return lambda t: F.struct(F.lit(key).alias("key"), t.alias("token"))


def fill_nulls(wide: DataFrame, given: dict) -> DataFrame:
    """Null distance → the value given for the column (LR pairs only), else
    the max of that column within its side (LL or LR); a column that is null
    for a whole side becomes 1.0.  The maxima, a row a side, go through the driver."""
    most = {r["side"]: r for r in wide.groupBy("side").agg(*[F.max(c).alias(c) for c in given]).collect()}
    of = lambda side, v: F.when(F.col("side") == side, F.lit(v).cast("double"))
    return wide.select("side", "id_l", "id_r", *[
        F.coalesce(F.col(c), of("LR", v), *[of(side, r[c]) for side, r in sorted(most.items())], F.lit(1.0)).alias(c)
        for c, v in given.items()])


def to_long(wide: DataFrame, ps: PairSpace) -> DataFrame:
    """``(side, id_l, id_r, jf, d_0, d_1 …)`` one row per pair and function."""
    nc = len(ps.cols)
    items = []
    for fi, jf in enumerate(ps.jfs):
        items.append(F.struct(F.lit(jf.name).alias("jf"),
                              *[F.col(f"d{fi}_{ci}").alias(f"d_{ci}") for ci in range(nc)]))
    return (wide.select("side", "id_l", "id_r", F.explode(F.array(*items)).alias("x"))
            .select("side", "id_l", "id_r", "x.*"))


def featurize(left: DataFrame, right: DataFrame, id_col: str, cols: list[str],
              jfs: list, ll: DataFrame, lr: DataFrame, stem: bool = True) -> DataFrame:
    """Distance features of every LL and LR candidate pair (long form)."""
    ps = PairSpace(left, right, id_col, cols, jfs, stem)
    return to_long(ps.pair_distances(ll, lr), ps)
