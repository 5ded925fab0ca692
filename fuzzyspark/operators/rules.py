"""Negative rules learned from L itself.

If two L records differ by exactly one token on each side, those two tokens
(e.g. ``2008`` / ``2009``) distinguish different entities; an LR pair whose
token differences contain such a pair is pruned.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzyspark.functions.text import block_normalize, split_by_space
from fuzzyspark.operators.cells import attach_records
from fuzzyspark.session import reliable_checkpoint

# Rules up to this number are broadcast.
RULE_BROADCAST_ROWS = 200_000


def token_sets(df: DataFrame, id_col: str, cols: list[str], stem: bool = True) -> DataFrame:
    """``(id, toks)``: distinct normalised words of each record."""
    return df.select(F.col(id_col).alias("id"),
                     F.array_distinct(split_by_space(block_normalize(cols, stem=stem))).alias("toks"))


def word_sets(norm: DataFrame) -> DataFrame:
    """``(id, toks)`` of records normalised before: ``(id, value)``."""
    return norm.select("id", F.filter(F.array_distinct(F.split("value", " ")), lambda t: t != "").alias("toks"))


def _pair_diffs(pairs: DataFrame, lsets: DataFrame, rsets: DataFrame) -> DataFrame:
    d = attach_records(pairs.select("id_l", "id_r"), lsets.select("id", "toks"), rsets.select("id", "toks"))
    return d.select("id_l", "id_r", F.col("l.toks").alias("tl"),
                    F.array_except("l.toks", "r.toks").alias("dl"),
                    F.array_except("r.toks", "l.toks").alias("dr"))


def learn(ll_pairs: DataFrame, lsets: DataFrame) -> DataFrame:
    """Rules ``(a, b)`` in both orientations from LL candidate pairs."""
    d = (_pair_diffs(ll_pairs, lsets, lsets)
         .where((F.size("dl") == 1) & (F.size("dr") == 1) & (F.size("tl") != 1))
         .select(F.try_element_at("dl", F.lit(1)).alias("a"), F.try_element_at("dr", F.lit(1)).alias("b")))
    return d.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()


def merge(pretrained: DataFrame | None, learned: DataFrame) -> DataFrame:
    """Pre-trained rules plus rules learned on new data (a new relation)."""
    return learned if pretrained is None else pretrained.unionByName(learned).distinct()


def violations(lr_pairs: DataFrame, lsets: DataFrame, rsets: DataFrame,
               rules: DataFrame) -> DataFrame:
    """LR pairs having some (a in l−r, b in r−l) that is a rule."""
    against = rules.groupBy("a").agg(F.collect_set("b").alias("bs")).persist(StorageLevel.MEMORY_AND_DISK)
    # few rules go to the pairs' differences, which are then not shuffled
    if (against.agg(F.sum(F.size("bs"))).first()[0] or 0) <= RULE_BROADCAST_ROWS:
        against = F.broadcast(against)
    d = _pair_diffs(lr_pairs, lsets, rsets)
    return (d.select("id_l", "id_r", F.explode("dl").alias("a"), "dr").join(against, "a")
            .where(F.arrays_overlap("dr", "bs")).select("id_l", "id_r").distinct())


def apply(lr_pairs: DataFrame, lsets: DataFrame, rsets: DataFrame,
          rules: DataFrame) -> DataFrame:
    """Drop the LR pairs that meet a rule.

    The pairs are read twice, to compare their records and to drop what met a
    rule; they are written once, so that they are not found twice."""
    lr_pairs = reliable_checkpoint(lr_pairs)
    bad = violations(lr_pairs, lsets, rsets, rules)
    return lr_pairs.join(bad, ["id_l", "id_r"], "left_anti")
