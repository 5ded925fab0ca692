"""What a learned join needs of L, computed once and kept as tables.

``build`` blocks L against itself, learns its rules and measures its density
under the model's functions and thresholds.  ``HeldReference`` reads the tables
back; a prediction then blocks, profiles and measures the records of R alone.

The tables that are joined by a unique key (rows, records, token weights, ball
counts) are bucketed by it, so a prediction does not shuffle them.  The
postings are not: one token may be held by a large part of L, and a bucket
cannot be split.  They are laid out in ranges of (token, id), and a prediction
reads those of R's tokens.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzyspark.operators import blocking as B
from fuzzyspark.operators import precision as P
from fuzzyspark.operators import rules as NR
from fuzzyspark.operators.pairs import PairSpace, to_long
from fuzzyspark.session import reliable_checkpoint

BUCKET_KEYS = {"records": ("id",), "vocab": ("key", "token"), "balls": ("jf", "proxy")}


def _table_name(path: str, name: str) -> str:
    return f"fuzzyspark_{hashlib.md5(path.encode()).hexdigest()}_{name}"


def _write_bucketed(df: DataFrame, path: str, name: str, keys, buckets: int):
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", f"{path}/{name}").format("parquet").saveAsTable(_table_name(path, name)))


def _read_bucketed(spark: SparkSession, path: str, name: str, keys, buckets: int) -> DataFrame:
    """The table of ``path``, its buckets made known to this session's catalog."""
    table = _table_name(path, name)
    if not spark.catalog.tableExists(table):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
    return spark.table(table)


@dataclass
class HeldReference:
    """L as a model sees it; all tables lie under ``path``."""
    path: str
    meta: dict
    rows: DataFrame               # L as given
    records: DataFrame            # (side, id, texts, profiles, toks)
    balls: DataFrame              # (jf, proxy, cum)
    rules: DataFrame              # (a, b)
    vocab: DataFrame | None       # (key, token, code); None where no function compares tokens
    postings: DataFrame | None    # (token, id_l, w or its factors tf and idf, df); None for a blocker other than the token blocker

    @property
    def n_left(self) -> int:
        return self.meta["n_left"]

    @staticmethod
    def load(spark: SparkSession, path: str) -> "HeldReference":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        bucketed = lambda name, keys: _read_bucketed(spark, path, name, keys, meta["buckets"])
        return HeldReference(
            path, meta, bucketed("rows", (meta["id_column"],)), bucketed("records", BUCKET_KEYS["records"]),
            bucketed("balls", BUCKET_KEYS["balls"]), spark.read.parquet(f"{path}/rules"),
            bucketed("vocab", BUCKET_KEYS["vocab"]) if meta["vocab"] else None,
            spark.read.parquet(f"{path}/postings") if meta["postings"] else None)

    def forget(self, spark: SparkSession):
        """Take the tables out of the session's catalog; the files stay."""
        for name in ("rows", "records", "balls", "vocab"):
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(self.path, name)}")

    def block(self, blocker, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(LR candidates, word sets of R): no pair of L is looked at."""
        id_col, cols = self.meta["id_column"], self.meta["on"]
        if not isinstance(blocker, B.TokenBlocker):
            return blocker.block(self.rows, right, id_col, cols), NR.token_sets(right, id_col, cols, self.meta["stem"])
        rnorm = B.normalize_records(right, id_col, cols, blocker.stem)
        lr = B.block_normalized(None, rnorm, self.n_left, blocker.num_candidates, blocker.weighting, blocker.salt_rows,
                                postings=B.postings_of(self.postings, rnorm))
        return lr, NR.word_sets(rnorm)


def build(path: str, left: DataFrame, id_col: str, cols: list[str], jfs: list, blocker, stem: bool,
          weights: list[float], thresholds: dict[str, list[float]], rules: DataFrame | None,
          null_fill: dict | None = None, buckets: int | None = None) -> HeldReference:
    """Write the tables of L for a model under ``path`` and read them back.

    ``null_fill`` {function: {column: distance}} stands for null LR distances
    (a fit gives the maxima of its pairs); without it the maxima of L's own
    pairs do, or 1.0.  Either way no prediction depends on the records that
    happen to be predicted together."""
    spark = left.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    token = isinstance(blocker, B.TokenBlocker)
    if token:
        lnorm = reliable_checkpoint(B.normalize_records(left, id_col, cols, blocker.stem))
        n_left, lsets = lnorm.count(), NR.word_sets(lnorm)
        post = B.left_postings(lnorm, n_left, blocker.weighting)
        # where its factors are kept, the weight is not
        ((post.drop("w") if "idf" in post.columns else post).repartitionByRange("token", "id_l")
         .sortWithinPartitions("token", "id_l").write.mode("overwrite").parquet(f"{path}/postings"))
        post = spark.read.parquet(f"{path}/postings")
        ll = B.block_normalized(lnorm, lnorm, n_left, blocker.num_candidates, blocker.weighting, blocker.salt_rows, postings=post)
        ll = ll.where(F.col("id_l") != F.col("id_r"))
    else:
        n_left, lsets = left.count(), NR.token_sets(left, id_col, cols, stem)
        ll = B.block_self(blocker, left, id_col, cols)
    ll = reliable_checkpoint(ll)
    NR.merge(rules, NR.learn(ll, lsets)).write.mode("overwrite").parquet(f"{path}/rules")
    ps = PairSpace(left, None, id_col, cols, jfs, stem)
    wide = ps.pair_distances(ll, None, cut=reliable_checkpoint)
    long = to_long(wide, ps)
    fill = null_fill or {r["jf"]: {c: r[f"d_{i}"] for i, c in enumerate(cols)} for r in maxima(long, len(cols))}
    dist = P.weighted(long, len(cols), weights)
    _write_bucketed(P.ball_counts(dist, None, P.threshold_table(spark, thresholds)), path, "balls", BUCKET_KEYS["balls"], buckets)
    _write_bucketed(ps.records.join(lsets, "id", "left"), path, "records", BUCKET_KEYS["records"], buckets)
    if ps.vocab is not None:
        _write_bucketed(ps.vocab, path, "vocab", BUCKET_KEYS["vocab"], buckets)
    ps.unpersist()
    _write_bucketed(left, path, "rows", (id_col,), buckets)
    meta = {"id_column": id_col, "on": cols, "stem": stem, "n_left": n_left, "buckets": buckets, "vocab": ps.vocab is not None,
            "postings": token, "null_fill": fill, "functions": [j.name for j in jfs], "weights": weights,
            "thresholds": thresholds}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
    return HeldReference.load(spark, path)


def maxima(long: DataFrame, ncols: int) -> list:
    """Rows (jf, d_0, d_1 …): the largest distances, one row per function."""
    return long.groupBy("jf").agg(*[F.max(f"d_{i}").alias(f"d_{i}") for i in range(ncols)]).collect()
