"""Helpers shared by the operators: written intermediates, ordering, lookups."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuzzyspark.session import checkpoint_dir

#: a lookup table is broadcast up to this many rows, beyond it the join is salted
BROADCAST_ROWS = 20_000
SALTS = 16
#: monotonically_increasing_id keeps the row's place in its partition below this bit
ROW_BITS = 33
#: sessions by the paths that ``written`` has made and nothing has deleted
_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, in one pass and in columns; the
    files outlive the executors that wrote them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    _WRITTEN[path] = df.sparkSession
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it."""
    path = df.__dict__.get("_written_to")
    if _WRITTEN.pop(path, None) is not None:
        _delete(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    """Delete what ``written`` has left when the driver ends."""
    for path, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):  # the session may have been stopped
            _delete(spark, path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``: whatever its columns are called, no other name can clash with them."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select((F.struct(*quoted) if quoted else F.struct(F.lit(None).alias("none"))).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    """The columns that ``packed`` has put into ``row``."""
    return df.select("row.*")


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative long."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def sql_hash60(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 15) AS BIGINT)"


def lookup(df: DataFrame, small: DataFrame, keys: list[str], spread: Column, n_small: int,
           how: str = "left", n_df: int | None = None) -> DataFrame:
    """Join every row of ``df`` to the one row of ``small`` with its keys (null equals null).

    ``small`` has unique keys and ``n_small`` rows.  Up to ``BROADCAST_ROWS``
    rows it is broadcast; a larger one is repeated ``SALTS`` times and joined
    on the keys and a salt taken from ``spread``, so that a key holding a
    third of ``df`` meets in ``SALTS`` tasks at least.  Where the rows ``n_df`` of
    ``df`` are known, ``small`` is not repeated to more rows than these and its own.
    The join is a merge by hint: Spark counts the rows of the table before it is
    repeated, of packed files, and would send it whole to the driver."""
    right = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                         *[c for c in small.columns if c not in keys])
    salts = SALTS if n_df is None else min(SALTS, max(1, -(-n_df // max(n_small, 1))))
    cond = F.lit(True)
    if n_small <= BROADCAST_ROWS:
        left, right = df, F.broadcast(right)
    elif salts == 1:
        left, right = df, right.hint("merge")
    else:
        left = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        right = right.withColumn("__salt_r", F.explode(F.array(*[F.lit(i) for i in range(salts)]))).hint("merge")
        cond = F.col("__salt") == F.col("__salt_r")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(right, cond, how).drop("__salt", "__salt_r", *[f"__k_{k}" for k in keys])


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str,
             out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 in the given order, without gaps.

    Rows are range-partitioned by group and order, so a group may span many
    tasks; each row keeps its place within its task, and the places where a
    group's rows start in each task are summed up from the (task, group)
    counts.  That table has at most tasks + groups rows."""
    by = [F.col(g).asc_nulls_first() for g in groups] + order
    placed = (df.repartitionByRange(*by).sortWithinPartitions(*by)
              .withColumn("__id", F.monotonically_increasing_id())
              .withColumn("__part", F.shiftright("__id", ROW_BITS).cast("int"))
              .withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("__id"))
    placed = written(placed, name)
    runs = placed.groupBy(*groups, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*groups, "__part", (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first")).alias("__off"))
    joined = lookup(placed, runs, [*groups, "__part"], F.col("__at"), runs.count())
    return joined.withColumn(out, F.col("__at") + F.col("__off")).drop("__part", "__at", "__off")
