"""Session helpers: one place for the Spark settings the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import SparkSession

# Tables of reliable_checkpoint that are there, with their sessions.
_CUTS: dict[str, SparkSession] = {}
# Those of the scratch block that is open, if any.
_OPEN = contextvars.ContextVar("open", default=None)

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fuzzyspark", **conf) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    Partition counts and memory are left to the cluster's configuration;
    they are set here only for local runs (or when given explicitly)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    settings = dict(_DEFAULTS)
    local = bool(master) and master.startswith("local")
    if shuffle_partitions is not None or local:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    if local:
        settings["spark.driver.memory"] = "16g"
    settings.update({k.replace("_", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used where it is set.
    Where it is unset, a local master (tests) gets a private folder; on a
    cluster there is no folder that all executors share, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="fuzzyspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def dealt(df, *keys):
    """``df`` dealt out by ``keys`` in as many partitions as shuffles have.

    The number is given, so that small records whose tokens are many more rows are not put together in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def reliable_checkpoint(df):
    """Cut lineage by a table in the shared folder, which outlives the executors that wrote it.

    Like ``checkpoint()``, but computed once, and in compressed columns: rows of pairs
    that a checkpoint holds as they are in memory take a fraction of its disk.  The table
    goes when the driver ends, or with the ``scratch`` block that it was made in."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _CUTS[path] = spark
    if _OPEN.get() is not None:
        _OPEN.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch():
    """Delete the tables that ``reliable_checkpoint`` makes inside, once no result there is read any more."""
    made = []
    token = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(token)
        _drop(made)


def _drop(paths):
    for path in paths:
        sc = _CUTS.pop(path).sparkContext
        with contextlib.suppress(Exception):  # the session may have been stopped
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep():
    _drop(list(_CUTS))
