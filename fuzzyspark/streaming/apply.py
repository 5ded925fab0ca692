"""Apply a learned join to a stream of query records.

A learned model is stateless per query record, so each micro-batch of R is
joined against the static reference table with
:func:`fuzzyspark.operators.model.predict` inside ``foreachBatch``.  What the
model needs of that table is computed once, before the first batch, and no
value depends on the records of a batch, so the batching does not matter.  Exactly-once output comes from the sink's idempotent
overwrite of the batch's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzyspark.operators import model as M
from fuzzyspark.operators.reference import HeldReference
from fuzzyspark.session import scratch


def start(model: M.FuzzyJoinModel, left: DataFrame | HeldReference, stream: DataFrame, id_col: str, out_path: str,
          checkpoint_location: str, trigger_seconds: int | None = 60):
    """Start the query; ``trigger_seconds=None`` processes what is
    available and stops (``availableNow``).  ``left`` may be held already."""
    if model.configs and not isinstance(left, HeldReference):
        left = M.hold(model, left, id_col)

    def run_batch(batch: DataFrame, batch_id: int):
        if batch.isEmpty():
            return
        with scratch():
            res = M.predict(model, left, batch, id_col).withColumn("batch_id", F.lit(batch_id))
            (res.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(out_path))

    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if trigger_seconds is None else \
        w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
