"""Records brought to candidate pairs over a grid of cells.

Two plain joins of pairs to their records shuffle one whole record a pair.
Here each record goes to a row or a column of a grid of cells instead, each
pair to the one cell where its two records meet, and both are attached there
by windows that need no further shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# R records squared by a row and a column of cells: cells grow with R, so that a cell's pairs with their records do not.
CELL_RECORDS = 16_384
# Small inputs are cut in up to SPREAD rows and columns of at least SPREAD_LEAST records, so that they use all cores.
SPREAD, SPREAD_LEAST = 3, 256


def attach_records(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (id_l, id_r, …) with ``l`` and ``r``: the other columns of ``left`` and ``right`` by ``id``, as structs.

    An inner join on both ids: pairs without a record go, and records that
    repeat an id give a row each.  A record is copied once for each row or
    column of cells, of which there are as many as the root of R's size; a
    column ``side`` of the records must be constant."""
    n = right.count()
    cut = max(math.ceil(math.sqrt(n / CELL_RECORDS)), min(SPREAD, n // SPREAD_LEAST), 1)
    number = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(cut)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(cut - 1)))

    def records(df, name):
        keys = [c for c in ("side", "id") if c in df.columns]
        fields = [c for c in df.columns if c not in keys]
        return df.where("id IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias(name)).select("id", name)

    lrec, rrec = records(left, "l"), records(right, "r")
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    more = [c for c in pairs.columns if c not in ("id_l", "id_r")]
    none = [null(pairs, c) for c in more]
    # own keeps R's records apart from each other while those of L are attached
    rows = (lrec.select(number("id").alias("row"), each.alias("column"), "id", "l")
            .select("row", "column", F.lit(1).alias("rec"), F.col("id").alias("id_l"), null(pairs, "id_r"), null(pairs, "id_r").alias("own"),
                    "l", null(rrec, "r"), *none))
    columns = (rrec.select(each.alias("row"), number("id").alias("column"), "id", "r")
               .select("row", "column", F.lit(1).alias("rec"), null(pairs, "id_l"), F.col("id").alias("id_r"), F.col("id").alias("own"),
                       null(lrec, "l"), "r", *none))
    met = (pairs.where("id_l IS NOT NULL AND id_r IS NOT NULL")
           .select(number("id_l").alias("row"), number("id_r").alias("column"), F.lit(0).alias("rec"), "id_l", "id_r", null(pairs, "id_r").alias("own"),
                   null(lrec, "l"), null(rrec, "r"), *more))
    cell = (rows.unionByName(columns).unionByName(met).withColumn("cell", F.col("row") * cut + F.col("column")).drop("row", "column")
            .repartitionById(cut * cut, "cell"))
    upto = lambda *by: (Window.partitionBy("cell", *by).orderBy(F.col("rec").desc())
                        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cell = cell.withColumn("l", F.first("l", ignorenulls=True).over(upto("id_l", "own"))).where("id_r IS NOT NULL").drop("own")
    cell = cell.withColumn("r", F.first("r", ignorenulls=True).over(upto("id_r"))).where("rec = 0 AND l IS NOT NULL AND r IS NOT NULL")
    return cell.select("id_l", "id_r", *more, F.explode("l").alias("l"), "r").withColumn("r", F.explode("r"))
