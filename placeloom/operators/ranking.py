"""Numbering rows of a whole table in order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.operators.store import materialize


def numbered(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... by ``order`` (long).

    Rows are dealt out by ranges of the order, numbered within their range, and moved up by the
    sizes of the ranges before; only those sizes, one for each range, meet in a window.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__own", own).join(offsets, "__range").withColumn(name, (F.col("__own") + F.col("__offset")).cast("long")).drop("__range", "__own", "__offset")
