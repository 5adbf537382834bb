"""Shared helpers: scratch tables in the cluster's shared folder, words, empty inputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five ASCII controls from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``; what is there is deleted when the driver ends.

    Only where the setting is absent on a single machine (master local, as in tests) a temporary
    folder is used; the choice is kept in the session, so all scratch tables of a session lie
    together.  On a cluster an absent setting is an error: executors see no folder of the driver.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("placeloom.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="placeloom-")
        spark.conf.set("placeloom.scratch", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The written table cuts the lineage, survives lost executors, and has a size that the
    planner knows: a later join broadcasts it only if it is under the session's threshold.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(df: DataFrame, rows: int = 2500) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows for what follows in its session.

    Whole texts are kilobytes each; the default of 10,000 rows would hold tens of megabytes
    several times over in each worker.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder, read by Spark; only ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
