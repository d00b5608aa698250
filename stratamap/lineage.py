"""Cutting the lineage of iterative plans in storage that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; in one of our own only where it names none and runs in one
    process, as executors of a cluster would not find it."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not at and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="stratamap-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers rows from 1 by a column without ties, and cuts the lineage: rows are range partitioned and checkpointed, and a
    partition's numbers follow those of the partitions before it."""
    at = cut(df.repartitionByRange(order).sortWithinPartitions(order)).withColumn("_p", F.spark_partition_id())
    # One row per partition.
    before = at.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    mine = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return at.withColumn("_r", mine).join(F.broadcast(before), "_p").withColumn(name, (F.col("_o") + F.col("_r")).cast("long")).drop("_p", "_r", "_o")
