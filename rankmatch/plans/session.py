"""Durable intermediate results and dense indices."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder; a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def dense_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """``df`` with positions 0, 1, ... in the given order, without bringing all rows to one task.

    Rows are range-partitioned and numbered in their partitions; the partitions' counts, a row each, give the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__base") + own - 1).drop("__part", "__base")  # a row per partition
