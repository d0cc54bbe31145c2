"""Lineage cuts and distributed ranks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a temporary folder serves a local master, as in tests; on
    a cluster executors would each write to their own disk, so it is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its place from 0 in a total order, without a sort in one task.

    Rows are dealt out by ranges and sorted within partitions; a row's place is
    its number in its partition plus the rows of the partitions before.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mask = (1 << 33) - 1
    numbered = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit(mask))}))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row a partition, so broadcast.
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start", "_n")
