"""Loads of the clusters of a fixed partition, kept up to date from a stream of events on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import cluster_at


def cluster_loads(events: DataFrame, rows: int, cols: int, k: int, method: str, window: str = "1 hour", late: str = "10 minutes", seed: int = 42) -> DataFrame:
    """(window, cluster_id, load) of events (ts, row, col) by closed-form clusters.

    The cluster is an expression of the event's cell, so the only state is one
    count a window and cluster; events later than ``late`` are dropped by the
    watermark.  Works on a stream and on a table.
    """
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cluster_id", cluster_at(method, rows, cols, k, seed, "cast(row as bigint)", "cast(col as bigint)"))
    return marked.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "cluster_id").agg(F.count("*").alias("load"))
