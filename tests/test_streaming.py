"""A stream of events gives the same loads as the table."""

import pytest
from pyspark.sql import functions as F

from cellweave.streaming.loads import cluster_loads

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("method", ["grid", "honeycomb"])
def test_stream_equals_table(spark, method):
    def cells(df):
        return df.select("ts", (F.col("user_id") % 30).alias("row"), F.hour("ts").alias("col"))

    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    name = f"loads_{method}"
    q = cluster_loads(cells(stream), 30, 24, 6, method).writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        got = sorted(map(str, spark.table(name).collect()))
    finally:
        q.stop()
    assert got == sorted(map(str, cluster_loads(cells(table), 30, 24, 6, method).collect())) and got
