"""A stream of event files gives what the same rows give as a table."""

from pyspark.sql import functions as F

from panelspark.plans import fixtures as fx
from panelspark.streaming.events import cluster_buys


def test_stream_equals_batch(spark, tmp_path):
    rows = fx.purchases(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("filed").cast("timestamp")).orderBy("ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = cluster_buys(stream, "ts", "90 days", "10 days", 2).writeStream.format("memory").queryName("clusters").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.window.start, r.asset, r.n_buyers, round(r.value, 2))
    got = sorted(map(key, spark.table("clusters").collect()))
    assert got and got == sorted(map(key, cluster_buys(table, "ts", "90 days", "10 days", 2).collect()))
