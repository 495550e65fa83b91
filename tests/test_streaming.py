"""Streaming operators over a folder of files."""

from datetime import datetime

from pyspark.sql import functions as F

from fenwright.sources.tables import tail
from fenwright.streaming import live


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_downsample_leaves_late_samples_out(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    for i, rows in enumerate([[("k", at(0), 1.0), ("k", at(3), 2.0)], [("k", at(30), 9.0)], [("k", at(40), 9.0)], [("k", at(1), 50.0), ("k", at(50), 1.0)]]):
        spark.createDataFrame(rows, "key string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    s = tail(spark, str(tmp_path / "in"), "key string, ts timestamp, value double", 1)
    out = run(live.downsample(s, F.sum("value"), "10 minutes", "5 minutes"), spark, "buckets")
    assert [r.value for r in out.orderBy("bucket").collect()][0] == 3.0  # the sample of minute 1 comes two batches after minute 30, whose watermark holds for late rows from then on


def test_rate_limit(spark, tmp_path):
    spark.createDataFrame([("u", 0), ("u", 1), ("u", 2), ("u", 1002)], "key string, ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = tail(spark, str(tmp_path / "in"), "key string, ms long")
    out = run(live.rate_limit(s, 2, 1), spark, "limits")
    assert [r.allowed for r in out.orderBy("ms").collect()] == [True, True, False, True]


def test_consumer_group(spark, tmp_path):
    spark.createDataFrame([("g", "add", 1, 0), ("g", "add", 2, 0), ("g", "ack", 1, 0)], "key string, kind string, ms long, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = tail(spark, str(tmp_path / "in"), "key string, kind string, ms long, seq long")
    assert run(live.consumer_group(s), spark, "pend", "update").first().pending == 1
