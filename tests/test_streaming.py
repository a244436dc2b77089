"""Streaming bursts agree with the batch burst operator."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from repochron.operators import cycles as cyc
from repochron.streaming.bursts import stream_bursts


def test_stream_bursts_match_batch(spark):
    base = dt.datetime(2024, 1, 1)
    gaps = [0, 3600, 86400, 86399.5, 86400, 10, 200000, 86399.999999]
    rows, t = [], base
    for i, g in enumerate(gaps):
        t = t + dt.timedelta(seconds=g)
        rows.append(("o", "r", f"h{i}", t))
    path = tempfile.mkdtemp(prefix="repochron-stream-")
    spark.createDataFrame(rows, "owner string, repo string, hash string, committed_at timestamp") \
        .write.mode("overwrite").parquet(path + "/in")
    src = spark.readStream.schema("owner string, repo string, hash string, committed_at timestamp") \
        .parquet(path + "/in")
    q = (stream_bursts(src).writeStream.outputMode("complete").format("memory")
         .queryName("bursts_test").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(r["n_commits"] for r in spark.sql("select * from bursts_test").collect())
    batch = spark.createDataFrame(rows, "owner string, repo string, hash string, committed_at timestamp") \
        .withColumn("committer_epoch", F.unix_micros("committed_at") / 1e6)
    b = cyc.commit_bursts(batch).groupBy("burst_no").count().collect()
    assert got == sorted(r["count"] for r in b)
