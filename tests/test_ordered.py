"""The bucketed ordered scan equals plain per-key windows, whatever the bucket width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from repochron.operators.ordered import ordered_scan


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_ordered_scan_matches_windows(spark, width):
    rnd = random.Random(width)
    rows = []
    for k in range(5):
        t = 0
        for i in range(rnd.choice([1, 2, 30, 120])):
            t += rnd.choice([0, 1, 3, 20])
            rows.append((f"k{k}", t, f"h{i:04d}", rnd.randint(-5, 9)))
    df = spark.createDataFrame(rows, "k string, t long, h string, v long")
    got = ordered_scan(df, ["k"], ["t", "h"], F.floor(F.col("t") / width).cast("bigint"),
                       sums={"s": F.col("v")}, maxes={"m": F.col("v")},
                       lags={"p": F.col("h")}, leads={"n": F.col("v")}, index="i")
    w = Window.partitionBy("k").orderBy("t", "h")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "h", F.sum("v").over(run).alias("s"), F.max("v").over(run).alias("m"),
                     F.lag("h").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                     (F.row_number().over(w) - 1).alias("i"))
    cols = ["k", "h", "s", "m", "p", "n", "i"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_hot_key_is_split_across_tasks(spark):
    # One repository holds a third of all rows; its window work must not land in one task.
    rows = [("hot", d * 86400 + i, f"h{d}-{i}", 1) for d in range(60) for i in range(50)]
    rows += [(f"r{k}", d * 86400 + i, f"c{d}-{i}", 1) for k in range(40) for d in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t long, h string, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered_scan(df, ["k"], ["t", "h"], F.floor(F.col("t") / 86400).cast("bigint"),
                           sums={"s": F.col("v")}, index="i")
        hot = out.filter(F.col("k") == "hot").select(F.spark_partition_id().alias("p"), "s", "i")
        parts = {r["p"] for r in hot.collect()}
        assert len(parts) >= 3
        assert hot.agg(F.max("s")).collect()[0][0] == 3000 and hot.agg(F.max("i")).collect()[0][0] == 2999
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_written_tables_can_be_dropped(spark):
    import os

    from repochron.session import drop_written, write_through
    df = write_through(spark.range(5), "probe")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and drop_written(spark) >= 1 and not os.path.exists(folder)
    assert drop_written(spark) == 0
