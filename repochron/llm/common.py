"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.session import write_through

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's own reader (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (lineage ends)."""
    return write_through(df, name)


def text_bytes(column) -> list[bytes]:
    """Values of an Arrow string or binary column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [v if v is not None else b"" for v in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values (bijective)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def connected(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Connected components of an undirected graph, by alternating large and small stars.

    ``edges``: columns ``u``, ``v`` (long). Returns ``node``, ``root`` for every node that
    is not the smallest of its component. Each round is a shuffled aggregation (minimum
    per node, combined before the shuffle) and an equi-join; rounds grow with the
    logarithm of the longest path. Rounds are written to the shared folder, so a lost
    executor repeats one round at most. Runs until nothing changes (``max_rounds`` is for
    tests of the loop only and raises when exceeded). Null ends and self links are no links.
    """
    def canon(x, y):
        return F.greatest(x, y).alias("u"), F.least(x, y).alias("v")

    def fingerprint(df):
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)).alias("h")).first()
        return r["n"], r["h"]

    cur = cut(edges.where("u is not null and v is not null and u <> v")
              .select(*canon(F.col("u"), F.col("v"))).distinct(), "cc")
    state, rounds = fingerprint(cur), 0
    while state[0]:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .select(*canon(F.col("u"), F.col("v"))).where("u <> v").distinct())
        cur = cut(small, "cc")
        new, rounds = fingerprint(cur), rounds + 1
        if new == state:
            break
        state = new
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
