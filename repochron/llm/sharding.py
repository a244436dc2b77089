"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Every row gets a dense global number; a Feistel network over ``a x b >= n`` numbers
(modular halves, so that at most ``a - 1`` numbers lie outside) permutes it, and cycle
walking brings results back below ``n``. The permuted number gives the place: shard is
``p mod shards``, slot is ``p div shards``, both computable from the number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repochron.llm.common import table

ROUNDS = 6
BUCKETS = 8192
WALK = 64


def _half(value: Column, key: int, radix: Column) -> Column:
    return F.pmod(F.xxhash64(value.cast("long"), F.lit(key).cast("long")), radix)


def _network(x: Column, a: Column, b: Column, seed: int) -> Column:
    """The permutation of 0 .. a*b-1 as one expression."""
    left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
    for k in range(0, ROUNDS, 2):
        left = F.pmod(left + _half(right, seed + k, a), a)
        right = F.pmod(right + _half(left, seed + k + 1, b), b)
    return left * b + right


def global_rows(df: DataFrame, keys: list[str], out: str = "_row") -> DataFrame:
    """Add a dense number from 0 (``out``) and the number of rows (``_n``).

    Rows are dealt into hash buckets of all ``keys``; bucket offsets are running sums of
    at most ``BUCKETS`` counts (a table of proven size, broadcast), and rows are numbered
    inside their bucket in key order. The result depends on the rows alone, not on files
    or partitions. Rows that agree in all keys are interchangeable.
    """
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_start"),
                          F.sum("_size").over(Window.orderBy(F.lit(1)).rowsBetween(
                              Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    return (rows.withColumn("_k", F.row_number().over(inside))
            .join(F.broadcast(starts), "_bucket")
            .withColumn(out, F.col("_start") + F.col("_k") - 1)
            .drop("_bucket", "_start", "_k"))


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 20240229, id_col: str = "doc_id",
               text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Deal all rows of ``df`` into ``shards`` shards in a reproducible random order.

    Returns ``id_col``, ``size`` (UTF-8 bytes of the text, none for null, plus 1),
    ``text_crc32`` (of the UTF-8 bytes; null text counts as empty), ``law`` = ``rows`` (shard
    counts differ by one at most), ``shard``, ``slot`` (gapless from 0 in each shard),
    ``grown_shard`` (always null: only a law by key defines it), ``global_row`` and the columns
    named in ``keep``. The place depends on (id, size, crc32) of all rows, ``shards`` and
    ``seed``. Null ids count as a value of their own; repeated rows each get a place and may
    swap places with each other; an empty table gives no rows; other columns of the input
    are ignored, so their names cannot clash (``keep`` must not name an output column).
    """
    keep = list(keep or [])
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = df.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("_bytes"),
                       F.crc32(text).alias("_crc"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = global_rows(narrow, ["_id", "_bytes", "_crc"])
    n, a, b = F.col("_n"), F.col("_a"), F.col("_b")
    rows = (rows.withColumn("_a", F.ceil(F.sqrt(n.cast("double"))).cast("long"))
            .withColumn("_b", F.ceil(n / F.col("_a")).cast("long"))
            .withColumn("_p", _network(F.col("_row"), a, b, seed)))
    walk = F.aggregate(F.sequence(F.lit(1), F.least(a * b - n + 1, F.lit(WALK).cast("long")).cast("int")),
                       F.col("_p"), lambda p, _: F.when(p < n, p).otherwise(_network(p, a, b, seed)))
    rows = rows.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(walk))
    place = F.when(F.col("_p") < n, F.col("_p")).otherwise(
        F.raise_error(F.lit("cycle walk did not return")).cast("long"))
    rows = rows.withColumn("_p", place)
    return rows.select(F.col("_id").alias(id_col), F.col("_bytes").alias("size"),
                       F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
                       F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
                       F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"),
                       F.col("_row").alias("global_row"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards."""
    return shard_rows(table(spark, sf_dir, "documents")).drop("global_row")
