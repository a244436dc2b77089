"""Keyed upsert, key-by with last-wins, incremental reruns.

"Later row wins" is ``max_by(row, load order)`` per key: a partial aggregation,
so a key repeated a billion times is reduced map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.operators.summary import allow_list

# Attributes the repository upsert sets.
UPSERT_ATTRIBUTES = ("name", "full_name", "html_url", "description", "stargazers_count", "forks_count")


def key_by_last(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order`` (the list position of the reference).
    Rows with a null key are dropped (the reference would key them under None)."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    ordkey = F.struct(*[F.col(c) for c in order])
    agg = df.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in others]), ordkey).alias("__last"))
    return agg.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others])


def upsert(existing: DataFrame | None, incoming: DataFrame, key: str = "id",
           order: str = "load_order", attributes: Sequence[str] = UPSERT_ATTRIBUTES,
           allowed: DataFrame | None = None, allow_col: str = "full_name") -> DataFrame:
    """Merge ``incoming`` into ``existing`` on ``key``; later rows win and set
    ``attributes``; incoming rows outside a non-empty allow list are skipped (J04).
    Other columns of an existing row stay as they are (null for a new one).

    Portable form of MERGE (last of the incoming per key, then one outer join); on a
    table format with row-level operations use ``DataFrame.mergeInto`` instead."""
    cols = [key, *attributes, order]
    inc = key_by_last(allow_list(incoming, allowed, allow_col).select(*cols), key, [order])
    if existing is None:
        return inc
    new = inc.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in cols[1:]],
                     F.lit(True).alias("__in"))
    both = existing.join(new, F.col(key) == F.col("__key"), "full")
    hit = F.col("__in").isNotNull()
    return both.select(*[F.coalesce(F.col(key), F.col("__key")).alias(c) if c == key
                         else F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                         else F.col(c) for c in existing.columns])


def written_keys(result: DataFrame, key: str = "full_name") -> DataFrame:
    """The keys written (``count()`` of it is the written total)."""
    return result.select(key).distinct()


def overwrite_partitions(df: DataFrame, path: str, partition_cols: Sequence[str],
                         fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).format(fmt).save(path)
