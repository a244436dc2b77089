"""Codebase growth (S30, P18, A20, W01, O03): patch size per commit and its
running total, oldest commit first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.functions.scalars import message_strip, patch_length
from repochron.operators.ordered import ordered_scan

# ISO 8601 text with a numeric offset ("+00:00", as isoformat() writes it).
ISO_TS_OUT = "yyyy-MM-dd'T'HH:mm:ssxxx"
# File suffixes whose patches count towards the codebase size.
SOURCE_SUFFIXES = (".py", ".smk")


def is_source_file(path, suffixes: Sequence[str] = SOURCE_SUFFIXES) -> Column:
    """Path ends with one of the suffixes (case-sensitive); null path -> false."""
    p = F.col(path) if isinstance(path, str) else path
    cond = F.lit(False)
    for s in suffixes:
        cond = cond | p.endswith(s)
    return F.coalesce(cond, F.lit(False))


def first_parent_patches(patches: DataFrame, commits: DataFrame, key: Sequence[str] = ("repo",)) -> DataFrame:
    """Of the patches ``(key, hash, parent, ...)``, exported against every parent, those against the first one; of a
    commit without parents its own (``parent`` null). ``commits`` has ``hash`` and ``parents``."""
    first = commits.select(*key, "hash", F.get("parents", F.lit(0)).alias("__first"))
    return patches.join(first, [*key, "hash"]).where(F.col("parent").eqNullSafe(F.col("__first"))).drop("__first")


def commit_sizes(patches: DataFrame, commits: DataFrame | None = None,
                 key: Sequence[str] = ("repo",), commit_cols: Sequence[str] = ("hash",),
                 suffixes: Sequence[str] = SOURCE_SUFFIXES) -> DataFrame:
    """Per commit, summed byte length of patches of source files (0 if none).

    ``patches`` holds one row per (commit, file) diffed against the first parent
    (J12, ``first_parent_patches``; done here if ``commits`` has ``parents`` and the patches a ``parent``). It is pre-aggregated per commit (partial aggregation before the
    shuffle); with ``commits`` given, commits without patches get size 0.
    """
    if commits is not None and "parents" in commits.columns and "parent" in patches.columns:
        patches = first_parent_patches(patches, commits, key)
    size = F.when(is_source_file("a_path", suffixes), patch_length("patch")).otherwise(F.lit(0))
    per_commit = (patches.groupBy(*key, *commit_cols)
                  .agg(F.sum(size).cast("bigint").alias("commit_size")))
    if commits is None:
        return per_commit
    return (commits.join(per_commit, [*key, *commit_cols], "left")
            .withColumn("commit_size", F.coalesce("commit_size", F.lit(0).cast("bigint"))))


def codebase_growth(sizes: DataFrame, key: Sequence[str] = ("repo",),
                    order: Sequence[str] = ("pos",), bucket: Column | None = None,
                    size_col: str = "commit_size") -> DataFrame:
    """Running sum of ``commit_size`` per repo, oldest first."""
    if bucket is None:
        bucket = F.floor(F.col(order[0]) / F.lit(4096)).cast("bigint")
    return ordered_scan(sizes, key, order, bucket,
                        sums={"codebase_size": F.col(size_col).cast("bigint")})


def commit_size_rows(growth: DataFrame, key: Sequence[str] = ("repo",), hash_col: str = "hash",
                     ts_col: str = "committed_at", msg_col: str = "message") -> DataFrame:
    """K08 output rows: commit_id, commit_size, datetime (ISO 8601), message, codebase_size."""
    return growth.select(
        *key,
        F.col(hash_col).alias("commit_id"), "commit_size",
        F.date_format(F.col(ts_col), ISO_TS_OUT).alias("datetime"),
        message_strip(F.col(msg_col)).alias("commit_message"), "codebase_size")
