"""Sinks (K01-K06, K08, K09): datasets, line lists, completion manifest, rejects.

Outputs are partitioned by repository where the reference writes one file per
repository; nothing is coalesced into one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """JSON (or Parquet) dataset; ``mode`` = overwrite / append."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_lines(df: DataFrame, path: str, col: str = "full_name", mode: str = "overwrite") -> None:
    """One stripped line per element."""
    df.select(F.trim(F.col(col)).alias("value")).write.mode(mode).text(path)


def write_text(df: DataFrame, path: str, col: str = "value", mode: str = "overwrite") -> None:
    """Text as is."""
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def mark_done(done: DataFrame, manifest_path: str, stage: str,
              key: Sequence[str] = ("owner", "repo"), run: str | None = None) -> None:
    """``(stage, owner, repo)`` rows in the completion manifest (read by J03). Each run of a stage has a folder of
    its own and replaces it, so a stage that is run again under the same ``run`` marks nothing twice."""
    rows = done.select(*key).distinct()
    rows.write.mode("overwrite").parquet(f"{manifest_path}/stage={stage}/run={run or uuid.uuid4().hex}")


def _committed(spark: SparkSession, manifest_path: str, stage: str) -> list[str]:
    """Folder names (``run=...``) of a stage's runs whose marks are complete, through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(f"{manifest_path}/stage={stage}")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
    return [r.getName() for r in runs if fs.exists(path(r, "_SUCCESS"))]


def done_keys(spark: SparkSession, manifest_path: str, stage: str, key: Sequence[str] = ("owner", "repo")) -> DataFrame | None:
    """The keys that ``stage`` has completed, once each; null if it hasn't run. Folders without Spark's
    ``_SUCCESS`` are runs that were killed and don't count."""
    whole = _committed(spark, manifest_path, stage)
    return spark.read.parquet(*[f"{manifest_path}/stage={stage}/{r}" for r in whole]).select(*key).distinct() if whole else None


def commit_stage(df: DataFrame, path: str, manifest_path: str, stage: str, run: str,
                 key: Sequence[str] = ("owner", "repo"), fmt: str = "parquet") -> None:
    """K04 / K05 / K10, exactly once: the stage's rows are staged under ``path/run=<run>``, then its keys are committed to the
    manifest. A stage that was killed at any point and is run again under the same ``run`` leaves one copy and one mark;
    ``read_stage`` reads committed runs only."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/run={run}")
    mark_done(df.sparkSession.read.format(fmt).load(f"{path}/run={run}"), manifest_path, stage, key, run)


def read_stage(spark: SparkSession, path: str, manifest_path: str, stage: str, fmt: str = "parquet") -> DataFrame | None:
    """The rows of all committed runs; null if there is none."""
    names = _committed(spark, manifest_path, stage)
    return spark.read.format(fmt).load([f"{path}/{n}" for n in names]) if names else None


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Dead-letter table ``(stage, name, reason)``, appended."""
    rejects.write.mode("append").parquet(path)
