"""Skew-safe ordered scans: running sums / maxima and previous / next row values.

A plain ``Window.partitionBy(repo).orderBy(t)`` puts a whole repository in one
task; one repository can hold a third of all commits. Here every key is split
into buckets of a column that grows with the order (e.g. the day of the
commit):

1. one hash exchange on ``(key, bucket)``; the window runs inside each bucket;
2. each bucket is summarised by a partial + final hash aggregate (one row per
   bucket, so only small partial results are shuffled);
3. the summaries of earlier buckets are carried forward with a window over that
   small table (partitioned by key: #buckets rows for the hottest key);
4. the carry is joined back on ``(key, bucket)``; the large side is already
   partitioned that way, so only the small side moves (AQE may broadcast it
   when its measured size is under the threshold).

The input is read by both branches. When a scan feeds another scan, pass
``materialize=True``: the result is written once as a table under the cluster's
checkpoint folder and read back, so chained passes stay linear in cost instead
of re-evaluating every earlier pass in both branches (and survive executor loss).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.session import write_through

_BK = "__bkt"
_RN = "__rn"


def day_bucket(epoch_col: str = "committer_epoch", seconds: int = 86400) -> Column:
    """Bucket by whole days (or any span) of an epoch column."""
    return F.floor(F.col(epoch_col) / F.lit(seconds)).cast("bigint")


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 sums: Mapping[str, Column] | None = None,
                 maxes: Mapping[str, Column] | None = None,
                 lags: Mapping[str, Column] | None = None,
                 leads: Mapping[str, Column] | None = None,
                 index: str | None = None, materialize: bool = False) -> DataFrame:
    """Add, per row, in the order ``order`` within ``keys``:

    * ``sums[name]``: running sum up to and including the row,
    * ``maxes[name]``: running maximum up to and including the row,
    * ``lags[name]`` / ``leads[name]``: value of the previous / next row (null at the ends),
    * ``index``: 0-based position.

    ``bucket`` must be non-decreasing along ``order`` inside a key.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    lags, leads = dict(lags or {}), dict(leads or {})
    keys, order = list(keys), list(order)
    part = keys + [_BK]

    base = df.withColumn(_BK, bucket)
    # Materialise the value expressions once so both branches share them.
    vals = {}
    for kind, spec in (("s", sums), ("m", maxes), ("l", lags), ("d", leads)):
        for name, expr in spec.items():
            vals[(kind, name)] = f"__v{kind}_{name}"
    base = base.select("*", *[expr.alias(vals[("s", n)]) for n, expr in sums.items()],
                       *[expr.alias(vals[("m", n)]) for n, expr in maxes.items()],
                       *[expr.alias(vals[("l", n)]) for n, expr in lags.items()],
                       *[expr.alias(vals[("d", n)]) for n, expr in leads.items()])

    w = Window.partitionBy(*part).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select(
        "*",
        F.row_number().over(w).alias(_RN),
        F.lead(F.lit(1)).over(w).isNull().alias("__lastrow"),
        *[F.sum(vals[("s", n)]).over(run).alias(f"__ls_{n}") for n in sums],
        *[F.max(vals[("m", n)]).over(run).alias(f"__lm_{n}") for n in maxes],
        *[F.lag(vals[("l", n)]).over(w).alias(f"__ll_{n}") for n in lags],
        *[F.lead(vals[("d", n)]).over(w).alias(f"__ld_{n}") for n in leads],
    )

    ordkey = F.struct(*[F.col(c) for c in order])
    summary = base.groupBy(*part).agg(
        F.count(F.lit(1)).alias("__cnt"),
        *[F.sum(vals[("s", n)]).alias(f"__ts_{n}") for n in sums],
        *[F.max(vals[("m", n)]).alias(f"__tm_{n}") for n in maxes],
        *[F.max_by(vals[("l", n)], ordkey).alias(f"__tl_{n}") for n in lags],
        *[F.min_by(vals[("d", n)], ordkey).alias(f"__td_{n}") for n in leads],
    )
    ws = Window.partitionBy(*keys).orderBy(_BK)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part,
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__ccnt"),
        *[F.sum(f"__ts_{n}").over(before).alias(f"__cs_{n}") for n in sums],
        *[F.max(f"__tm_{n}").over(before).alias(f"__cm_{n}") for n in maxes],
        *[F.lag(f"__tl_{n}").over(ws).alias(f"__cl_{n}") for n in lags],
        *[F.lead(f"__td_{n}").over(ws).alias(f"__cd_{n}") for n in leads],
    )

    joined = local.join(carry, part, "inner")
    out_cols = [F.col(c) for c in df.columns]
    for n in sums:
        out_cols.append((F.coalesce(F.col(f"__cs_{n}"), F.lit(0)) + F.col(f"__ls_{n}")).alias(n))
    for n in maxes:
        cm, lm = F.col(f"__cm_{n}"), F.col(f"__lm_{n}")
        out_cols.append(F.when(cm.isNull(), lm).when(lm.isNull(), cm)
                        .otherwise(F.greatest(cm, lm)).alias(n))
    for n in lags:
        out_cols.append(F.when(F.col(_RN) == 1, F.col(f"__cl_{n}"))
                        .otherwise(F.col(f"__ll_{n}")).alias(n))
    for n in leads:
        out_cols.append(F.when(F.col("__lastrow"), F.col(f"__cd_{n}"))
                        .otherwise(F.col(f"__ld_{n}")).alias(n))
    if index:
        out_cols.append((F.col("__ccnt") + F.col(_RN) - 1).cast("bigint").alias(index))
    out = joined.select(*out_cols)
    return write_through(out, "scan") if materialize else out
