"""Value checks with visible rejects.

Checks never raise on data: failing rows go to a rejects table with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_suffix_columns(df: DataFrame, suffix: str = "_url") -> DataFrame:
    """Drop top-level columns whose name ends with ``suffix`` (nested fields stay)."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def map_drop_suffix(m, suffix: str = "_url") -> Column:
    """P01 on an open-schema map tail."""
    col = F.col(m) if isinstance(m, str) else m
    return F.map_filter(col, lambda k, v: ~k.endswith(suffix))


def split_full_name(df: DataFrame, col: str = "full_name") -> DataFrame:
    """Strip and split ``owner/repo`` into exactly two parts; ``valid`` marks rows
    that split, the others keep null owner / repo (send them to rejects)."""
    parts = F.split(F.trim(F.col(col)), "/")
    ok = F.size(parts) == 2
    return df.withColumn("owner", F.when(ok, parts[0])) \
             .withColumn("repo", F.when(ok, parts[1])) \
             .withColumn("valid", F.coalesce(ok, F.lit(False)))


def is_full_name(col) -> Column:
    """A slash exists and is not the first character."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.instr(c, "/") > 1, F.lit(False))


def is_commit_hash(col) -> Column:
    """A non-null string of length 40 (not checked for hex digits)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.length(c) == 40, F.lit(False))


def has_type(col, kind: str) -> Column:
    """Null, or a value of type ``kind`` (a Spark type; for text and VARIANT: a value that casts to it without
    loss of what it says)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | c.try_cast(kind).isNotNull()


def with_default(col, default=None, required: bool = False, kind: str | None = None) -> Column:
    """Value or default when null (a falsy default yields null, as in the
    reference); ``required`` makes a null fail via ``raise_error``, ``kind`` a value that is not of this type;
    the result then has that type."""
    c = F.col(col) if isinstance(col, str) else col
    out = c if kind is None else F.when(has_type(c, kind), c.try_cast(kind)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {kind}, got "), c.cast("string"))))
    if required:
        return F.when(c.isNull(), F.raise_error(F.lit("value is required"))).otherwise(out)
    return F.coalesce(out, F.lit(default)) if default else out


def rejects_of(df: DataFrame, valid: Column, stage: str, reason: str, name_col: str) -> DataFrame:
    """Rows failing ``valid`` as ``(stage, full_name, reason)``."""
    return df.filter(~valid).select(F.lit(stage).alias("stage"), F.col(name_col).alias("full_name"),
                                    F.lit(reason).alias("reason"))
