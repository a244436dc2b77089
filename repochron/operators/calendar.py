"""Date ranges (G01-G05): month, week and day ranges between two dates, per row.

Each input row holds ``start`` and ``end`` dates; the ranges are generated with
``sequence`` + ``explode`` inside the row's task, so nothing goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = ("m", "w", "d")


def date_ranges(df: DataFrame, start: str, end: str, interval: str) -> DataFrame:
    """Rows of ``df`` times their ranges ``(range_start, range_end)``.

    * ``m``: the first range starts at ``start``, later ones on the 1st; ends are
      month ends clipped to ``end`` (G01);
    * ``w``: Monday-Sunday weeks; the first Monday may precede ``start`` (not
      clipped), the last end is clipped to ``end`` (G02);
    * ``d``: one range per day (G03);
    * another interval or ``start > end``: no rows (G04).
    """
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    base = df.filter(s <= e) if interval in INTERVALS else df.filter(F.lit(False))
    if interval == "m":
        months = F.sequence(F.trunc(s, "MM"), F.trunc(e, "MM"), F.expr("INTERVAL 1 MONTH"))
        out = base.withColumn("__m", F.explode(months))
        return out.withColumn("range_start", F.greatest(F.col("__m"), s)) \
                  .withColumn("range_end", F.least(F.last_day(F.col("__m")), e)).drop("__m")
    if interval == "w":
        monday = F.date_trunc("week", s).cast("date")
        weeks = F.sequence(monday, e, F.expr("INTERVAL 7 DAYS"))
        out = base.withColumn("range_start", F.explode(weeks))
        return out.withColumn("range_end", F.least(F.date_add(F.col("range_start"), 6), e))
    if interval == "d":
        out = base.withColumn("range_start", F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY"))))
        return out.withColumn("range_end", F.col("range_start"))
    return base.withColumn("range_start", F.lit(None).cast("date")) \
               .withColumn("range_end", F.lit(None).cast("date"))
