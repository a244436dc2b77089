"""Bursts of commits on a stream (optional extension of W04).

A burst is a run of commits less than 24 h apart; exactly 24 h splits. Session
windows merge at a gap equal to the timeout, so the timeout is one microsecond
under 24 h. Late commits are accepted up to the watermark delay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: a gap of exactly 24 h must split, so the session timeout is 1 us shorter.
BURST_GAP = "86399999999 microseconds"


def stream_bursts(commits: DataFrame, key: Sequence[str] = ("owner", "repo"),
                  ts_col: str = "committed_at", watermark: str = "2 days") -> DataFrame:
    """Per (key, burst): start, end and commit count, on a stream
    (or a batch: the same plan works for both)."""
    w = F.session_window(F.col(ts_col), BURST_GAP)
    return (commits.withWatermark(ts_col, watermark)
            .groupBy(*key, w.alias("burst"))
            .agg(F.count(F.lit(1)).alias("n_commits"),
                 F.min(ts_col).alias("first_commit_at"),
                 F.max(ts_col).alias("last_commit_at")))
