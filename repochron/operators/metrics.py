"""Per-file process metrics.

Input: one row per (commit, modified file) with ``hash, author, committer_epoch,
new_path / old_path, n_added_lines, n_deleted_lines`` and optionally the patch.
Everything is an aggregate by ``(key, path)``: partial aggregation before the
shuffle, and the median works on a (value, count) histogram, so a hot file is
never gathered into one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.functions.scalars import hunk_count
from repochron.operators.ordered import day_bucket, ordered_scan
from repochron.session import write_through

KEY = ("owner", "repo")
MINOR_SHARE = 0.05          # fixed value: an author below 5 % of a file's lines is minor


def history_range(files: DataFrame, order: DataFrame | None = None,
                  from_commit: str | None = None, to_commit: str | None = None,
                  since=None, to=None, key: Sequence[str] = KEY,
                  epoch: str = "committer_epoch") -> DataFrame:
    """Keep commits between two hashes (by commit order, inclusive; needs
    ``order`` = output of ``commit_order``) and / or between two instants. A hash that no
    repository holds is an error."""
    out = files
    if since is not None:
        out = out.filter(F.col(epoch) >= F.unix_timestamp(F.lit(since).cast("timestamp")))
    if to is not None:
        out = out.filter(F.col(epoch) <= F.unix_timestamp(F.lit(to).cast("timestamp")))
    if from_commit or to_commit:
        if order is None:
            raise ValueError("commit order is required to cut by commit hash")
        idx = order.select(*key, "hash", "idx")
        bounds = idx.groupBy(*key).agg(
            F.max(F.when(F.col("hash") == F.lit(from_commit), F.col("idx"))).alias("__lo"),
            F.max(F.when(F.col("hash") == F.lit(to_commit), F.col("idx"))).alias("__hi"))
        asked = [h for h in (from_commit, to_commit) if h]
        found = idx.where(F.col("hash").isin(asked)).agg(F.count_distinct("hash").alias("n")).first()["n"]
        if found < len(set(asked)):
            raise ValueError("a commit hash of the range is in no repository")
        # repositories that hold neither bound have no part in the range
        bounds = bounds.where(F.col("__lo").isNotNull() | F.col("__hi").isNotNull())
        sel = idx.join(bounds, list(key)).filter(
            (F.col("__lo").isNull() | (F.col("idx") >= F.col("__lo")))
            & (F.col("__hi").isNull() | (F.col("idx") <= F.col("__hi"))))
        out = out.join(sel.select(*key, "hash"), [*key, "hash"], "left_semi")
    return out


def resolve_renames(files: DataFrame, key: Sequence[str] = KEY,
                    check_every: int = 2, epoch: str = "committer_epoch") -> DataFrame:
    """Follow renames the way the metric library does (newest commit first): a change
    to path ``q`` at commit ``t`` is counted under the name ``q`` ends up with through
    the *earliest rename of q after t*, then that rename's own later renames.

    * "next rename of this path after me" = running count of rename events per
      (key, path) in commit order (skew-safe ordered scan, bucketed by day) and an
      equi join on count + 1 -- an as-of join without a range join;
    * the end of each rename chain = pointer doubling over rename events
      (each round doubles the followed length; lineage cut when checking).

    Returns ``files`` with column ``path``."""
    k = list(key)
    path0 = F.coalesce(F.col("new_path"), F.col("old_path"))
    # A file appears once per commit: (key, hash, path) identifies a row deterministically.
    rows = files.withColumn("__rid", F.concat_ws("\u0000", *[F.col(c) for c in k], F.col("hash"), path0))
    is_ren = ((F.col("change_type") == "RENAME") & F.col("old_path").isNotNull()
              & F.col("new_path").isNotNull() & (F.col("old_path") != F.col("new_path")))
    events = (rows.filter(is_ren)
              .select(*k, F.col("old_path").alias("src"), F.col("new_path").alias("dst"),
                      F.col(epoch).alias("__t"), F.col("hash").alias("__h"))
              .withColumn("__eid", F.concat_ws("\u0000", *[F.col(c) for c in k], F.col("__h"),
                                               F.col("src"))))
    # Points on each path's time line: events (kind 0 sorts first at the same commit,
    # so a rename in the same commit is not "later") and lookups (kind 1).
    ev_pts = events.select(*k, F.col("src").alias("__p"), "__t", "__h", F.lit(0).alias("__kind"),
                           F.lit(None).cast("string").alias("__q"), "__eid")
    row_q = rows.select(*k, path0.alias("__p"), F.col(epoch).alias("__t"), F.col("hash").alias("__h"),
                        F.lit(1).alias("__kind"), F.concat(F.lit("r"), F.col("__rid"))
                        .alias("__q"), F.lit(None).cast("string").alias("__eid"))
    ev_q = events.select(*k, F.col("dst").alias("__p"), "__t", "__h", F.lit(1).alias("__kind"),
                         F.concat(F.lit("e"), F.col("__eid")).alias("__q"),
                         F.lit(None).cast("string").alias("__eid"))
    pts = ev_pts.unionByName(row_q).unionByName(ev_q).filter(F.col("__p").isNotNull())
    pts = ordered_scan(pts, [*k, "__p"], ["__t", "__h", "__kind"], day_bucket("__t"),
                       sums={"__seq": (F.col("__kind") == 0).cast("bigint")})
    seq_ev = pts.filter(F.col("__kind") == 0).select(*k, "__p", "__seq", F.col("__eid").alias("__next"))
    nxt = (pts.filter(F.col("__kind") == 1)
           .withColumn("__seq", F.col("__seq") + 1)
           .join(seq_ev, [*k, "__p", "__seq"], "left")
           .select("__q", "__next"))
    nxt = write_through(nxt, "renames_next")
    # Pointer doubling over events: jump[e] = next event after e's rename, or itself at the end.
    ev_next = (nxt.filter(F.col("__q").startswith("e"))
               .select(F.expr("substring(__q, 2)").alias("__e"), "__next"))
    jump = ev_next.select("__e", F.coalesce("__next", "__e").alias("__j"))
    i = -1
    while True:                  # until no chain moves (rounds double the length followed)
        i += 1
        hop = jump.select(F.col("__e").alias("__j"), F.col("__j").alias("__j2"))
        stepped = jump.join(hop, "__j", "left").select(
            "__e", F.coalesce("__j2", "__j").alias("__j"),
            (F.coalesce("__j2", "__j") != F.col("__j")).alias("__moved"))
        if (i + 1) % check_every == 0:
            stepped = write_through(stepped, "renames_jump")
            done = stepped.filter("__moved").isEmpty()
            jump = stepped.drop("__moved")
            if done:
                break
        else:
            jump = stepped.drop("__moved")
    final = jump.join(events.select(F.col("__eid").alias("__j"), F.col("dst").alias("__final")), "__j")
    row_next = nxt.filter(F.col("__q").startswith("r")).select(
        F.expr("substring(__q, 2)").alias("__rid"), F.col("__next").alias("__e"))
    mapped = row_next.join(final.select("__e", "__final"), "__e", "inner").select("__rid", "__final")
    out = rows.join(mapped.dropDuplicates(["__rid"]), "__rid", "left")
    return out.withColumn("path", F.coalesce(F.col("__final"), path0)).drop("__rid", "__final")


def file_changes(files: DataFrame, key: Sequence[str] = KEY, path: Column | None = None,
                 hunk_markers: str | None = None) -> DataFrame:
    """One row per (key, path, commit): lines added / removed, author, hunks."""
    if path is not None:
        p = path
    elif "path" in files.columns:
        p = F.col("path")
    elif "old_path" in files.columns:
        p = F.coalesce(F.col("new_path"), F.col("old_path"))
    else:
        p = F.col("new_path")
    cols = [F.sum("n_added_lines").cast("bigint").alias("added"),
            F.sum("n_deleted_lines").cast("bigint").alias("removed"),
            F.first("author").alias("author")]
    if hunk_markers is not None:
        cols.append(F.sum(hunk_count(F.col("patch"), hunk_markers)).cast("bigint").alias("hunks"))
    return files.groupBy(*key, p.alias("path"), "hash").agg(*cols)


def changeset_stats(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Most and mean files per commit."""
    per_commit = changes.groupBy(*key, "hash").agg(F.count(F.lit(1)).alias("n_files"))
    return per_commit.groupBy(*key).agg(F.max("n_files").cast("bigint").alias("changeset_max"),
                                        F.avg("n_files").alias("changeset_avg"))


def file_metrics(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """A37-A44, A46-A52, W11 per (key, path), as one chain of aggregations.

    A commit has one author, so per-(file, author) sums, counts and maxima compose
    into the per-file ones: (file, commit) -> (file, author) -> file. Every shuffle
    moves pre-aggregated rows, and a hot file stays spread over commits and authors
    until the last step, where it is one row per author."""
    churn = F.col("added") - F.col("removed")
    per_author = changes.groupBy(*key, "path", "author").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("added").alias("s_add"), F.sum("removed").alias("s_rem"),
        F.sum(churn).alias("s_churn"), F.max(churn).alias("m_churn"),
        F.max("added").alias("m_add"), F.max("removed").alias("m_rem"))
    # Each author's share of the file's lines (window over one row per author).
    lines = F.col("s_add") + F.col("s_rem")
    total = F.sum(lines).over(Window.partitionBy(*key, "path"))
    per_author = per_author.withColumn("__lines", lines).withColumn("__total", total)
    n = F.sum("n")
    return per_author.groupBy(*key, "path").agg(
        n.cast("bigint").alias("commitscount_files"),
        F.sum("s_churn").cast("bigint").alias("codechurn_count"),
        F.max("m_churn").cast("bigint").alias("codechurn_max"),
        (F.sum("s_churn") / n).alias("codechurn_avg"),
        F.sum("s_add").cast("bigint").alias("codechurn_added_lines"),
        F.sum("s_rem").cast("bigint").alias("codechurn_removed_lines"),
        F.sum("__lines").cast("bigint").alias("linescount_count"),
        F.sum("s_add").cast("bigint").alias("linescount_count_added"),
        F.max("m_add").cast("bigint").alias("linescount_max_added"),
        (F.sum("s_add") / n).alias("linescount_avg_added"),
        F.sum("s_rem").cast("bigint").alias("linescount_count_removed"),
        F.max("m_rem").cast("bigint").alias("linescount_max_removed"),
        (F.sum("s_rem") / n).alias("linescount_avg_removed"),
        F.count(F.lit(1)).cast("bigint").alias("contributorscount_count"),
        F.count_if(F.when(F.col("__total") > 0, F.col("__lines") / F.col("__total")) < MINOR_SHARE)
         .cast("bigint").alias("contributorscount_minor"),
        F.when(F.max("__total") > 0, F.max("__lines") * 100.0 / F.max("__total"))
         .otherwise(F.lit(0.0)).alias("contributorsexperience_count"))


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of ``value`` per group from a (value, count) histogram:
    rows are never collected per group; the window runs over distinct values."""
    hist = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group).orderBy(value)
    hist = hist.select(*group, value, "__n",
                       (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                        - F.col("__n")).alias("__before"),
                       F.sum("__n").over(Window.partitionBy(*group)).alias("__total"))
    lo = F.floor((F.col("__total") - 1) / 2)
    hi = F.floor(F.col("__total") / 2)

    def covers(k):
        return (F.col("__before") <= k) & (k < F.col("__before") + F.col("__n"))

    return hist.groupBy(*group).agg(
        ((F.max(F.when(covers(lo), F.col(value))) + F.max(F.when(covers(hi), F.col(value))))
         / 2.0).alias(out))


def hunks_median(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Median hunks per commit of each file."""
    return exact_median(changes, [*key, "path"], "hunks", "hunkscount_files")


def process_metrics(files: DataFrame, key: Sequence[str] = KEY, hunk_markers: str | None = "+-",
                    follow_renames: bool = False, order: DataFrame | None = None, from_commit: str | None = None,
                    to_commit: str | None = None, since=None, to=None) -> tuple[DataFrame, DataFrame]:
    """(per-file metrics, per-repo changeset stats) of the commits in a range of history (P21): between two
    hashes (``order`` = ``commit_order``) and / or two instants, all inclusive. Renames are followed through the whole
    history first, so a file keeps the name it ends up with."""
    if follow_renames:
        files = resolve_renames(files, key)
    if from_commit or to_commit or since is not None or to is not None:
        files = history_range(files, order, from_commit, to_commit, since, to, key)
    ch = file_changes(files, key, hunk_markers=hunk_markers)
    per_file = file_metrics(ch, key)
    if hunk_markers is not None:
        per_file = per_file.join(hunks_median(ch, key), [*key, "path"], "left")
    return per_file, changeset_stats(ch, key)
