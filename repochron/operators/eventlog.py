"""Process-mining event logs per evolution cycle.

Activities of every kind become rows ``(key, case_id, activity, t, timestamp, user)``
and are matched to *all* cycles at once (J13) by an ordered scan over cycle begins and
activities together, so neither is a range join needed nor a cycle expanded.
A boundary instant falls in both neighbouring cycles, as in the reference.

Pull-request commits (E08, E09) carry no time filter in the reference and would
repeat in every cycle's log; here they are emitted once per repository with a
null ``cycle_no``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.functions.scalars import (DAY_SECONDS, GITHUB_TS_FORMAT, commit_case_id,
                                         epoch_to_str, last_url_segment, str_to_timestamp)
from repochron.operators.ordered import ordered_scan
from repochron.session import write_through

KEY = ("owner", "repo")
LEVELS = (0, 5, 10, 15, 20, 25, 30)      # blocks of 1, 32, 1024, ... positions
LOG_COLUMNS = ("case_id", "activity", "timestamp", "user")


def _parsed(df: DataFrame, col: str) -> tuple:
    ts = str_to_timestamp(F.col(col), GITHUB_TS_FORMAT)
    return ts, F.unix_timestamp(ts)


def issue_activities(issues: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """E01 Issue Created, E02 Issue Closed (user = opener). P20: no created date -> skipped."""
    cts, cep = _parsed(issues, "created_at")
    xts, xep = _parsed(issues, "closed_at")
    base = issues.select(*key, F.concat(F.lit("Issue-"), F.col("number").cast("string")).alias("case_id"),
                         cts.alias("__c"), cep.alias("__ce"), xts.alias("__x"), xep.alias("__xe"),
                         F.col("user.login").alias("user")).filter(F.col("__c").isNotNull())
    created = base.select(*key, "case_id", F.lit("Issue Created").alias("activity"),
                          F.col("__ce").alias("t"),
                          F.date_format("__c", GITHUB_TS_FORMAT).alias("timestamp"), "user")
    closed = base.filter(F.col("__x").isNotNull()).select(
        *key, "case_id", F.lit("Issue Closed").alias("activity"), F.col("__xe").alias("t"),
        F.date_format("__x", GITHUB_TS_FORMAT).alias("timestamp"), "user")
    return created.unionByName(closed)


def comment_activities(comments: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """E03 Issue Commented; the issue number is the last URL segment."""
    ts, ep = _parsed(comments, "created_at")
    return comments.select(
        *key, F.concat(F.lit("Issue-"), last_url_segment(F.col("issue_url"))).alias("case_id"),
        F.lit("Issue Commented").alias("activity"), ep.alias("t"),
        F.date_format(ts, GITHUB_TS_FORMAT).alias("timestamp"),
        F.col("user.login").alias("user")).filter(F.col("t").isNotNull())


def issue_event_activities(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The event's own name; user = actor login or null."""
    ts, ep = _parsed(events, "created_at")
    return events.select(
        *key, F.concat(F.lit("Issue-"), F.col("issue.number").cast("string")).alias("case_id"),
        F.col("event").alias("activity"), ep.alias("t"),
        F.date_format(ts, GITHUB_TS_FORMAT).alias("timestamp"),
        F.col("actor.login").alias("user")).filter(F.col("t").isNotNull())


def pr_activities(prs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """E07 Pull Request Opened."""
    ts, ep = _parsed(prs, "created_at")
    return prs.select(
        *key, F.concat(F.lit("Issue-"), F.col("number").cast("string")).alias("case_id"),
        F.lit("Pull Request Opened").alias("activity"), ep.alias("t"),
        F.date_format(ts, GITHUB_TS_FORMAT).alias("timestamp"),
        F.col("user.login").alias("user")).filter(F.col("t").isNotNull())


def commit_activities(commits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """E05 Committed (E06 is decided per cycle in ``attach_cycles``); time = whole
    seconds of the committer epoch, text without offset (F02)."""
    t = F.floor(F.col("committer_epoch")).cast("bigint")
    return commits.select(*key, commit_case_id(F.col("hash")).alias("case_id"),
                          F.lit("Committed").alias("activity"), t.alias("t"),
                          epoch_to_str(t).alias("timestamp"),
                          F.col("committer").alias("user"))


def attach_cycles(activities: DataFrame, cycles: DataFrame, key: Sequence[str] = KEY,
                  prefix: str = "snakemake", bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Every activity with ``begin <= t <= end`` of a cycle, for all cycles.

    The cycles of a repository follow each other and touch at their ends at most, two at an instant. Their begins and
    the activities go into one union, and an ordered scan gives each activity the last cycle that began at or before it;
    that one and the one before it are looked up by number. No cycle is expanded, however long it is. An instant on a
    boundary falls in both. Commits of a cycle that added rules or modules become ``Committed-Snakemake`` (E06)."""
    k = list(key)
    wf = (F.col(f"n_{prefix}_rules_added") > 0) | (F.col(f"n_{prefix}_modules_added") > 0)
    cyc = cycles.select(*k, F.struct(F.col("cycle_no").cast("bigint").alias("no"), F.col("begin.epoch").cast("double").alias("b"),
                                     F.col("end.epoch").cast("double").alias("e"), wf.alias("wf")).alias("c"))
    cyc = cyc.withColumn("p", F.lag("c").over(Window.partitionBy(*k).orderBy("c.no")))    # a row per cycle
    cyc = write_through(cyc, "cycles")
    columns = ("case_id", "activity", "t", "timestamp", "user")
    rows = activities.select(*k, *columns, F.col("t").cast("double").alias("__at"), F.lit(1).alias("__kind"))
    begins = cyc.select(*k, F.col("c.b").alias("__at"), F.lit(0).alias("__kind"), F.col("c.no").alias("__no"))
    points = write_through(rows.unionByName(begins, allowMissingColumns=True), "points")     # both branches of the scan read it
    scanned = ordered_scan(points, k, ["__at", "__kind"], F.floor(F.col("__at") / F.lit(bucket_seconds)).cast("bigint"),
                           maxes={"__last": F.col("__no")})
    met = scanned.where("__kind = 1 and __last is not null").join(cyc.withColumn("__last", F.col("c.no")), [*k, "__last"])
    inside = met.withColumn("__y", F.explode(F.filter(
        F.array("c", "p"), lambda y: y.isNotNull() & (y["b"] <= F.col("__at")) & (F.col("__at") <= y["e"]))))
    activity = F.when((F.col("activity") == "Committed") & F.col("case_id").startswith("Commit-")
                      & F.col("__y.wf"), F.lit(f"Committed-{prefix.capitalize()}")).otherwise(F.col("activity"))
    return inside.select(*k, F.col("__y.no").alias("cycle_no"), "case_id", activity.alias("activity"), "t", "timestamp", "user")


def range_blocks(begin: Column, end: Column) -> Column:
    """``[begin, end)`` as aligned blocks ``(level, no)`` of ``2^level`` positions, at most 62 of each level: those
    at its ends that no block of the next level covers, and all that are left on the highest level."""
    def inside(level):
        size = F.lit(1 << level)
        return F.ceil(begin / size).cast("bigint"), F.floor(end / size).cast("bigint")

    def blocks(level, low, high):
        return F.when(low < high, F.transform(F.sequence(low, high - 1), lambda no: F.struct(F.lit(level).alias("level"), no.alias("no")))) \
            .otherwise(F.array().cast("array<struct<level:int,no:bigint>>"))

    parts = []
    for level, above in zip(LEVELS, LEVELS[1:]):
        low, high = inside(level)
        up_low, up_high = inside(above)
        covered, step = up_low < up_high, 1 << (above - level)
        parts += [blocks(level, low, F.when(covered, up_low * step).otherwise(high)),
                  blocks(level, F.when(covered, up_high * step).otherwise(high), high)]
    parts.append(blocks(LEVELS[-1], *inside(LEVELS[-1])))
    return F.concat(*parts)


def commits_in_ranges(ranges: DataFrame, order: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``ranges`` (``key``, ``__b``, ``__e``, ...) with the commits at positions ``[__b, __e)`` of ``order`` (``idx``).

    A range is shuffled as a few aligned blocks, whatever its width, and a commit once for each level of blocks
    that occurs; the rows of the result first arise where both meet. Blocks of a hot repository are keys of their
    own, so its ranges spread over all tasks."""
    k = list(key)
    cut = write_through(ranges.where("__b < __e").withColumn("__blk", F.explode(range_blocks(F.col("__b"), F.col("__e"))))
                        .select("*", "__blk.level", "__blk.no").drop("__blk"), "ranges")
    levels = sorted(r["level"] for r in cut.select("level").distinct().collect())      # seven at most
    at = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("idx", level).alias("no")) for level in levels])) \
        if levels else F.explode(F.array().cast("array<struct<level:int,no:bigint>>"))
    placed = order.withColumn("__at", at).select(*order.columns, "__at.level", "__at.no")
    return cut.join(placed, [*k, "level", "no"]).drop("level", "no", "__b", "__e")


def pr_commit_activities(prs: DataFrame, commits: DataFrame, order: DataFrame,
                         key: Sequence[str] = KEY) -> DataFrame:
    """E08 / E09 (J09, J10, J11, J19): commits under a merged pull request.

    The merge commit must be a commit with parents (J09). One parent: that parent's
    commit date (E08). Two parents: commits at positions ``[idx(p0), idx(p1))`` of
    the commit order (J11, half-open; empty when not increasing). More parents: none.
    ``commits`` needs ``hash, parents, committer_date``; ``order`` is ``commit_order``.
    """
    created, _ = _parsed(prs, "created_at")
    pr = (prs.where(created.isNotNull())                  # P20: undated pull requests are skipped whole
          .select(*key, F.col("number"), F.col("merge_commit_sha").alias("hash"),
                  F.col("user.login").alias("user")).filter(F.col("hash").isNotNull()))
    merges = pr.join(commits.select(*key, "hash", "parents").filter(F.size("parents") > 0),
                     [*key, "hash"], "inner")
    idx = order.select(*key, "hash", "idx", "committer_date", "committer_epoch")
    case = F.concat(F.lit("Issue-"), F.col("number").cast("string"))

    single = merges.filter(F.size("parents") == 1).select(
        *key, "number", "user", F.col("parents")[0].alias("__p"))
    e08 = single.join(idx.withColumnRenamed("hash", "__p"), [*key, "__p"], "inner").select(
        *key, case.alias("case_id"), F.lit("Committed").alias("activity"),
        F.floor("committer_epoch").cast("bigint").alias("t"),
        F.col("committer_date").alias("timestamp"), "user", F.col("__p").alias("commit_hash"))

    double = merges.filter(F.size("parents") == 2).select(
        *key, "number", "user", F.col("parents")[0].alias("__p0"), F.col("parents")[1].alias("__p1"))
    ix = idx.select(*key, "hash", "idx")
    double = (double.join(ix.withColumnRenamed("hash", "__p0").withColumnRenamed("idx", "__b"),
                          [*key, "__p0"], "inner")
              .join(ix.withColumnRenamed("hash", "__p1").withColumnRenamed("idx", "__e"),
                    [*key, "__p1"], "inner")
              .filter(F.col("__b") < F.col("__e")))
    e09 = commits_in_ranges(double.select(*key, "number", "user", "__b", "__e"), idx, key).select(
        *key, case.alias("case_id"), F.lit("Committed").alias("activity"),
        F.floor("committer_epoch").cast("bigint").alias("t"),
        F.col("committer_date").alias("timestamp"), "user", F.col("hash").alias("commit_hash"))
    return e08.unionByName(e09)


def event_log(cycles: DataFrame, issues: DataFrame, comments: DataFrame, events: DataFrame,
              prs: DataFrame, commits: DataFrame, order: DataFrame,
              key: Sequence[str] = KEY, prefix: str = "snakemake", dedupe: bool = False) -> DataFrame:
    """The full log. Timed activities are per cycle; PR commits per repository.

    ``dedupe``: a commit that is listed under a pull request isn't listed again as an activity of its own (the
    reference keeps a list for this, but fills it too late)."""
    k = list(key)
    # read by pull requests and by the commits' own activities
    commits = write_through(commits.select(*k, "hash", "parents", "committer_epoch", "committer"), "log-commits")
    under_pr = pr_commit_activities(prs, commits, order, key)
    own = commits
    if dedupe:
        under_pr = write_through(under_pr, "pr-commits")
        own = commits.join(under_pr.select(*k, F.col("commit_hash").alias("hash")).distinct(), [*k, "hash"], "left_anti")
    timed = (issue_activities(issues, key)
             .unionByName(comment_activities(comments, key))
             .unionByName(issue_event_activities(events, key))
             .unionByName(commit_activities(own, key))
             .unionByName(pr_activities(prs, key)))
    per_cycle = attach_cycles(timed, cycles, key, prefix)
    pr_commits = under_pr.select(
        *k, F.lit(None).cast("bigint").alias("cycle_no"), "case_id", "activity", "t",
        "timestamp", "user")
    return per_cycle.unionByName(pr_commits)


def event_rejects(issues: DataFrame, comments: DataFrame, events: DataFrame, prs: DataFrame,
                  commits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What the log leaves out, ``(stage, key, kind, id, reason)``: rows without a
    creation date or with one that is no date, closing dates that are none, and merged pull
    requests whose merge commit or one of its parents is not among the commits."""
    def dated(df, kind, id_col, col="created_at", required=True):
        ts, _ = _parsed(df, col)
        none = F.coalesce(F.col(col), F.lit("")) == ""
        reason = F.when(none, F.lit(f"no {col}") if required else F.lit(None)).when(
            ts.isNull(), F.lit(f"malformed {col}"))
        return df.select(*key, F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"),
                         reason.alias("reason")).where("reason is not null")

    bad = (dated(issues, "issue", "number").unionByName(dated(issues, "issue", "number", "closed_at", False))
           .unionByName(dated(comments, "comment", "id")).unionByName(dated(events, "issue_event", "id"))
           .unionByName(dated(prs, "pull_request", "number")))
    merged = prs.where(F.col("merge_commit_sha").isNotNull()).select(
        *key, F.lit("pull_request").alias("kind"), F.col("number").cast("string").alias("id"),
        F.col("merge_commit_sha").alias("hash"))
    lost = merged.join(commits.select(*key, "hash"), [*key, "hash"], "left_anti").select(
        *key, "kind", "id", F.lit("merge commit not found").alias("reason"))
    parents = (merged.join(commits.select(*key, "hash", "parents"), [*key, "hash"])
               .select(*key, "kind", "id", F.explode("parents").alias("hash"))
               .join(commits.select(*key, "hash"), [*key, "hash"], "left_anti")
               .select(*key, "kind", "id").distinct().withColumn("reason", F.lit("parent commit not found")))
    out = bad.unionByName(lost).unionByName(parents)
    return out.select(F.lit("event_log").alias("stage"), *key, "kind", "id", "reason")


def sort_event_log(log: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Order by real time (not by text, whose formats differ), then case and activity.
    A global sort is a range shuffle: use it for writing, not inside pipelines."""
    return log.orderBy(*key, "cycle_no", "t", "case_id", "activity")
