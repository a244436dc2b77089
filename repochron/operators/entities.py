"""Entity filters and joins of the collection stage.

What the reference fetches per issue is re-aimed as joins between landed tables:
an issue flagged as pull request joined to its PR detail, issues with comments
joined to their comments, every issue to its events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repochron.functions.scalars import last_url_segment

KEY = ("owner", "repo")


def has_field(col: str) -> Column:
    """The field exists and is set."""
    return F.col(col).isNotNull()


def issues_that_are_prs(issues: DataFrame) -> DataFrame:
    """Issues whose ``pull_request`` is present."""
    return issues.filter(has_field("pull_request"))


def issues_with_comments(issues: DataFrame) -> DataFrame:
    """Issues whose comment count is set and non-zero."""
    return issues.filter(F.coalesce(F.col("comments"), F.lit(0)) != 0)


def feature_gate(repo_info: DataFrame, flag: str) -> DataFrame:
    """Repositories with ``has_issues`` / ``has_pages`` set (absent = false)."""
    return repo_info.filter(F.coalesce(F.col(flag), F.lit(False)))


def related_commits(commits: DataFrame, prefix: str = "snakemake") -> DataFrame:
    """Commits flagged as related to the workflow."""
    return commits.filter(F.coalesce(F.col(f"{prefix}_related"), F.lit(False)))


def issue_pull_requests(issues: DataFrame, prs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """PR detail of every issue that is a PR (inner equi join on number)."""
    i = issues_that_are_prs(issues).select(*key, "number")
    return i.join(prs, [*key, "number"], "inner")


def issue_comment_rows(issues: DataFrame, comments: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Comments of issues with comments; the issue number is the last
    segment of the comment's ``issue_url``."""
    i = issues_with_comments(issues).select(*key, "number")
    c = comments.withColumn("number", last_url_segment(F.col("issue_url")).cast("bigint"))
    return i.join(c, [*key, "number"], "inner")


def issue_event_rows(issues: DataFrame, events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Events of every issue."""
    e = events.withColumn("number", F.col("issue.number"))
    return issues.select(*key, "number").join(e, [*key, "number"], "inner")


def concat_lists(*frames: DataFrame) -> DataFrame:
    """List concatenation = union of rows (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
