"""Commit-log text scans.

Input tables are landed text lines (``spark.read.text`` + the repository
name from the path, S27): ``git log --pretty=format:%H|%an|%cn|%ad|%s|%P`` lines,
``--numstat`` lines (``added<TAB>deleted<TAB>path``), ``--name-only`` lines,
and optional ref tables. Everything is split, cast and joined on the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.functions.scalars import is_merge, lenient_int, split_parents

# What a line must look like: four fields, a subject that may itself hold bars, parent hashes. The format
# string reaches git unquoted-by-shell, so a line may begin and end with a quote.
_LOG_RE = r"^(?:[^|]*+\|){4}.*\|[0-9A-Fa-f ]*'?$"


# Forks share hashes: a commit is known by repository and hash. The hash comes first: sorts compare the first bytes
# of the first key before anything else, and there are few repositories.
COMMIT = ("commit_hash", "repo_name")


def _once(lines: DataFrame, **cols) -> DataFrame:
    """Select ``cols`` so that each is evaluated once per line. Spark moves a filter on a column, the joins' tests for
    null keys too, below the projection that makes it, which then makes it anew; not below a generator."""
    return lines.select(F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def _log_parts(value, strict: bool):
    """The bar-separated parts of a line and whether it is a commit (null for a null line)."""
    parts = F.split(value, r"\|", -1)
    return parts, (F.size(parts) == 6) & value.isNotNull() if strict else value.rlike(_LOG_RE)


def parse_log_lines(lines: DataFrame, repo_col: str = "repo", value_col: str = "value",
                    strict: bool = False) -> DataFrame:
    """One row per line; ``valid`` tells whether it is a commit.

    A subject may hold bars: the line is read from both ends. ``strict=True`` is the
    compatibility switch that takes exactly six bar-separated parts. What is not valid
    is for ``log_rejects``, never dropped unseen."""
    parts, ok = _log_parts(F.col(value_col), strict)
    # the line is tested by one pattern and split once; the fields are picked from its parts
    rows = _once(lines, repo_name=F.col(repo_col), __p=parts, valid=ok)
    p, n = F.col("__p"), F.size("__p")
    last = F.get(p, n - 1)
    fields = {
        "commit_hash": F.when(p[0].startswith("'"), F.substr(p[0], F.lit(2))).otherwise(p[0]),
        "author": p[1], "committer": p[2], "date": p[3],
        "message": F.when(n == 6, p[4]).otherwise(F.array_join(F.slice(p, F.lit(5), n - 5), "|")),
        "parent_commit": F.when(last.endswith("'"), F.left(last, F.length(last) - 1)).otherwise(last)}
    return rows.select("repo_name", *[F.when(F.col("valid"), f).alias(k) for k, f in fields.items()], "valid")


def log_rejects(lines: DataFrame, repo_col: str = "repo", value_col: str = "value",
                strict: bool = False) -> DataFrame:
    """The lines that are no commit, with the reason."""
    rows = lines.select(F.col(repo_col).alias("repo_name"), F.col(value_col).alias("line"))
    parts, ok = _log_parts(F.col("line"), strict)
    return rows.where(~F.coalesce(ok, F.lit(False))).select(
        F.lit("commit_log").alias("stage"), "repo_name", "line",
        F.when(F.size(parts) > 6, F.lit("bar in a field"))
         .otherwise(F.lit("not six fields")).alias("reason"))


def parse_numstat(lines: DataFrame, repo_col: str = "repo", hash_col: str = "hash",
                  value_col: str = "value") -> DataFrame:
    """``added, deleted, path`` per line; '-' counts 0; a line whose first
    count is not an integer adds nothing, one whose second is not adds only the first."""
    rows = _once(lines, repo_name=F.col(repo_col), commit_hash=F.col(hash_col), __p=F.split(F.col(value_col), "\t", -1))
    p = F.col("__p")
    rows = rows.filter(F.size(p) == 3).select("repo_name", "commit_hash", lenient_int(p[0]).alias("added"), "__p")
    return rows.select("repo_name", "commit_hash", "added",
                       F.when(F.col("added").isNotNull(), lenient_int(p[1])).alias("deleted"), p[2].alias("path"))


def numstat_totals(numstat: DataFrame) -> DataFrame:
    """Lines added and deleted per commit (0 when nothing parses)."""
    return numstat.groupBy(*COMMIT).agg(
        F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("lines_added"),
        F.coalesce(F.sum("deleted"), F.lit(0)).cast("bigint").alias("lines_deleted")) \
        .select("repo_name", "commit_hash", "lines_added", "lines_deleted")


def numstat_commit_stats(numstat: DataFrame) -> DataFrame:
    """A21 / A22 / S23 in one aggregation: totals and the changed paths per commit
    (when no separate name-only listing is landed)."""
    return numstat.groupBy(*COMMIT).agg(
        F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("lines_added"),
        F.coalesce(F.sum("deleted"), F.lit(0)).cast("bigint").alias("lines_deleted"),
        F.sort_array(F.collect_list(F.when(F.col("path") != "", F.col("path")))).alias("changed_files")) \
        .select("repo_name", "commit_hash", "lines_added", "lines_deleted", "changed_files")


def changed_files(names: DataFrame, repo_col: str = "repo", hash_col: str = "hash",
                  value_col: str = "value") -> DataFrame:
    """Changed file names per commit, blanks dropped (the list of one commit)."""
    return (names.filter(F.col(value_col) != "")
            .groupBy(F.col(hash_col).alias("commit_hash"), F.col(repo_col).alias("repo_name"))
            .agg(F.sort_array(F.collect_list(value_col)).alias("changed_files"))
            .select("repo_name", "commit_hash", "changed_files"))


def assemble_commits(log: DataFrame, totals: DataFrame | None = None,
                     files: DataFrame | None = None, tags: DataFrame | None = None,
                     branches: DataFrame | None = None) -> DataFrame:
    """The 14-field commit row, every join by repository and hash.

    ``tags``: ``(repo_name, commit_hash, tag)`` rows (S25, or J16 output); ``branches``:
    ``(repo_name, commit_hash, branch)`` (S26, or J17 output). Defaults: branch ``unknown``,
    tags ``[]``, files ``["unknown"]``, counts 0 (P14). ``merged_branch`` is the name
    of parent 0 for merges, empty where it has none, null for others (F19-F21)."""
    key = list(COMMIT)
    # a hash that can't be null needs no test of its own for the joins, which would parse each line once more
    out = log.filter("valid").drop("valid").withColumn("commit_hash", F.coalesce("commit_hash", F.lit("")))
    parents = split_parents(F.col("parent_commit"))
    out = out.withColumn("__p0", F.get(parents, F.lit(0))).withColumn("is_merge_commit", is_merge(parents))
    if branches is not None:
        b = branches.groupBy(*key).agg(F.min("branch").alias("branch"))
        # the join by another key comes first, while the rows are short; all others share one exchange
        b0 = b.select(F.col("commit_hash").alias("__p0"), "repo_name", F.col("branch").alias("__b0"))
        out = out.join(b0, ["__p0", "repo_name"], "left").join(b, key, "left")
    else:
        out = out.withColumn("branch", F.lit(None).cast("string")) \
                 .withColumn("__b0", F.lit(None).cast("string"))
    if totals is not None:
        out = out.join(totals, key, "left")
    else:
        out = out.withColumn("lines_added", F.lit(None).cast("bigint")) \
                 .withColumn("lines_deleted", F.lit(None).cast("bigint"))
    if files is not None:
        out = out.join(files, key, "left")
    elif "changed_files" not in out.columns:
        out = out.withColumn("changed_files", F.lit(None).cast("array<string>"))
    if tags is not None:
        t = tags.groupBy(*key).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        out = out.join(t, key, "left")
    else:
        out = out.withColumn("tags", F.lit(None).cast("array<string>"))
    unknown = F.lit("unknown")
    return out.select(
        "repo_name", "commit_hash", "author", "committer", "date", "message", "parent_commit",
        F.coalesce("branch", unknown).alias("branch"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(F.coalesce(F.size("changed_files"), F.lit(0)) > 0, F.col("changed_files"))
         .otherwise(F.array(unknown)).alias("changed_files"),
        F.coalesce("lines_added", F.lit(0).cast("bigint")).alias("lines_added"),
        F.coalesce("lines_deleted", F.lit(0).cast("bigint")).alias("lines_deleted"),
        "is_merge_commit",
        F.when(F.col("is_merge_commit"), F.coalesce("__b0", F.lit(""))).alias("merged_branch"))
