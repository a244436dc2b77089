"""The extend-repositories-info stage over landed files.

``extend_repositories_info(spark, root)`` reads every repository's commit map, repo
info and entity files under ``root`` (``<root>/<owner>/<repo><suffix>``) and returns
``(extended, rejects)``: one row per repository with entity totals and the named
analysis, and the repositories that lack commits or repo info.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.operators import commits as cf
from repochron.operators import cycles as cyc
from repochron.operators import eventlog as el
from repochron.operators import growth
from repochron.operators import summary as sm
from repochron.operators.validate import drop_suffix_columns, map_drop_suffix
from repochron.session import write_through
from repochron.sources import gitlog as gl
from repochron.sources import landing as ld

KEY = ("owner", "repo")
ENTITIES = ("issues", "issue_events", "issue_comments", "pull_requests", "commit_comments",
            "cicd_artifacts", "cicd_workflows", "cicd_workflow_runs", "releases", "pages")
LOG_ENTITIES = ("issues", "issue_comments", "issue_events", "pull_requests")


def land(spark: SparkSession, root: str, entities: Sequence[str] = ENTITIES) -> dict[str, DataFrame]:
    """Parse every landed file once: tables by name, written under the shared folder, and ``unreadable`` with the files
    that the same parse rejects. All stages take the result."""
    tables, rejects = {}, []
    for name in ("commits", "repo_info", *entities):
        rows, bad = ld.landed(spark, root, name)
        tables[name] = write_through(rows, "land-repo-info") if name == "repo_info" else rows
        rejects.append(bad)
    tables["unreadable"] = write_through(reduce(DataFrame.unionByName, rejects), "land-unreadable")
    return tables


def extend_repositories_info(spark: SparkSession, root: str, kind: str = "general",
                             done: DataFrame | None = None, force: bool = False,
                             as_of: float | None = None, key: Sequence[str] = KEY,
                             repos: DataFrame | None = None,
                             landed: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Repositories need both commits and repo info (others go to rejects, as do
    unreadable files); ``repos`` (``key`` columns) is the driving list, without it all
    repositories that have either file. J03: repositories in ``done`` (the completion
    manifest) are skipped unless ``force``; P01 / P02: ``*_url`` fields dropped (columns and
    ``tail``), owner from the path; J01: entity totals (absent = 0); X01: the analysis
    ``kind`` (``general``, ``snakemake``) by name."""
    k = list(key)
    t = landed if landed is not None else land(spark, root)
    commits = t["commits"]
    info = drop_suffix_columns(t["repo_info"]).withColumn("tail", map_drop_suffix("tail"))
    have = commits.select(*k).distinct()
    known = (repos.select(*k) if repos is not None else have.unionByName(info.select(*k))).distinct()
    rejects = sm.rejects(known, "extend_repositories_info",
                         {"no extracted commits": have, "no repository info": info}, key=k)
    rejects = rejects.unionByName(t["unreadable"])
    todo = sm.require_all(info.join(known, k, "left_semi"), have, key=k)
    if done is not None:
        todo = sm.resume(todo, done, key=k, force=force)
    totals = sm.entity_counts(todo, {name: t[name] for name in ENTITIES if name in t}, key=k)
    extended = sm.analysis(kind)(totals, commits.join(todo.select(*k), k, "left_semi"), key=k, as_of=as_of)
    return extended, rejects


def evolution_cycles_of(spark: SparkSession, root: str, prefix: str = "snakemake", key: Sequence[str] = KEY,
                        landed: dict[str, DataFrame] | None = None) -> DataFrame:
    """The flat cycle table of every repository, beside the extended info."""
    commits = landed["commits"] if landed is not None else write_through(ld.read_commits(spark, root), "land-commits")
    return cyc.evolution_cycles(commits, list(key), prefix)


def event_logs(spark: SparkSession, root: str, prefix: str = "snakemake", key: Sequence[str] = KEY,
               landed: dict[str, DataFrame] | None = None) -> DataFrame:
    """Event logs of every evolution cycle of every repository under ``root``
    (issues, comments, issue events, pull requests and commits from the landed files)."""
    k = list(key)
    t = landed if landed is not None else land(spark, root, LOG_ENTITIES)
    rows = write_through(cyc.cycle_rows(t["commits"], k, prefix), "cycle-rows")
    cycles = cyc.evolution_cycles(t["commits"], k, prefix, rows=rows)
    return el.event_log(cycles, t["issues"], t["issue_comments"], t["issue_events"], t["pull_requests"],
                        t["commits"], rows, k, prefix)


def event_log_rejects(spark: SparkSession, root: str, key: Sequence[str] = KEY,
                      landed: dict[str, DataFrame] | None = None) -> DataFrame:
    """What the event logs leave out, with the reason."""
    t = landed if landed is not None else land(spark, root, LOG_ENTITIES)
    return el.event_rejects(t["issues"], t["issue_comments"], t["issue_events"], t["pull_requests"], t["commits"], key)


def commit_log_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The 14-field commit table of every repository under ``root`` and the lines
    rejected. Per repository folder: ``commits.log``; ``numstat.txt``, ``names.txt``, ``tags.txt`` and
    ``branches.txt`` with lines ``<hash><TAB><git's line>`` (each may be missing)."""
    lines = ld.read_repo_text(spark, root, "commits.log")

    def by_hash(suffix):
        try:
            text = ld.read_repo_text(spark, root, suffix)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return text.where(F.col("value").rlike("^[0-9A-Fa-f]+\t")).select(
            "repo", F.substring_index("value", "\t", 1).alias("hash"),
            F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))

    def refs(rows, name):
        return None if rows is None else rows.select(F.col("repo").alias("repo_name"), F.col("hash").alias("commit_hash"),
                                                     F.col("value").alias(name))

    stat, names = by_hash("numstat.txt"), by_hash("names.txt")
    totals = None if stat is None else gl.parse_numstat(stat)
    totals = totals if totals is None else (gl.numstat_totals(totals) if names is not None else gl.numstat_commit_stats(totals))
    files = None if names is None else gl.changed_files(names)
    rows = gl.assemble_commits(gl.parse_log_lines(lines), totals, files, refs(by_hash("tags.txt"), "tag"),
                               refs(by_hash("branches.txt"), "branch"))
    return rows, gl.log_rejects(lines)


def codebase_growth_of(spark: SparkSession, patches_path: str, commits: DataFrame,
                       key: Sequence[str] = ("repo",)) -> DataFrame:
    """Growth rows per repository from exported patches and commits
    (``hash, committed_at, message``): size per commit, running total oldest first."""
    k = list(key)
    sizes = growth.commit_sizes(ld.read_patches(spark, patches_path), commits, key=k)
    g = growth.codebase_growth(sizes.withColumn("__t", F.unix_micros("committed_at")), key=k,
                               order=("__t", "hash"),
                               bucket=F.floor(F.col("__t") / F.lit(86_400_000_000)).cast("bigint"))
    return growth.commit_size_rows(g, key=k)


def commit_facts_of(commits: DataFrame, prefix: str = "snakemake",
                    key: Sequence[str] = KEY) -> DataFrame:
    """Extraction-time analysis of landed commits: workflow columns computed from the
    files' code (X02), extension and change-type sets (A23, A24), attached to every
    commit (commits without workflow files get the defaults)."""
    k = list(key)
    files = ld.commit_files_of(commits)
    facts = cf.commit_workflow_facts(cf.file_workflow_columns(files, prefix=prefix), k, prefix)
    sets = cf.commit_file_sets(files, k)
    base = commits.drop(*[c for c in commits.columns
                          if c.startswith(f"{prefix}_") or c in ("file_extensions", "change_types")])
    out = cf.attach_facts(base, facts, k, prefix).join(sets, [*k, "hash"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("file_extensions", F.coalesce("file_extensions", empty)) \
              .withColumn("change_types", F.coalesce("change_types", empty))
