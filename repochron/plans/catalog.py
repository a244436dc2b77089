"""Registered queries: library operators applied to the stand-in views.

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a lazy
DataFrame whose columns match the oracle SQL of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.functions import workflow_code as wc
from repochron.functions.scalars import identity, last_url_segment, text_to_utc
from repochron.operators import calendar as cal
from repochron.operators import commits as cf
from repochron.operators import cycles as cyc
from repochron.operators import dag
from repochron.operators import distincts as dis
from repochron.operators import entities as ent
from repochron.operators import eventlog as el
from repochron.operators import growth
from repochron.operators import incremental as inc
from repochron.operators import metrics as pm
from repochron.operators import summary as sm
from repochron.operators import validate as val
from repochron.plans import standins as sv
from repochron.session import write_through
from repochron.sources import gitlog as gl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r6(col):
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def _joined(arr):
    return F.array_join(F.array_sort(arr), ",")


# --- codebase growth (flagship) ------------------------------------------------
@query("codebase_growth")
def q_codebase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch bytes of .py/.smk files per commit, running total."""
    sizes = growth.commit_sizes(sv.patches(spark, sf_dir), key=("repo",),
                                commit_cols=("pos", "hash"))
    g = growth.codebase_growth(sizes, key=("repo",), order=("pos",),
                               bucket=F.expr("pos div 1024"))
    return g.select("repo", "pos", "hash", "commit_size", "codebase_size")


@query("commit_size_rows")
def q_commit_size_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth output rows -- commit id, size, ISO date, stripped
    message (the whole texts of the commit's documents, one after the other), running
    codebase size. A commit holds 60 document ids at most."""
    p = sv.patches(spark, sf_dir)
    d = sv.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo"), F.expr(f"doc_id div {sv.DOCS_PER_COMMIT_SPAN}").alias("pos"), "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    meta = d.groupBy("repo", "pos").agg(F.concat(F.lit(" \t\n"), F.array_join(texts, "\n")).alias("message"))
    sizes = growth.commit_sizes(p, key=("repo",), commit_cols=("pos", "hash")).join(meta, ["repo", "pos"])
    sizes = sizes.withColumn("committed_at", F.timestamp_seconds(F.lit(sv.BASE_EPOCH) + F.col("pos") * 86400))
    g = growth.codebase_growth(sizes, key=("repo",), order=("pos",), bucket=F.expr("pos div 1024"))
    return growth.commit_size_rows(g, key=("repo",))


# --- commit order, bursts, cycles --------------------------------------------
@query("commit_order")
def q_commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position by (epoch, hash), previous hash, gap to the next commit."""
    o = cyc.commit_order(sv.commits(spark, sf_dir))
    return o.select("owner", "repo", "hash", "idx", _r6("committer_epoch").alias("committer_epoch"),
                    "prev_hash",
                    _r6(F.col("next_epoch") - F.col("committer_epoch")).alias("gap_next_seconds"))


@query("commit_bursts")
def q_commit_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of commits less than 24 h apart (exactly 24 h splits)."""
    b = cyc.commit_bursts(sv.commits(spark, sf_dir).select("owner", "repo", "hash", "committer_epoch"))
    return b.select("owner", "repo", "hash", "idx", "burst_no", "burst_start", "burst_end",
                    "gap_next_days")


def _flat_cycles(c: DataFrame) -> DataFrame:
    return c.select(
        "owner", "repo", "cycle_no",
        F.col("begin.hash").alias("begin_hash"), _r6("begin.epoch").alias("begin_epoch"),
        F.col("end.hash").alias("end_hash"), _r6("end.epoch").alias("end_epoch"),
        "diff_days", "diff_mins", "diff_hours", "n_commits", "n_commits_snakemake_related",
        "n_snakemake_rules_added", "n_snakemake_rules_removed",
        "n_snakemake_modules_added", "n_snakemake_modules_removed",
        F.array_join("file_extensions", ",").alias("file_extensions"), "is_closed")


@query("evolution_cycles")
def q_evolution_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evolution cycles of every repository."""
    return _flat_cycles(cyc.evolution_cycles(sv.commits(spark, sf_dir)))


@query("cycle_durations")
def q_cycle_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days / hours / minutes between cycle begin and end."""
    c = cyc.evolution_cycles(sv.commits(spark, sf_dir))
    return c.select("owner", "repo", "cycle_no", "diff_days", "diff_hours", "diff_mins")


@query("repo_workflow_summary")
def q_repo_workflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related commits and number of cycles per repository."""
    s = cyc.repo_workflow_summary(sv.commits(spark, sf_dir))
    return s.select("owner", "repo", "n_commits_snakemake_related", "n_evolution_cycles")


# --- commit facts: workflow code parsing (X02) -------------------------------

# Stand-in keywords: the documents hold prose, so "The" plays `rule`, "And"
# plays `module`, and an include is "The <word>" ending in "." (blank separator).
STANDIN_RULE_KW, STANDIN_MODULE_KW = "The", "And"
STANDIN_INCLUDE = dict(keyword="The", sep=" ", suffix=".")


def _names_query(spark, sf_dir, col):
    c = sv.code(spark, sf_dir)
    return c.select("repo", "pos", F.size(col).cast("bigint").alias("n_names"),
                    F.array_join(col, "|").alias("names"))


@query("rule_names")
def q_rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule names per file, in order, repeats kept (whole texts)."""
    return _names_query(spark, sf_dir, wc.rule_names(F.col("source_code"), STANDIN_RULE_KW))


@query("module_names")
def q_module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module names per file."""
    return _names_query(spark, sf_dir, wc.module_names(F.col("source_code"), STANDIN_MODULE_KW))


@query("included_files")
def q_included_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included rule files per file."""
    return _names_query(spark, sf_dir, wc.included_files(F.col("source_code"), **STANDIN_INCLUDE))


@query("irregular_includes")
def q_irregular_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included files without the rule-file suffix."""
    return _names_query(spark, sf_dir, wc.irregular_includes(F.col("source_code"), **STANDIN_INCLUDE))


def _code_wf(spark, sf_dir, compat=True):
    named = cf.code_names(
        sv.code(spark, sf_dir), rule_keyword=STANDIN_RULE_KW, module_keyword=STANDIN_MODULE_KW,
        include_keyword=STANDIN_INCLUDE["keyword"], include_sep=STANDIN_INCLUDE["sep"],
        include_suffix=STANDIN_INCLUDE["suffix"])
    return cf.file_workflow_columns(cf.names_before(named, ("owner", "repo"), ("pos",), F.expr("pos div 4096")), compat=compat)


@query("commit_sizes_first_parent")
def q_commit_sizes_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit sizes from patches exported against every parent; roots by their own patches."""
    patches, commits = sv.patches_to_parents(spark, sf_dir)
    return growth.commit_sizes(patches, commits, key=("repo",)).select("repo", "hash", "commit_size")


@query("commit_file_lists")
def q_commit_file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested list of each commit's files, written as text."""
    entry = F.concat_ws(":", "new_path", F.col("line_no").cast("string"), "change_type")
    lists = cf.files_per_commit(sv.commit_files(spark, sf_dir).withColumn("entry", entry), ("repo",), ["entry"])
    return lists.select("repo", "hash", "n_files", F.array_join(F.transform("files", lambda f: f["entry"]), ",").alias("files"))


@query("rule_diff_occurrences")
def q_rule_diff_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U07 J15 P15 P16 X02 (file level, compat): occurrence differences after vs before;
    module changes land in the rule counters."""
    f = _code_wf(spark, sf_dir)
    return f.select("repo", "pos", "new_path", "snakemake_related",
                    "snakemake_n_rules_added", "snakemake_n_rules_removed",
                    "snakemake_n_modules_added", "snakemake_n_modules_removed")


@query("rule_diff_sets")
def q_rule_diff_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U03 U04 U06 A26-A32 X02 (commit level): distinct sets and set differences."""
    facts = cf.commit_workflow_facts(_code_wf(spark, sf_dir))
    p = "snakemake"
    return facts.select(
        "owner", "repo", "hash", f"{p}_related",
        *[F.array_join(f"{p}_{k}", ",").alias(f"{p}_{k}") for k in cf.SET_KINDS],
        f"{p}_n_rules_added", f"{p}_n_rules_removed",
        f"{p}_n_modules_added", f"{p}_n_modules_removed")


@query("file_extensions")
def q_file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct extensions and change types per commit."""
    s = cf.commit_file_sets(sv.commit_files(spark, sf_dir), key=("repo",))
    return s.select("repo", "hash", F.array_join("file_extensions", ",").alias("file_extensions"),
                    F.array_join("change_types", ",").alias("change_types"))


@query("script_paths")
def q_script_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files, scripts and the related flag per commit."""
    files = sv.commit_files(spark, sf_dir).withColumn("source_code", F.lit(None).cast("string")) \
        .withColumn("source_code_before", F.lit(None).cast("string"))
    facts = cf.commit_workflow_facts(cf.file_workflow_columns(files), key=("repo",))
    return facts.select("repo", "hash", "snakemake_related",
                        F.array_join("snakemake_rule_files", ",").alias("rule_files"),
                        F.array_join("snakemake_included_scripts", ",").alias("included_scripts"))


# --- process metrics (X05) -----------------------------------------------------

RANGE = ("1996-01-01 00:00:00", "1998-06-30 12:00:00")
STANDIN_HUNK_MARKERS = "TA"     # prose lines starting with T or A play +/- lines


def _file_metrics(spark, sf_dir):
    ch = pm.file_changes(sv.commit_files(spark, sf_dir), key=("repo",))
    return pm.file_metrics(ch, key=("repo",))


@query("changeset_stats")
def q_changeset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most / mean files per commit."""
    ch = pm.file_changes(sv.commit_files(spark, sf_dir), key=("repo",))
    s = pm.changeset_stats(ch, key=("repo",))
    return s.select("repo", "changeset_max", _r6("changeset_avg").alias("changeset_avg"))


@query("metrics_in_range")
def q_metrics_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process metrics of the commits between two instants."""
    m, _ = pm.process_metrics(sv.commit_files(spark, sf_dir), ("repo",), None, since=RANGE[0], to=RANGE[1])
    return m.select("repo", "path", "commitscount_files", "codechurn_count", "contributorscount_count", "linescount_count_added")


@query("code_churn")
def q_code_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn per file."""
    m = _file_metrics(spark, sf_dir)
    return m.select("repo", "path", "codechurn_count", "codechurn_max",
                    _r6("codechurn_avg").alias("codechurn_avg"),
                    "codechurn_added_lines", "codechurn_removed_lines")


@query("commits_per_file")
def q_commits_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits per file."""
    return _file_metrics(spark, sf_dir).select("repo", "path", "commitscount_files")


@query("contributors_per_file")
def q_contributors_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and minor (< 5 % of lines) authors per file."""
    return _file_metrics(spark, sf_dir).select("repo", "path", "contributorscount_count",
                                               "contributorscount_minor")


@query("contributor_experience")
def q_contributor_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top author's share of a file's lines, in percent."""
    m = _file_metrics(spark, sf_dir)
    return m.select("repo", "path",
                    _r6("contributorsexperience_count").alias("contributorsexperience_count"))


@query("line_counts")
def q_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added / removed line totals, maxima and means per file."""
    m = _file_metrics(spark, sf_dir)
    return m.select("repo", "path", "linescount_count", "linescount_count_added",
                    "linescount_max_added", _r6("linescount_avg_added").alias("linescount_avg_added"),
                    "linescount_count_removed", "linescount_max_removed",
                    _r6("linescount_avg_removed").alias("linescount_avg_removed"))


@query("hunks_median")
def q_hunks_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median hunks per commit of each file (whole texts)."""
    c = sv.code(spark, sf_dir).select("repo", "hash", "new_path", F.col("source_code").alias("patch"),
                                      F.lit(0).alias("n_added_lines"), F.lit(0).alias("n_deleted_lines"),
                                      F.lit("x").alias("author"))
    ch = pm.file_changes(c, key=("repo",), path=F.col("new_path"), hunk_markers=STANDIN_HUNK_MARKERS)
    h = pm.hunks_median(ch, key=("repo",))
    return h.select("repo", "path", _r6("hunkscount_files").alias("hunkscount_files"))


# --- repository summary and list joins ------------------------------------------

AS_OF = 1767225600.0        # "now" pinned for A14 (2026-01-01T00:00:00Z)
MID_JANUARY = 1705363200.0  # 2024-01-16T00:00:00Z, where the second load of repo_distincts_merged begins


@query("repo_totals")
def q_repo_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, committers, first / last commit per repository."""
    s = sm.repo_general_summary(sv.commits(spark, sf_dir), as_of=AS_OF)
    return s.select("owner", "repo", "x_total_commits", "n_commits_distinct", "n_authors",
                    "n_committers", _r6("first_commit_at_epoch").alias("first_commit_at_epoch"),
                    _r6("last_commit_at_epoch").alias("last_commit_at_epoch"),
                    "first_commit_at", "last_commit_at", "first_committer_date",
                    "last_committer_date")


@query("repo_distincts_merged")
def q_repo_distincts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of two loads (before and from mid-January 2024), each a state of bitmaps, merged."""
    key, kinds = ("owner", "repo"), {"n_commits_distinct": "hash", "n_authors": "author", "n_committers": "committer"}
    commits = sv.commits(spark, sf_dir)
    late = F.col("committer_epoch") >= MID_JANUARY
    first = write_through(dis.distinct_values(commits.where(~late), key, kinds), "values")
    numbers = write_through(dis.dictionary(first, key), "dictionary")
    second = write_through(dis.distinct_values(commits.where(late), key, kinds), "values")
    more = write_through(dis.dictionary(second, key, known=numbers), "dictionary")
    state = dis.merge_states(dis.distinct_state(first, numbers, key),
                             dis.distinct_state(second, numbers.unionByName(more), key), key=key)
    return dis.state_counts(state, key, list(kinds))


@query("entity_counts_joined")
def q_entity_counts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-entity totals next to every repository, absent -> 0."""
    commits = sv.commits(spark, sf_dir)
    repos = commits.select("owner", "repo").distinct()
    pages = sv.table(spark, sf_dir, "pages").select(
        F.lit(sv.OWNER).alias("owner"),
        F.concat(F.lit("r"), (F.col("page_id") % 150).cast("string")).alias("repo"))
    ents = {"commits": commits, "issues": sv.issues(spark, sf_dir),
            "issue_events": sv.issue_events(spark, sf_dir),
            "issue_comments": sv.issue_comments(spark, sf_dir),
            "pull_requests": sv.pull_requests(spark, sf_dir), "pages": pages}
    return sm.entity_counts(repos, ents)


def _customers(spark, sf_dir):
    return sv.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo"),
        F.col("c_name").alias("full_name"), "c_acctbal", "c_mktsegment")


def _orders_repos(spark, sf_dir):
    return sv.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo"), "o_orderstatus")


@query("require_semi")
def q_require_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that have commits (orders) and repo info (non-negative balance)."""
    cust = _customers(spark, sf_dir)
    info = cust.filter(F.col("c_acctbal") >= 0)
    return sm.require_all(cust, _orders_repos(spark, sf_dir), info, key=("repo",)) \
        .select("repo", "full_name")


@query("reject_anti")
def q_reject_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories missing an input, with the reason."""
    cust = _customers(spark, sf_dir)
    info = cust.filter(F.col("c_acctbal") >= 0)
    return sm.rejects(cust, "extend_repositories_info",
                      {"no commits": _orders_repos(spark, sf_dir), "no repo info": info}, key=("repo",))


@query("resume_anti")
def q_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories still to do (manifest = segment BUILDING already done)."""
    cust = _customers(spark, sf_dir)
    done = cust.filter(F.col("c_mktsegment") == "BUILDING")
    return sm.resume(cust, done, key=("repo",)).select("repo", "full_name")


@query("skiplist_anti")
def q_skiplist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blacklist (negative balance) union skip list (AUTOMOBILE) removed."""
    cust = _customers(spark, sf_dir)
    merged = sm.merge_skiplists(cust.filter(F.col("c_acctbal") < 0),
                                cust.filter(F.col("c_mktsegment") == "AUTOMOBILE"))
    return sm.skip_list(cust, merged).select("repo", "full_name")


@query("allowlist_semi")
def q_allowlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep repositories named in the allow list (customers with a finished order)."""
    cust = _customers(spark, sf_dir)
    allowed = (_orders_repos(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
               .join(cust.select("repo", "full_name"), "repo").select("full_name"))
    return sm.allow_list(cust, allowed).select("repo", "full_name")


# --- event logs -----------------------------------------------------------------------

LOG_OUT = ("owner", "repo", "cycle_no", "case_id", "activity", "t", "timestamp", "user")


def _cycles(spark, sf_dir):
    return cyc.evolution_cycles(sv.commits(spark, sf_dir))


@query("eventlog_issues")
def q_eventlog_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue opened / closed inside each cycle."""
    a = el.issue_activities(sv.issues(spark, sf_dir))
    return el.attach_cycles(a, _cycles(spark, sf_dir)).select(*LOG_OUT)


@query("eventlog_comments")
def q_eventlog_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments inside each cycle."""
    a = el.comment_activities(sv.issue_comments(spark, sf_dir))
    return el.attach_cycles(a, _cycles(spark, sf_dir)).select(*LOG_OUT)


@query("eventlog_events")
def q_eventlog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue events inside each cycle (null actor kept)."""
    a = el.issue_event_activities(sv.issue_events(spark, sf_dir))
    return el.attach_cycles(a, _cycles(spark, sf_dir)).select(*LOG_OUT)


@query("eventlog_commits")
def q_eventlog_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits inside each cycle; Committed-Snakemake when the
    cycle added rules or modules."""
    a = el.commit_activities(sv.commits(spark, sf_dir))
    return el.attach_cycles(a, _cycles(spark, sf_dir)).select(*LOG_OUT)


@query("eventlog_prs")
def q_eventlog_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests opened inside each cycle."""
    a = el.pr_activities(sv.pull_requests(spark, sf_dir))
    return el.attach_cycles(a, _cycles(spark, sf_dir)).select(*LOG_OUT)


@query("eventlog_pr_commits")
def q_eventlog_pr_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits under merged pull requests (no time filter)."""
    order = sv.narrow_order(spark, sf_dir)
    cwp = sv.commits_with_parents(spark, sf_dir, order)
    pr = el.pr_commit_activities(sv.pull_requests(spark, sf_dir), cwp, order)
    return pr.select("owner", "repo", "case_id", "activity", "t", "timestamp", "user", "commit_hash")


@query("eventlog_pr_wide")
def q_eventlog_pr_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits under pull requests whose ranges are as wide as the history, per pull request."""
    found = el.pr_commit_activities(*sv.wide_pull_requests(spark, sf_dir))
    return found.groupBy("repo", "case_id", "user").agg(
        F.count(F.lit(1)).alias("n_commits"), F.sum("t").alias("sum_t"), F.min("commit_hash").alias("first_hash"),
        F.max("commit_hash").alias("last_hash"))


@query("eventlog_all")
def q_eventlog_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log (per-cycle activities plus PR commits per repository).
    The cycle rows are computed once and also serve as the commit order."""
    commits = sv.commits(spark, sf_dir)
    rows = write_through(cyc.cycle_rows(commits), "cyclerows")
    cycles = cyc.evolution_cycles(commits, rows=rows)
    log = el.event_log(cycles, sv.issues(spark, sf_dir),
                       sv.issue_comments(spark, sf_dir), sv.issue_events(spark, sf_dir),
                       sv.pull_requests(spark, sf_dir), sv.commits_with_parents(spark, sf_dir, rows),
                       rows)
    return log.select(*LOG_OUT)


@query("eventlog_dedupe")
def q_eventlog_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log in which a commit under a pull request isn't listed again by itself."""
    commits = sv.commits(spark, sf_dir)
    rows = write_through(cyc.cycle_rows(commits), "cyclerows")
    log = el.event_log(cyc.evolution_cycles(commits, rows=rows), sv.issues(spark, sf_dir), sv.issue_comments(spark, sf_dir),
                       sv.issue_events(spark, sf_dir), sv.pull_requests(spark, sf_dir),
                       sv.commits_with_parents(spark, sf_dir, rows), rows, dedupe=True)
    return log.select(*LOG_OUT)


# --- calendar, upsert, validation, commit-log parsing --------------------------------


def _order_spans(spark, sf_dir):
    o = sv.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("repo"), F.col("o_orderstatus").alias("status")) \
        .agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))


def _ranges(spark, sf_dir, interval):
    r = cal.date_ranges(_order_spans(spark, sf_dir), "start", "end", interval)
    return r.select("repo", "status", F.col("range_start").cast("string").alias("range_start"),
                    F.col("range_end").cast("string").alias("range_end"))


@query("date_ranges_month")
def q_date_ranges_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ranges between each group's first and last order."""
    return _ranges(spark, sf_dir, "m")


@query("date_ranges_week")
def q_date_ranges_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monday-Sunday ranges, first Monday not clipped."""
    return _ranges(spark, sf_dir, "w")


@query("date_ranges_day")
def q_date_ranges_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range per day."""
    return _ranges(spark, sf_dir, "d")


@query("upsert_latest")
def q_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as repository search results keyed by partkey % 500,
    merged in partkey order (later wins); allow list = brands other than Brand#55."""
    p = sv.table(spark, sf_dir, "part")
    rows = p.select((F.col("p_partkey") % 500).alias("id"), F.col("p_name").alias("name"),
                    F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name")).alias("full_name"),
                    F.concat(F.lit("https://example.org/"), F.col("p_brand")).alias("html_url"),
                    F.col("p_type").alias("description"),
                    F.col("p_size").cast("bigint").alias("stargazers_count"),
                    F.floor("p_retailprice").cast("bigint").alias("forks_count"),
                    F.col("p_partkey").alias("load_order"))
    allowed = rows.filter(~F.col("full_name").startswith("Brand#55/")).select("full_name")
    return inc.upsert(None, rows, allowed=allowed)


@query("key_by_last")
def q_key_by_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event per user by (ts, event_id)."""
    ev = sv.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    out = inc.key_by_last(ev, "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id", "event_type")


@query("split_full_name")
def q_split_full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths as owner/repo names, checks and last segment."""
    pg = sv.table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+/", "")
    df = val.split_full_name(pg.select("page_id", "url", path.alias("full_name")))
    return df.select("page_id", "full_name", "owner", "repo", "valid",
                     val.is_full_name("full_name").alias("is_full_name"),
                     val.is_commit_hash(F.sha1("url")).alias("hash_ok"),
                     last_url_segment(F.col("url")).alias("last_segment"))


@query("drop_url_columns")
def q_drop_url_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository info with every top-level *_url column dropped, owner set."""
    pg = sv.table(spark, sf_dir, "pages")
    info = pg.select(F.col("page_id").alias("id"), F.col("url").alias("html_url"),
                     F.concat(F.col("url"), F.lit(".git")).alias("clone_url"),
                     F.col("url").alias("homepage"), F.length("html").alias("size"))
    out = val.drop_suffix_columns(info).withColumn("owner", F.lit(sv.OWNER))
    return out.select("id", "homepage", "size", "owner")


@query("log_lines_parsed")
def q_log_lines_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit rows of all log lines (a subject may hold bars)."""
    log = gl.parse_log_lines(sv.log_lines(spark, sf_dir)).filter("valid")
    return log.select("repo_name", "commit_hash", "author", "committer", "date", "message",
                      "parent_commit")


@query("log_rejects")
def q_log_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict reading (exactly six parts) rejects, with the reason."""
    return gl.log_rejects(sv.log_lines(spark, sf_dir), strict=True)


@query("numstat_totals")
def q_numstat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added / deleted per commit of a repository from numstat text."""
    return gl.numstat_totals(gl.parse_numstat(sv.numstat_lines(spark, sf_dir)))


def _commit_rows(rows: DataFrame) -> DataFrame:
    return rows.select("repo_name", "commit_hash", "author", "committer", "date", "message",
                       "parent_commit", "branch", F.array_join("tags", ",").alias("tags"),
                       F.array_join("changed_files", ",").alias("changed_files"),
                       "lines_added", "lines_deleted", "is_merge_commit", "merged_branch")


@query("git_commits")
def q_git_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14-field commit rows (no refs landed: branch unknown)."""
    stats = gl.numstat_commit_stats(gl.parse_numstat(sv.numstat_lines(spark, sf_dir)))
    return _commit_rows(gl.assemble_commits(gl.parse_log_lines(sv.log_lines(spark, sf_dir)), totals=stats))


@query("git_commits_with_refs")
def q_git_commits_with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tags, branch names and merged branches joined in."""
    stats = gl.numstat_commit_stats(gl.parse_numstat(sv.numstat_lines(spark, sf_dir)))
    tags, branches = sv.log_refs(spark, sf_dir)
    return _commit_rows(gl.assemble_commits(gl.parse_log_lines(sv.log_lines(spark, sf_dir)), totals=stats,
                                            tags=tags, branches=branches))


@query("eventlog_rejects")
def q_eventlog_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of the event log, with every ninth date broken and the next one missing."""
    def broken(df, id_col):
        n = F.col(id_col) % 9
        return df.withColumn("created_at", F.when(n == 0, F.concat(F.lit("x"), "created_at")).when(n != 1, F.col("created_at")))

    iss = broken(sv.issues(spark, sf_dir), "number")
    iss = iss.withColumn("closed_at", F.when(F.col("number") % 7 == 3, F.lit("2024-13-01T00:00:00Z")).otherwise(F.col("closed_at")))
    commits = sv.commits_with_parents(spark, sf_dir)
    return el.event_rejects(iss, broken(sv.issue_comments(spark, sf_dir), "id"), broken(sv.issue_events(spark, sf_dir), "id"),
                            broken(sv.pull_requests(spark, sf_dir), "number"), commits.where("event_id % 13 <> 0"))


@query("typed_values")
def q_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type test and typed default of a field of ``props``."""
    ev = sv.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select("event_id", val.has_type(k, "int").alias("is_int"), val.has_type("event_type", "int").alias("type_is_int"),
                     val.with_default(F.when(k.cast("int") >= 20, k), 7, kind="int").alias("k"))


@query("upsert_existing")
def q_upsert_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge into an existing table that has a column of its own; an empty allow list is no filter."""
    pg = sv.table(spark, sf_dir, "pages")
    info = pg.select(F.col("page_id").alias("id"), F.col("url").alias("name"),
                     F.concat(F.lit("o/"), (F.col("page_id") % 40).cast("string")).alias("full_name"),
                     F.col("url").alias("html_url"), F.lit("d").alias("description"),
                     F.length("url").alias("stargazers_count"), F.length("html").alias("forks_count"),
                     F.col("page_id").alias("load_order"))
    old = info.where("id % 3 = 0").withColumn("name", F.lit("old")).withColumn("note", F.concat(F.lit("n"), F.col("id").cast("string")))
    allowed = info.select("full_name").where("full_name is null")
    out = inc.upsert(old, info.where("id % 3 <> 0 or id % 2 = 0"), allowed=allowed)     # old and new rows hold every page
    return out.select("id", "name", "full_name", "stargazers_count", "forks_count", "note")


@query("written_keys")
def q_written_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written by an upsert with an allow list."""
    pg = sv.table(spark, sf_dir, "pages")
    info = pg.select(F.col("page_id").alias("id"), F.col("url").alias("name"),
                     F.concat(F.lit("o/"), (F.col("page_id") % 40).cast("string")).alias("full_name"),
                     F.col("url").alias("html_url"), F.lit("d").alias("description"),
                     F.length("url").alias("stargazers_count"), F.length("html").alias("forks_count"),
                     F.col("page_id").alias("load_order"))
    allowed = info.where("id % 40 < 25").select("full_name")
    return inc.written_keys(inc.upsert(None, info, allowed=allowed))


# --- commit graph ------------------------------------------------------------------------


def _graph(spark, sf_dir):
    order = sv.narrow_order(spark, sf_dir, "snakemake_n_rules_added")
    cwp = sv.commits_with_parents(spark, sf_dir, order)
    edges = dag.parent_edges(cwp)
    refs = (order.filter(F.col("snakemake_n_rules_added") == 1)
            .select("owner", "repo", "hash", F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("ref")))
    return edges, refs


@query("nearest_ref")
def q_nearest_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest ref (signup events play tags) of every reachable commit."""
    edges, refs = _graph(spark, sf_dir)
    return dag.nearest_ref(edges, refs).select("owner", "repo", "hash", "ref", "depth", "name")


@query("tags_containing")
def q_tags_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (commit, tag) with the commit in the tag's history."""
    edges, refs = _graph(spark, sf_dir)
    return dag.tags_containing(edges, refs.withColumnRenamed("ref", "tag"))


@query("nearest_ref_ladder")
def q_nearest_ref_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository with a merge at every commit, cut into blocks of 4096 commits."""
    edges, refs = sv.ladder(spark, sf_dir)
    return dag.nearest_ref(edges, refs, block=4096).select("repo", "hash", "ref", "depth")


# --- entity filters and joins ----------------------------------------------------------


@query("issue_comment_counts")
def q_issue_comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of issues with comments, per issue, plus their events."""
    issues = sv.issues(spark, sf_dir)
    com = ent.issue_comment_rows(issues, sv.issue_comments(spark, sf_dir))
    evs = ent.issue_event_rows(issues, sv.issue_events(spark, sf_dir))
    rows = ent.concat_lists(com.select("owner", "repo", "number", F.lit("comment").alias("kind")),
                            evs.select("owner", "repo", "number", F.lit("event").alias("kind")))
    return rows.groupBy("owner", "repo", "number").agg(
        F.count_if(F.col("kind") == "comment").cast("bigint").alias("n_comments"),
        F.count_if(F.col("kind") == "event").cast("bigint").alias("n_events"))


@query("repo_info_extended")
def q_repo_info_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extended repository info of the default pipeline
    target -- entity totals, general summary and workflow summary by analysis name."""
    commits = sv.commits(spark, sf_dir)
    repos = commits.select("owner", "repo").distinct() \
        .withColumn("full_name", F.concat_ws("/", "owner", "repo"))
    pages = sv.table(spark, sf_dir, "pages").select(
        F.lit(sv.OWNER).alias("owner"),
        F.concat(F.lit("r"), (F.col("page_id") % 150).cast("string")).alias("repo"))
    info = sm.entity_counts(repos, {"issues": sv.issues(spark, sf_dir),
                                    "issue_events": sv.issue_events(spark, sf_dir),
                                    "issue_comments": sv.issue_comments(spark, sf_dir),
                                    "pull_requests": sv.pull_requests(spark, sf_dir), "pages": pages})
    ext = sm.analysis("snakemake")(info, commits, as_of=AS_OF, distincts=("n_authors", "n_committers"))
    return ext.select(
        "owner", "repo", "full_name", "x_total_commits", "x_total_issues", "x_total_issue_events",
        "x_total_issue_comments", "x_total_pull_requests", "x_total_pages", "n_authors", "n_committers",
        _r6("first_commit_at_epoch").alias("first_commit_at_epoch"),
        _r6("last_commit_at_epoch").alias("last_commit_at_epoch"), "first_commit_at", "last_commit_at",
        "n_commits_snakemake_related", "n_evolution_cycles")


@query("commit_parents")
def q_commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent edges with position, the parent's commit date and the merge flag."""
    cwp = sv.commits_with_parents(spark, sf_dir)
    e = dag.with_parent_dates(cwp)
    merges = cwp.select("owner", "repo", F.col("hash").alias("child"),
                        (F.size("parents") > 1).alias("is_merge"))
    return e.join(merges, ["owner", "repo", "child"]).select(
        "owner", "repo", "child", F.col("pos").cast("bigint").alias("pos"), "parent",
        "parent_committer_date", "is_merge")


# --- filters, projections, totals and scalars on the given tables ---------------------------
@query("issue_pull_requests")
def q_issue_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail of every issue that is a pull request."""
    issues = sv.issues(spark, sf_dir)
    marked = issues.withColumn("pull_request", F.when(F.col("number") % 3 == 0, F.struct(F.lit("u").alias("url"))))
    detail = issues.select("owner", "repo", "number", F.col("comments").alias("n_reviews"))
    return ent.issue_pull_requests(marked, detail)


@query("related_commits")
def q_related_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits flagged as related to the workflow."""
    return ent.related_commits(sv.commits(spark, sf_dir)).select("owner", "repo", "hash")


@query("repos_with_issues")
def q_repos_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories whose feature flag is set (absent = false)."""
    k = F.col("c_custkey")
    flag = F.when(k % 5 == 0, F.lit(None).cast("boolean")).otherwise(k % 3 == 0)
    repos = sv.table(spark, sf_dir, "customer").select(F.col("c_name").alias("repo"), flag.alias("has_issues"))
    return ent.feature_gate(repos, "has_issues").select("repo")


@query("commit_fields")
def q_commit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the kept commit fields, missing ones null."""
    out = cf.project_commits(sv.commits(spark, sf_dir))
    return out.select("owner", "repo", "hash", "author", "committer", "committer_date",
                      _r6("committer_epoch").alias("committer_epoch"), F.col("msg").cast("string").alias("msg"))


@query("file_fields")
def q_file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept fields of modified files, missing ones null."""
    out = cf.project_files(sv.commit_files(spark, sf_dir), key=("repo",))
    return out.select("repo", "hash", "new_path", "filename", "change_type", "n_added_lines", "n_deleted_lines",
                      F.col("old_path").cast("string").alias("old_path"))


@query("entity_totals_other")
def q_entity_totals_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of comments on commits, CI artifacts, workflows, runs and releases."""
    def of(name, col, n):
        return sv.table(spark, sf_dir, name).select(
            F.lit(sv.OWNER).alias("owner"), F.concat(F.lit("r"), (F.col(col) % n).cast("string")).alias("repo"))

    ents = {"commit_comments": of("orders", "o_orderkey", 150), "cicd_artifacts": of("lineitem", "l_partkey", 90),
            "cicd_workflows": of("supplier", "s_suppkey", 150), "cicd_workflow_runs": of("customer", "c_custkey", 70),
            "releases": of("part", "p_partkey", 40)}
    return sm.entity_counts(sv.commits(spark, sf_dir).select("owner", "repo").distinct(), ents)


@query("stage_totals")
def q_stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done and failed counts of a stage."""
    o = sv.table(spark, sf_dir, "orders")
    return sm.stage_totals(o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 7 = 0"), "extract")


@query("identities")
def q_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities and instants parsed from texts with an offset."""
    o = sv.table(spark, sf_dir, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return o.select("o_orderkey", identity(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("who"),
                    F.unix_timestamp(text_to_utc(text)).alias("epoch"))


@query("date_ranges_backwards")
def q_date_ranges_backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start after the end gives no range, others stay; an unknown interval gives none."""
    sp = _order_spans(spark, sf_dir)
    back = F.col("status") == "F"
    sp = sp.select("repo", "status", F.when(back, F.col("end")).otherwise(F.col("start")).alias("start"),
                   F.when(back, F.col("start")).otherwise(F.col("end")).alias("end"))
    out = cal.date_ranges(sp, "start", "end", "m").unionByName(cal.date_ranges(sp, "start", "end", "y"))
    return out.select("repo", "status", F.col("range_start").cast("string").alias("range_start"),
                      F.col("range_end").cast("string").alias("range_end"))


@query("eventlog_sorted")
def q_eventlog_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits under merged pull requests in time order."""
    order = sv.narrow_order(spark, sf_dir)
    cwp = sv.commits_with_parents(spark, sf_dir, order)
    log = el.pr_commit_activities(sv.pull_requests(spark, sf_dir), cwp, order).withColumn(
        "cycle_no", F.lit(None).cast("bigint"))
    return el.sort_event_log(log).select("owner", "repo", "case_id", "activity", "t", "timestamp", "user", "commit_hash")
