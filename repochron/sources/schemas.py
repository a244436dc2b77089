"""Explicit schemas of the landed inputs (only the fields the operators use)."""

from pyspark.sql import types as T

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _f(name, dtype):
    return T.StructField(name, dtype, True)


LOGIN = T.StructType([_f("login", _s)])

FILE = T.StructType([_f(n, t) for n, t in (
    ("old_path", _s), ("new_path", _s), ("filename", _s), ("change_type", _s),
    ("n_added_lines", _l), ("n_deleted_lines", _l), ("n_lines", _l), ("complexity", _l),
    ("n_tokens", _l), ("source_code", _s), ("source_code_before", _s))])

COMMIT = T.StructType([_f(n, t) for n, t in (
    ("msg", _s), ("author", _s), ("committer", _s), ("author_date", _s), ("author_epoch", _d),
    ("committer_date", _s), ("committer_epoch", _d), ("branches", T.ArrayType(_s)),
    ("is_main_branch", _b), ("is_merge", _b), ("parents", T.ArrayType(_s)),
    ("files", T.ArrayType(FILE)), ("file_extensions", T.ArrayType(_s)),
    ("change_types", T.ArrayType(_s)), ("n_deletions", _l), ("n_insertions", _l),
    ("n_lines", _l), ("n_files", _l), ("dmm_unit_size", _d), ("dmm_unit_complexity", _d),
    ("dmm_unit_interfacing", _d))] + [
    # Workflow columns present when commits were extracted for the workflow analysis.
    _f("snakemake_related", _b)] + [
    _f(f"snakemake_{n}", T.ArrayType(_s)) for n in (
        "modules_from_code", "modules_from_code_before", "rules_from_code", "rules_from_code_before",
        "included_rules", "included_scripts", "irregular_rule_files", "rule_files")] + [
    _f(f"snakemake_n_{n}", _l) for n in ("modules_added", "modules_removed", "rules_added", "rules_removed")])

ISSUE = T.StructType([_f("number", _l), _f("created_at", _s), _f("closed_at", _s),
                      _f("comments", _l), _f("pull_request", T.MapType(_s, _s)), _f("user", LOGIN)])
ISSUE_COMMENT = T.StructType([_f("id", _l), _f("issue_url", _s), _f("created_at", _s), _f("user", LOGIN)])
ISSUE_EVENT = T.StructType([_f("id", _l), _f("event", _s), _f("created_at", _s), _f("actor", LOGIN),
                            _f("issue", T.StructType([_f("number", _l)]))])
PULL_REQUEST = T.StructType([_f("number", _l), _f("created_at", _s), _f("merge_commit_sha", _s),
                             _f("user", LOGIN)])
RAW_ITEM = T.StructType([_f("id", _l)])

REPO_INFO = T.StructType([_f("id", _l), _f("name", _s), _f("full_name", _s), _f("has_issues", _b),
                          _f("has_pages", _b), _f("description", _s), _f("stargazers_count", _l),
                          _f("forks_count", _l)])

SEARCH_ITEM = T.StructType([_f("id", _l), _f("name", _s), _f("full_name", _s), _f("html_url", _s),
                            _f("description", _s), _f("stargazers_count", _l), _f("forks_count", _l)])
SEARCH_PAGE = T.StructType([_f("total_count", _l), _f("items", T.ArrayType(SEARCH_ITEM))])

ENTITY_SCHEMAS = {
    "issues": ISSUE,
    "issue_comments": ISSUE_COMMENT,
    "issue_events": ISSUE_EVENT,
    "pull_requests": PULL_REQUEST,
}
