"""Repository summary and list joins.

Counts of every entity are one union + one grouped pivot (a single shuffle of
small partial counts), joined onto the repository table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.functions.scalars import epoch_to_str, now
from repochron.operators.cycles import repo_workflow_summary
from repochron.operators.distincts import distinct_counts

KEY = ("owner", "repo")
# Output names of the per-entity totals, in the reference's order.
ENTITY_TOTALS = ("commits", "issues", "issue_events", "issue_comments", "pull_requests",
                 "commit_comments", "cicd_artifacts", "cicd_workflows", "cicd_workflow_runs",
                 "releases", "pages")
DISTINCTS = {"n_commits_distinct": "hash", "n_authors": "author", "n_committers": "committer"}
SUMMARY_TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss' '"   # "%Y-%m-%dT%H:%M:%S %z" of a naive time


def entity_counts(repos: DataFrame, entities: Mapping[str, DataFrame],
                  key: Sequence[str] = KEY) -> DataFrame:
    """A01-A11 + J01: ``x_total_<entity>`` per repository; absent entity -> 0."""
    names = [n for n in ENTITY_TOTALS if n in entities] + [n for n in entities if n not in ENTITY_TOTALS]
    tagged = None
    for name in names:
        part = entities[name].select(*key, F.lit(name).alias("__entity"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy(*key).pivot("__entity", names).count()
    out = repos.join(counts, list(key), "left")
    zero = F.lit(0).cast("bigint")
    return out.select(*repos.columns, *[
        F.coalesce(F.col(n), zero).cast("bigint").alias(f"x_total_{n}") for n in names])


def repo_general_summary(commits: DataFrame, key: Sequence[str] = KEY,
                         as_of: float | None = None, approx_distinct: bool = False,
                         distincts: Sequence[str] = tuple(DISTINCTS)) -> DataFrame:
    """A12 authors, A13 committers, A14 first and A15 last commit (epoch and
    text), A16 first / last committer date, A17 distinct hashes, A01 total.

    ``first_commit_at_epoch = min(now, min epoch)``, ``last = max(0, max epoch)``;
    ``as_of`` pins "now" for reproducible runs. ``approx_distinct`` counts authors and
    committers with HyperLogLog sketches (mergeable partial aggregates, no exact
    distinct step) for very large histories; exact is the default. Exact counts that are
    kept between loads and merged are in ``operators/distincts.py``. ``distincts`` names the counts
    wanted: that of the hashes shuffles every commit, the others only a repository's people."""
    e = F.col("committer_epoch")
    kinds = {k: DISTINCTS[k] for k in distincts}
    sketch = [F.approx_count_distinct(c).cast("bigint").alias(k) for k, c in kinds.items()] if approx_distinct else []
    agg = commits.groupBy(*key).agg(
        F.count(F.lit(1)).cast("bigint").alias("x_total_commits"), *sketch,
        F.min(e).alias("__min"), F.max(e).alias("__max"),
        F.min_by("committer_date", F.struct(e, "hash")).alias("first_committer_date"),
        F.max_by("committer_date", F.struct(e, "hash")).alias("last_committer_date"))
    if kinds and not approx_distinct:
        exact = distinct_counts(commits, key, kinds)
        same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
        agg = agg.alias("a").join(exact.alias("b"), same, "left").select(
            "a.*", *[F.coalesce(f"b.{k}", F.lit(0).cast("bigint")).alias(k) for k in kinds])
    first = F.least(now(is_epoch=True, fractional=False, as_of=as_of).cast("double"), F.col("__min"))
    last = F.greatest(F.lit(0.0), F.col("__max"))
    return agg.select(
        *key, "x_total_commits", *kinds,
        first.alias("first_commit_at_epoch"), last.alias("last_commit_at_epoch"),
        epoch_to_str(first, SUMMARY_TEXT_FORMAT).alias("first_commit_at"),
        epoch_to_str(last, SUMMARY_TEXT_FORMAT).alias("last_commit_at"),
        "first_committer_date", "last_committer_date")


# --- list joins -----------------------------------------------------------------
def require_all(repos: DataFrame, *inputs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keep repositories present in every input (left semi joins)."""
    out = repos
    for other in inputs:
        out = out.join(other.select(*key), list(key), "left_semi")
    return out


def rejects(repos: DataFrame, stage: str, required: Mapping[str, DataFrame],
            key: Sequence[str] = KEY) -> DataFrame:
    """Repositories missing an input, with the first missing one as reason."""
    out = None
    for reason, other in required.items():
        miss = repos.join(other.select(*key), list(key), "left_anti").select(
            *key, F.lit(reason).alias("reason"))
        out = miss if out is None else out.unionByName(miss)
    return (out.groupBy(*key).agg(F.min("reason").alias("reason"))
            .select(F.lit(stage).alias("stage"), *key, "reason"))


def resume(todo: DataFrame, done: DataFrame, key: Sequence[str] = KEY,
           force: bool = False) -> DataFrame:
    """Skip repositories already done unless ``force``."""
    return todo if force else todo.join(done.select(*key), list(key), "left_anti")


def allow_list(repos: DataFrame, allowed: DataFrame | None, col: str = "full_name") -> DataFrame:
    """Keep names in the allow list; no list and an empty list mean no filter."""
    if allowed is None or allowed.isEmpty():
        return repos
    return repos.join(allowed.select(col), [col], "left_semi")


def merge_skiplists(*lists: DataFrame | None, col: str = "full_name") -> DataFrame | None:
    """Union of the lists (either may be absent), de-duplicated, nulls dropped."""
    present = [x.select(F.col(col)) for x in lists if x is not None]
    if not present:
        return None
    out = present[0]
    for x in present[1:]:
        out = out.unionByName(x)
    return out.filter(F.col(col).isNotNull()).distinct()


def skip_list(repos: DataFrame, skip: DataFrame | None, col: str = "full_name") -> DataFrame:
    """Remove names in the merged skip list."""
    if skip is None:
        return repos
    return repos.join(skip.select(col), [col], "left_anti")


def stage_totals(done: DataFrame, failed: DataFrame, stage: str) -> DataFrame:
    """Done and failed counts of a stage (one row, one aggregation)."""
    marks = (done.select(F.lit(1).alias("d"), F.lit(0).alias("f"))
             .unionByName(failed.select(F.lit(0).alias("d"), F.lit(1).alias("f"))))
    return marks.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("n_done"),
                     F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("n_failed")) \
        .select(F.lit(stage).alias("stage"), "n_done", "n_failed")


def assert_non_empty(df: DataFrame, what: str = "result") -> DataFrame:
    """Raise when nothing succeeded (one cheap ``isEmpty`` probe)."""
    if df.isEmpty():
        raise RuntimeError(f"no {what}: nothing succeeded")
    return df


# --- X01: analysis registry -------------------------------------------------------
_ANALYSES: dict[str, Callable[..., DataFrame]] = {}


def register_analysis(kind: str):
    def deco(fn):
        _ANALYSES[kind.lower()] = fn
        return fn
    return deco


def analysis(kind: str) -> Callable[..., DataFrame]:
    """Analysis by name; unknown names raise."""
    try:
        return _ANALYSES[kind.lower()]
    except KeyError:
        raise ValueError(f"No analysis registered for {kind!r}") from None


@register_analysis("general")
def _general(repo_info: DataFrame, commits: DataFrame, key: Sequence[str] = KEY, **kw) -> DataFrame:
    return repo_info.join(repo_general_summary(
        commits, key, kw.get("as_of"), distincts=kw.get("distincts", tuple(DISTINCTS))), list(key), "inner")


@register_analysis("snakemake")
def _snakemake(repo_info: DataFrame, commits: DataFrame, key: Sequence[str] = KEY, **kw) -> DataFrame:
    base = _general(repo_info, commits, key, **kw)
    return base.join(repo_workflow_summary(commits, key, nest=kw.get("nest", False)), list(key), "left")
