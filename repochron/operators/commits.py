"""Commit facts.

``commit_files`` carries one row per modified file with the code after and
before the change; the per-file workflow columns are regular expressions over
the whole text (JVM side). Per-commit sets are built from exploded, de-duplicated
names, so a group holds distinct names only, never whole file lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.functions import workflow_code as wc
from repochron.functions.scalars import file_extension
from repochron.operators.ordered import day_bucket, ordered_scan
from repochron.session import write_through

KEY = ("owner", "repo")


def _empty():
    return F.array().cast("array<string>")


# Per-commit list columns of the workflow analysis, in output order.
SET_KINDS = ("rules_from_code", "rules_from_code_before", "modules_from_code",
             "modules_from_code_before", "included_rules", "included_scripts",
             "irregular_rule_files", "rule_files")

COMMIT_FIELDS = ("hash", "msg", "author", "committer", "author_date", "author_epoch",
                 "committer_date", "committer_epoch", "branches", "is_main_branch",
                 "is_merge", "parents", "n_deletions", "n_insertions", "n_lines", "n_files",
                 "dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing")
FILE_FIELDS = ("old_path", "new_path", "filename", "change_type", "n_added_lines",
               "n_deleted_lines", "n_lines", "complexity", "n_tokens")


def project_commits(commits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """P10: the commit fields the analysis keeps (missing ones become null)."""
    have = set(commits.columns)
    return commits.select(*key, *[F.col(c) if c in have else F.lit(None).alias(c)
                                  for c in COMMIT_FIELDS])


def project_files(files: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The modified-file fields (metrics arrive as input columns)."""
    have = set(files.columns)
    return files.select(*key, "hash", *[F.col(c) if c in have else F.lit(None).alias(c)
                                        for c in FILE_FIELDS])


def code_names(files: DataFrame, rule_keyword: str = wc.RULE_KEYWORD, module_keyword: str = wc.MODULE_KEYWORD,
               include_keyword: str = wc.INCLUDE_KEYWORD, include_sep: str = wc.INCLUDE_SEP,
               include_suffix: str = wc.INCLUDED_RULE_SUFFIX) -> DataFrame:
    """Texts -> ``__names`` (rules, modules) and ``__includes`` (files, irregular) of the code, and ``__names_before``
    where ``source_code_before`` is landed. Each text is parsed once and left behind."""
    def names(text):
        t = F.coalesce(F.col(text), F.lit(""))
        return F.struct(wc.rule_names(t, rule_keyword).alias("rules"), wc.module_names(t, module_keyword).alias("modules"))

    after = F.coalesce(F.col("source_code"), F.lit(""))
    includes = F.struct(wc.included_files(after, include_keyword, include_sep, include_suffix).alias("files"),
                        wc.irregular_includes(after, include_keyword, include_sep, include_suffix).alias("irregular"))
    before = [names("source_code_before").alias("__names_before")] if "source_code_before" in files.columns else []
    return files.select(*[c for c in files.columns if c not in ("source_code", "source_code_before")],
                        names("source_code").alias("__names"), includes.alias("__includes"), *before)


def names_before(named: DataFrame, key: Sequence[str] = (*KEY, "new_path"), order: Sequence[str] = ("committer_epoch", "hash"),
                 bucket=None) -> DataFrame:
    """J15 on names: ``__names_before`` is the ``__names`` of the snapshot before, in a skew-safe ordered scan
    (``key`` is what makes snapshots follow each other, ``bucket`` grows with ``order``; a day by default)."""
    none = F.struct(_empty().alias("rules"), _empty().alias("modules"))
    named = write_through(named, "names")       # both branches of the scan read it, texts are parsed once
    scanned = ordered_scan(named, list(key), list(order), day_bucket(order[0]) if bucket is None else bucket,
                           lags={"__before": F.col("__names")})
    return scanned.withColumn("__names_before", F.coalesce("__before", none)).drop("__before")


def file_workflow_columns(files: DataFrame, prefix: str = "snakemake",
                          rule_keyword: str = wc.RULE_KEYWORD,
                          module_keyword: str = wc.MODULE_KEYWORD,
                          include_keyword: str = wc.INCLUDE_KEYWORD,
                          include_sep: str = wc.INCLUDE_SEP,
                          include_suffix: str = wc.INCLUDED_RULE_SUFFIX,
                          rule_file=None, compat: bool = False) -> DataFrame:
    """X02 per-file columns.

    Rule files (P15) get rule / module names of the code after and before
    (F11, F12), includes (F13, F14) and per-file added / removed occurrence
    counts (U07), modules apart from rules. ``compat=True`` is the compatibility switch:
    module changes are added to the rule counters and module counters stay 0. Script paths (P16)
    are related but carry no names. ``rule_file`` overrides the P15 predicate. Where only snapshots are
    landed, pass what ``code_names`` and ``names_before`` made of them: no text then goes beyond the scan.
    """
    if "__names" not in files.columns:
        files = code_names(files, rule_keyword, module_keyword, include_keyword, include_sep, include_suffix)
    is_rule = rule_file if rule_file is not None else wc.is_rule_file(F.col("filename"))
    is_script = (~is_rule) & F.col("new_path").isNotNull() & wc.is_script_path(
        F.col("filename"), F.col("new_path"))

    def when_rule(name):
        return F.when(is_rule, F.col(name)).otherwise(_empty())

    p = prefix
    out = files.select(
        "*",
        is_rule.alias("__is_rule"), is_script.alias("__is_script"),
        (is_rule | is_script).alias(f"{p}_related"),
        when_rule("__names.rules").alias(f"{p}_rules_from_code"),
        when_rule("__names_before.rules").alias(f"{p}_rules_from_code_before"),
        when_rule("__names.modules").alias(f"{p}_modules_from_code"),
        when_rule("__names_before.modules").alias(f"{p}_modules_from_code_before"),
        when_rule("__includes.files").alias("__included"),
        when_rule("__includes.irregular").alias("__irregular"),
    )
    ra = wc.occurrence_diff(F.col(f"{p}_rules_from_code"), F.col(f"{p}_rules_from_code_before"))
    rr = wc.occurrence_diff(F.col(f"{p}_rules_from_code_before"), F.col(f"{p}_rules_from_code"))
    ma = wc.occurrence_diff(F.col(f"{p}_modules_from_code"), F.col(f"{p}_modules_from_code_before"))
    mr = wc.occurrence_diff(F.col(f"{p}_modules_from_code_before"), F.col(f"{p}_modules_from_code"))
    zero = F.lit(0).cast("bigint")
    if compat:
        out = out.select("*", (ra + ma).alias(f"{p}_n_rules_added"),
                         (rr + mr).alias(f"{p}_n_rules_removed"),
                         zero.alias(f"{p}_n_modules_added"), zero.alias(f"{p}_n_modules_removed"))
    else:
        out = out.select("*", ra.alias(f"{p}_n_rules_added"), rr.alias(f"{p}_n_rules_removed"),
                         ma.alias(f"{p}_n_modules_added"), mr.alias(f"{p}_n_modules_removed"))
    return out


def commit_workflow_facts(files_wf: DataFrame, key: Sequence[str] = KEY,
                          prefix: str = "snakemake") -> DataFrame:
    """X02 per-commit columns from ``file_workflow_columns`` output.

    Sets are distinct and sorted (U06); added / removed counts are set
    differences across all files of the commit (U03, U04); related = any file
    is a rule file or script (A32); rule files = distinct new paths (A26).
    """
    p = prefix
    kinds = {
        "rules_from_code": F.col(f"{p}_rules_from_code"),
        "rules_from_code_before": F.col(f"{p}_rules_from_code_before"),
        "modules_from_code": F.col(f"{p}_modules_from_code"),
        "modules_from_code_before": F.col(f"{p}_modules_from_code_before"),
        "included_rules": F.col("__included"),
        "included_scripts": F.when(F.col("__is_script"), F.array(F.col("new_path"))).otherwise(_empty()),
        "irregular_rule_files": F.col("__irregular"),
        "rule_files": F.when(F.col("__is_rule") & F.col("new_path").isNotNull(),
                             F.array(F.col("new_path"))).otherwise(_empty()),
    }
    long = files_wf.select(
        *key, "hash", F.col(f"{p}_related").alias("__rel"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("names"))
                            for k, v in kinds.items()])).alias("__kv"))
    long = long.select(*key, "hash", "__rel", F.col("__kv.kind").alias("kind"),
                       F.explode_outer("__kv.names").alias("name"))
    agg = long.groupBy(*key, "hash").agg(
        F.bool_or("__rel").alias(f"{p}_related"),
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name"))))
          .alias(f"{p}_{k}") for k in kinds])
    ra, rb = F.col(f"{p}_rules_from_code"), F.col(f"{p}_rules_from_code_before")
    ma, mb = F.col(f"{p}_modules_from_code"), F.col(f"{p}_modules_from_code_before")
    return agg.select(
        *key, "hash", f"{p}_related", *[f"{p}_{k}" for k in kinds],
        wc.set_diff_size(ra, rb).alias(f"{p}_n_rules_added"),
        wc.set_diff_size(rb, ra).alias(f"{p}_n_rules_removed"),
        wc.set_diff_size(ma, mb).alias(f"{p}_n_modules_added"),
        wc.set_diff_size(mb, ma).alias(f"{p}_n_modules_removed"))


def commit_file_sets(files: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Distinct non-empty file extensions (F10) and change types per commit,
    sorted (the reference keeps first-seen order)."""
    ext = file_extension(F.col("filename"))
    return files.groupBy(*key, "hash").agg(
        F.array_sort(F.collect_set(F.when(ext != "", ext))).alias("file_extensions"),
        F.array_sort(F.collect_set("change_type")).alias("change_types"))


def attach_facts(commits: DataFrame, facts: DataFrame, key: Sequence[str] = KEY,
                 prefix: str = "snakemake") -> DataFrame:
    """Commits without workflow files get the defaults (false, empty lists, 0)."""
    p = prefix
    j = commits.join(facts, [*key, "hash"], "left")
    fills = [F.coalesce(F.col(f"{p}_related"), F.lit(False)).alias(f"{p}_related")]
    fills += [F.coalesce(F.col(f"{p}_{k}"), _empty()).alias(f"{p}_{k}") for k in SET_KINDS]
    fills += [F.coalesce(F.col(f"{p}_n_{x}"), F.lit(0).cast("bigint")).alias(f"{p}_n_{x}")
              for x in ("rules_added", "rules_removed", "modules_added", "modules_removed")]
    keep = [c for c in commits.columns]
    return j.select(*keep, *fills)


def attach_code_before(files: DataFrame, key: Sequence[str] = KEY, path_col: str = "new_path",
                       order: Sequence[str] = ("committer_epoch", "hash"),
                       bucket_seconds: int = 86400) -> DataFrame:
    """When only snapshots after each change are landed, the code before is the previous snapshot of the
    same path in commit order. The previous commit is found on keys alone (skew-safe ordered scan, bucketed by day), and
    one join then fetches its text; no window or aggregate carries a text. A file appears once per commit."""
    file = [*key, path_col]
    narrow = files.select(*dict.fromkeys([*file, *order, "hash"]))
    before = ordered_scan(narrow, file, list(order), day_bucket(order[0], bucket_seconds),
                          lags={"__before": F.col("hash")}).select(*file, "hash", "__before").where("__before is not null")
    texts = files.select(*file, F.col("hash").alias("__before"), F.col("source_code").alias("source_code_before"))
    fetched = before.join(texts, [*file, "__before"]).drop("__before")
    return files.join(fetched, [*file, "hash"], "left").select(*files.columns, "source_code_before")


def files_per_commit(files: DataFrame, key: Sequence[str] = KEY, fields: Sequence[str] | None = None) -> DataFrame:
    """``files``, the nested list of a commit's files (``fields`` of each, all but the key by default), sorted; and
    ``n_files``. A list is as long as its commit has files."""
    kept = list(fields) if fields is not None else [c for c in files.columns if c not in (*key, "hash")]
    return files.groupBy(*key, "hash").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("files"),
                                           F.count(F.lit(1)).alias("n_files"))
