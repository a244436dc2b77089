"""Commit order, bursts and evolution cycles.

Reading of the reference's carried-flag loop, restated per row in commit order
(``idx`` = position by ``(committer_epoch, hash)``):

* ``short(i)``: a next commit exists less than 24 h later (exactly 24 h splits);
  a *burst* is a maximal run of commits linked by ``short``;
* ``trigger(i)``: net rule or module change (``added - removed`` non-zero for
  either) and ``i > 0`` -- the first commit only opens a cycle;
* ``active(i)``: a trigger at or before ``i`` inside its burst;
* a cycle closes at the last commit of a burst that holds a trigger.

Each cycle runs from the previous close (the first commit for cycle 1) to its
close; ``n_commits`` counts rows after ``begin`` up to ``end`` plus the first
commit in cycle 1, the related count leaves that first commit out, and
rule / module sums and extensions cover active rows only. Commits after the last
close form a leftover cycle with zero counts; a one-commit history has none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repochron.functions.scalars import DAY_SECONDS, convert_seconds
from repochron.operators.ordered import day_bucket, ordered_scan

KEY = ("owner", "repo")


def _cols(prefix: str) -> dict:
    p = prefix
    return {
        "related": f"{p}_related",
        "ra": f"{p}_n_rules_added", "rr": f"{p}_n_rules_removed",
        "ma": f"{p}_n_modules_added", "mr": f"{p}_n_modules_removed",
    }


def commit_order(commits: DataFrame, key: Sequence[str] = KEY, epoch: str = "committer_epoch",
                 hash_col: str = "hash", bucket_seconds: int = DAY_SECONDS,
                 materialize: bool = False) -> DataFrame:
    """0-based position of each commit by (epoch, hash) within its repo,
    plus previous / next commit epoch and hash (W03)."""
    return ordered_scan(
        commits, key, [epoch, hash_col], day_bucket(epoch, bucket_seconds),
        lags={"prev_epoch": F.col(epoch), "prev_hash": F.col(hash_col)},
        leads={"next_epoch": F.col(epoch)},
        index="idx", materialize=materialize)


def burst_flags(order: DataFrame, epoch: str = "committer_epoch",
                gap_seconds: int = DAY_SECONDS) -> DataFrame:
    """W03 / W04 flags on ``commit_order`` output: gap to the next commit, and
    whether the commit starts / ends a burst (a gap of exactly ``gap_seconds`` splits)."""
    gap = F.col("next_epoch") - F.col(epoch)
    return (order.withColumn("gap_next_seconds", gap)
            .withColumn("gap_next_days", convert_seconds(gap, "d"))
            .withColumn("burst_start", (F.col("prev_epoch").isNull()
                        | ((F.col(epoch) - F.col("prev_epoch")) >= gap_seconds)))
            .withColumn("burst_end", F.col("next_epoch").isNull() | (gap >= gap_seconds)))


def commit_bursts(commits: DataFrame, key: Sequence[str] = KEY, epoch: str = "committer_epoch",
                  hash_col: str = "hash", gap_seconds: int = DAY_SECONDS,
                  bucket_seconds: int = DAY_SECONDS, materialize: bool = False) -> DataFrame:
    """Burst number per commit (commits less than ``gap_seconds`` apart
    share a burst)."""
    o = burst_flags(commit_order(commits, key, epoch, hash_col, bucket_seconds, materialize=True),
                    epoch, gap_seconds)
    return ordered_scan(o, key, [epoch, hash_col], day_bucket(epoch, bucket_seconds),
                        sums={"burst_no": F.col("burst_start").cast("bigint")},
                        materialize=materialize)


def net_change(prefix: str = "snakemake"):
    """(rules added - removed) <> 0 or (modules added - removed) <> 0."""
    c = _cols(prefix)
    z = F.lit(0)
    rules = F.coalesce(F.col(c["ra"]), z) - F.coalesce(F.col(c["rr"]), z)
    mods = F.coalesce(F.col(c["ma"]), z) - F.coalesce(F.col(c["mr"]), z)
    return (rules != 0) | (mods != 0)


def cycle_rows(commits: DataFrame, key: Sequence[str] = KEY, prefix: str = "snakemake",
               epoch: str = "committer_epoch", hash_col: str = "hash",
               gap_seconds: int = DAY_SECONDS, bucket_seconds: int = DAY_SECONDS) -> DataFrame:
    """Per commit, in one fused skew-safe pass: ``idx``, previous / next commit,
    ``burst_start`` / ``burst_end``, ``trigger``, ``active`` (W05), ``closes`` and its
    burst (``burst_epoch`` / ``burst_hash`` = the burst's first commit).

    Buckets are at most as wide as the gap, so two commits of one bucket are always
    less than a gap apart: a burst can only start at a bucket's first commit. Each
    bucket is then summarised by a plain partial aggregate (count, first / last
    commit, last commit with a net change); two chained windows over that small
    table carry counts and "last trigger / last burst start" forward. Positions are
    compared as ``(epoch, hash)`` keys. Joined back, every row has ``active``
    without a second pass over the rows."""
    k = list(key)
    bucket_seconds = min(bucket_seconds, gap_seconds)
    g = F.lit(gap_seconds)
    part = [*k, "__bkt"]
    okey = F.struct(F.col(epoch).alias("e"), F.col(hash_col).alias("h"))
    base = (commits.withColumn("__bkt", day_bucket(epoch, bucket_seconds))
            .withColumn("__net", net_change(prefix)).withColumn("__key", okey))
    w = Window.partitionBy(*part).orderBy(epoch, hash_col)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rn = F.row_number().over(w)
    local = base.select(
        "*", rn.alias("__rn"), F.lag(epoch).over(w).alias("__lag_e"),
        F.lag(hash_col).over(w).alias("__lag_h"), F.lead(epoch).over(w).alias("__lead_e"))
    local = local.select(
        "*", F.max(F.when(F.col("__net") & (F.col("__rn") > 1), F.col("__key"))).over(run).alias("__lt"))

    row = F.struct(F.col(hash_col).alias("hash"), F.col(epoch).alias("epoch"))
    summary = base.groupBy(*part).agg(
        F.count(F.lit(1)).alias("__cnt"),
        F.min_by(row, "__key").alias("__first"), F.max_by(row, "__key").alias("__last"),
        F.min("__key").alias("__first_key"),
        F.min_by("__net", "__key").alias("__net_first"),
        F.max(F.when(F.col("__net"), F.col("__key"))).alias("__net_max"))
    ws = Window.partitionBy(*k).orderBy("__bkt")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part, "__first", "__last", "__first_key", "__net_first", "__net_max",
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__c"),
        F.lag("__last").over(ws).alias("__prev_last"),
        F.lead("__first.epoch").over(ws).alias("__next_first_e"))
    c = F.col("__c")
    carry = carry.select(
        "*",
        (F.col("__prev_last").isNull() | ((F.col("__first.epoch") - F.col("__prev_last.epoch")) >= g))
         .alias("__bs_first"),
        (F.col("__net_first") & (c > 0)).alias("__trig_first"))
    # Last trigger of the bucket: its last net change, unless that is the history's first commit.
    t_b = F.when((F.col("__net_max") == F.col("__first_key")) & ~F.col("__trig_first"),
                 F.lit(None)).otherwise(F.col("__net_max"))
    b_b = F.when(F.col("__bs_first"), F.col("__first_key"))
    carry = carry.select("*", t_b.alias("__t_b"), b_b.alias("__b_b"))
    carry = carry.select(
        "*", F.max("__t_b").over(before).alias("__ct"), F.max("__b_b").over(before).alias("__cb"))
    # A burst can only end at a bucket's last commit, so a bucket closes at most one
    # cycle, and whether it does is known from the bucket summary alone.
    end_t = F.greatest(F.col("__ct"), F.col("__t_b"))
    end_b = F.greatest(F.col("__cb"), F.col("__b_b"))
    bucket_end = F.col("__next_first_e").isNull() | ((F.col("__next_first_e") - F.col("__last.epoch")) >= g)
    carry = carry.select("*", (bucket_end & F.coalesce(end_t >= end_b, F.lit(False)))
                         .cast("bigint").alias("__close_b"))
    carry = carry.select(
        *part, "__c", "__prev_last", "__next_first_e", "__bs_first", "__trig_first", "__first_key",
        "__ct", "__cb", F.coalesce(F.sum("__close_b").over(before), F.lit(0)).alias("__closes_before"))

    j = local.join(carry, part, "inner")
    first = F.col("__rn") == 1
    idx = (c + F.col("__rn") - 1).cast("bigint")
    nxt = F.when(F.col("__lead_e").isNull(), F.col("__next_first_e")).otherwise(F.col("__lead_e"))
    last_t = F.greatest(F.col("__ct"), F.when(F.col("__trig_first"), F.col("__first_key")), F.col("__lt"))
    last_b = F.greatest(F.col("__cb"), F.when(F.col("__bs_first"), F.col("__first_key")))
    out = j.select(
        *commits.columns, idx.alias("idx"),
        F.when(first, F.col("__prev_last.epoch")).otherwise(F.col("__lag_e")).alias("prev_epoch"),
        F.when(first, F.col("__prev_last.hash")).otherwise(F.col("__lag_h")).alias("prev_hash"),
        nxt.alias("next_epoch"),
        (first & F.col("__bs_first")).alias("burst_start"),
        (nxt.isNull() | ((nxt - F.col(epoch)) >= g)).alias("burst_end"),
        F.when(first, F.col("__trig_first")).otherwise(F.col("__net")).alias("trigger"),
        F.coalesce(last_t >= last_b, F.lit(False)).alias("active"),
        last_b["e"].alias("burst_epoch"), last_b["h"].alias("burst_hash"),
        (F.col("__closes_before") + 1).cast("bigint").alias("cycle_no"))
    return out.withColumn("closes", F.col("burst_end") & F.col("active"))


def evolution_cycles(commits: DataFrame, key: Sequence[str] = KEY, prefix: str = "snakemake",
                     epoch: str = "committer_epoch", hash_col: str = "hash",
                     gap_seconds: int = DAY_SECONDS, bucket_seconds: int = DAY_SECONDS,
                     rows: DataFrame | None = None) -> DataFrame:
    """One row per cycle with begin / end, durations, counts and extensions.
    ``rows``: a precomputed ``cycle_rows`` of ``commits`` (it also serves as the
    commit order, so callers needing both compute it once).

    Every row gets its cycle number in the fused row pass (a bucket closes at most
    one cycle, at its last commit); the cycles are then one pre-aggregating
    ``groupBy`` of the rows."""
    k = list(key)
    if rows is None:
        rows = cycle_rows(commits, k, prefix, epoch, hash_col, gap_seconds, bucket_seconds)
    c = _cols(prefix)
    act = F.col("active")
    z = F.lit(0).cast("bigint")

    # a row per extension, of which the first stands for the commit: a cycle's state holds its extensions, not their combinations
    rows = rows.select("*", F.posexplode_outer("file_extensions").alias("__pos", "__ext"))
    one = F.coalesce(F.col("__pos"), F.lit(0)) == 0

    def active_sum(name):
        return F.coalesce(F.sum(F.when(act & one, F.col(name).cast("bigint"))), z)

    cur = F.struct(F.col(hash_col).alias("hash"), F.col(epoch).alias("epoch"))
    prev = F.struct(F.col("prev_hash").alias("hash"), F.col("prev_epoch").alias("epoch"))
    agg = rows.groupBy(*k, "cycle_no").agg(
        F.when(F.col("cycle_no") == 1, F.min_by(cur, "idx")).otherwise(F.min_by(prev, "idx")).alias("begin"),
        F.max_by(cur, "idx").alias("end"),
        F.max("closes").alias("closed"),
        F.count_if(one).alias("n_commits"),
        F.count_if(one & F.coalesce(F.col(c["related"]), F.lit(False)) & (F.col("idx") > 0))
         .alias(f"n_commits_{prefix}_related"),
        active_sum(c["ra"]).alias(f"n_{prefix}_rules_added"),
        active_sum(c["rr"]).alias(f"n_{prefix}_rules_removed"),
        active_sum(c["ma"]).alias(f"n_{prefix}_modules_added"),
        active_sum(c["mr"]).alias(f"n_{prefix}_modules_removed"),
        F.collect_set(F.when(act, F.col("__ext"))).alias("__exts"),
    )
    # A leftover (unclosed) cycle needs begin != end: a one-commit history has none.
    agg = agg.filter(F.col("closed") | (F.col("begin.hash") != F.col("end.hash")))
    span = F.col("end.epoch") - F.col("begin.epoch")
    return agg.select(
        *k, "cycle_no", "begin", "end",
        convert_seconds(span, "d").alias("diff_days"),
        convert_seconds(span, "m").alias("diff_mins"),
        convert_seconds(span, "h").alias("diff_hours"),
        "n_commits", f"n_commits_{prefix}_related",
        f"n_{prefix}_rules_added", f"n_{prefix}_rules_removed",
        f"n_{prefix}_modules_added", f"n_{prefix}_modules_removed",
        F.array_sort("__exts").alias("file_extensions"),
        F.col("closed").alias("is_closed"),
    )


def repo_workflow_summary(commits: DataFrame, key: Sequence[str] = KEY,
                          prefix: str = "snakemake", nest: bool = False, **kw) -> DataFrame:
    """A18 (related commits, first commit included) and A19 (cycle count) per repo.

    The flat ``evolution_cycles`` table is the primary output. ``nest=True`` also
    nests the cycles per repository, ordered by number, for the one-document-per-
    repository JSON sink; that list grows with a repository's history, so use it
    only for writing that format."""
    c = _cols(prefix)
    k = list(key)
    cycles = evolution_cycles(commits, k, prefix, **kw)
    aggs = [F.count(F.lit(1)).alias("n_evolution_cycles")]
    if nest:
        aggs.append(F.sort_array(F.collect_list(F.struct(*[x for x in cycles.columns if x not in k])))
                    .alias("evolution_cycles"))
    per_repo = cycles.groupBy(*k).agg(*aggs)
    related = commits.groupBy(*k).agg(
        F.count_if(F.coalesce(F.col(c["related"]), F.lit(False)))
         .alias(f"n_commits_{prefix}_related"))
    out = related.join(per_repo, k, "left")
    cols = [*k, f"n_commits_{prefix}_related",
            F.coalesce("n_evolution_cycles", F.lit(0).cast("bigint")).alias("n_evolution_cycles")]
    if nest:
        cols.append(F.coalesce("evolution_cycles",
                               F.array().cast(per_repo.schema["evolution_cycles"].dataType))
                    .alias("evolution_cycles"))
    return out.select(*cols)
