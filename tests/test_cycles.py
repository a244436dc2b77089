"""Evolution cycles against their definition by bursts, and literal histories."""

import random

import pytest
from pyspark.sql import functions as F

from repochron.operators import cycles as cyc

DAY = 86400.0


def by_bursts(rows):
    """The cycles of one repository from their definition: a burst (commits less than a day
    apart) with a net change of rules or modules after the very first commit closes a cycle at
    its last commit; what changed is summed from the first such commit to the burst's end."""
    rows = sorted(rows, key=lambda c: (c["epoch"], c["hash"]))
    starts = [0] + [i for i in range(1, len(rows)) if rows[i]["epoch"] - rows[i - 1]["epoch"] >= DAY]
    closing = {}                                   # last commit of a closing burst -> first net change
    for s, e in zip(starts, [*starts[1:], len(rows)]):
        net = [i for i in range(max(s, 1), e) if rows[i]["ra"] != rows[i]["rr"] or rows[i]["ma"] != rows[i]["mr"]]
        if net:
            closing[e - 1] = net[0]
    out, begin = [], 0
    for last in [*closing, len(rows) - 1]:
        open_ = last not in closing or (out and last == begin)
        members = range(0 if begin == 0 else begin + 1, last + 1)
        ends = [(rows[i]["hash"], rows[i]["epoch"]) for i in (begin, last)]
        if last == begin or ends[0] == ends[1]:
            continue
        changed = [] if open_ else range(closing[last], last + 1)
        out.append((*ends, len(members), sum(rows[i]["related"] for i in members if i),
                    tuple(sum(rows[i][k] for i in changed) for k in ("ra", "rr", "ma", "mr")),
                    tuple(sorted({x for i in changed for x in rows[i]["exts"]})), not open_))
        begin = last
    return out


def random_history(rnd, repo, n):
    gaps = [0.0, 60.0, 3600.0, DAY - 0.001, DAY, DAY + 0.5, 3 * DAY, 40000.0]
    t = 1_700_000_000.0 + rnd.randrange(0, 5) * DAY
    rows = []
    for i in range(n):
        if i:
            t += rnd.choice(gaps)
        kind = rnd.random()
        ra = 1 if kind < 0.15 else 0
        rr = 1 if 0.15 <= kind < 0.25 else 0
        ma = 1 if rnd.random() < 0.08 else 0
        if rnd.random() < 0.05:        # +1 / -1 on rules: no net change
            ra, rr = 1, 1
        rows.append(dict(repo=repo, hash=f"{repo}-{i:03d}-{rnd.randrange(1000):03d}", epoch=t,
                         ra=ra, rr=rr, ma=ma, mr=0, related=rnd.random() < 0.4,
                         exts=rnd.sample(["py", "smk", "md", "txt"], rnd.randrange(0, 3))))
    return rows


def to_df(spark, rows):
    data = [("o", r["repo"], r["hash"], r["epoch"], r["ra"], r["rr"], r["ma"], r["mr"], r["related"], r["exts"])
            for r in rows]
    return spark.createDataFrame(data, "owner string, repo string, hash string, committer_epoch double, "
                                 "snakemake_n_rules_added bigint, snakemake_n_rules_removed bigint, "
                                 "snakemake_n_modules_added bigint, snakemake_n_modules_removed bigint, "
                                 "snakemake_related boolean, file_extensions array<string>")


@pytest.mark.parametrize("seed,bucket", [(1, 7200), (2, 7200), (3, 86400), (4, 1)])
def test_cycles_match_their_definition(spark, seed, bucket):
    rnd = random.Random(seed)
    rows = []
    for r in range(12):
        rows += random_history(rnd, f"r{r}", rnd.choice([1, 2, 3, 8, 25, 60]))
    # Small buckets: most carries cross bucket boundaries.
    got = cyc.evolution_cycles(to_df(spark, rows), bucket_seconds=bucket).collect()
    have = {}
    for g in got:
        have.setdefault(g["repo"], []).append(g)
    for repo in {r["repo"] for r in rows}:
        want = by_bursts([r for r in rows if r["repo"] == repo])
        mine = sorted(have.get(repo, []), key=lambda g: g["cycle_no"])
        assert len(mine) == len(want), repo
        for g, w in zip(mine, want):
            assert (g["begin"]["hash"], g["begin"]["epoch"]) == w[0]
            assert (g["end"]["hash"], g["end"]["epoch"]) == w[1]
            assert g["n_commits"] == w[2]
            assert g["n_commits_snakemake_related"] == w[3]
            assert (g["n_snakemake_rules_added"], g["n_snakemake_rules_removed"],
                    g["n_snakemake_modules_added"], g["n_snakemake_modules_removed"]) == w[4]
            assert tuple(g["file_extensions"]) == w[5]
            assert g["is_closed"] == w[6]
            span = w[1][1] - w[0][1]
            assert g["diff_days"] == int(span // 86400) and g["diff_hours"] == int(span // 3600)


def test_exact_day_gap_splits_and_shorter_merges(spark):
    base = 1_700_000_000.0
    rows = [dict(repo="a", hash="h0", epoch=base, ra=0, rr=0, ma=0, mr=0, related=False, exts=[]),
            dict(repo="a", hash="h1", epoch=base + 10, ra=1, rr=0, ma=0, mr=0, related=True, exts=["smk"]),
            dict(repo="a", hash="h2", epoch=base + 10 + DAY - 0.001, ra=0, rr=0, ma=0, mr=0, related=False,
                 exts=["py"]),
            dict(repo="a", hash="h3", epoch=base + 10 + 2 * DAY - 0.001, ra=0, rr=0, ma=0, mr=0,
                 related=False, exts=["md"])]
    got = cyc.evolution_cycles(to_df(spark, rows)).orderBy("cycle_no").collect()
    # h1 triggers; h2 is < 24 h later (carried), h3 exactly 24 h after h2 -> close at h2.
    assert [(g["begin"]["hash"], g["end"]["hash"]) for g in got] == [("h0", "h2"), ("h2", "h3")]
    assert got[0]["n_commits"] == 3 and tuple(got[0]["file_extensions"]) == ("py", "smk")
    assert got[1]["n_snakemake_rules_added"] == 0 and not got[1]["is_closed"]


def test_single_commit_and_first_commit_trigger(spark):
    rows = [dict(repo="one", hash="x", epoch=5.0, ra=3, rr=0, ma=0, mr=0, related=True, exts=[]),
            dict(repo="two", hash="a", epoch=5.0, ra=3, rr=0, ma=0, mr=0, related=True, exts=[]),
            dict(repo="two", hash="b", epoch=5.0 + 3 * DAY, ra=0, rr=0, ma=0, mr=0, related=False, exts=[])]
    got = cyc.evolution_cycles(to_df(spark, rows)).collect()
    assert [g["repo"] for g in got] == ["two"]            # one commit: no cycle
    assert got[0]["n_snakemake_rules_added"] == 0          # first commit never fires
    assert got[0]["n_commits"] == 2 and not got[0]["is_closed"]


def test_bursts_and_order_against_plain_windows(spark):
    rnd = random.Random(7)
    rows = []
    for r in range(6):
        rows += random_history(rnd, f"r{r}", 40)
    df = to_df(spark, rows)
    b = cyc.commit_bursts(df, bucket_seconds=3600).select("repo", "hash", "idx", "burst_no", "prev_hash")
    got = {(x["repo"], x["hash"]): (x["idx"], x["burst_no"], x["prev_hash"]) for x in b.collect()}
    for repo in {r["repo"] for r in rows}:
        rs = sorted([r for r in rows if r["repo"] == repo], key=lambda c: (c["epoch"], c["hash"]))
        burst, prev = 0, None
        for i, r in enumerate(rs):
            if prev is None or r["epoch"] - prev["epoch"] >= DAY:
                burst += 1
            assert got[(repo, r["hash"])] == (i, burst, prev["hash"] if prev else None)
            prev = r


def test_repo_workflow_summary_counts_first_commit(spark):
    rows = [dict(repo="a", hash="h0", epoch=1.0, ra=0, rr=0, ma=0, mr=0, related=True, exts=[]),
            dict(repo="a", hash="h1", epoch=2.0 + DAY, ra=1, rr=0, ma=0, mr=0, related=True, exts=[])]
    s = cyc.repo_workflow_summary(to_df(spark, rows), nest=True).collect()[0]
    assert s["n_commits_snakemake_related"] == 2 and s["n_evolution_cycles"] == 1
    c = s["evolution_cycles"][0]
    assert c["n_commits_snakemake_related"] == 1 and c["n_commits"] == 2


def test_extensions_of_a_cycle_and_counts_once_per_commit(spark):
    rows = [("o", "r", f"h{i}", float(i * 1000), exts, 1 if i == 1 else 0, 0, 0, 0, True)
            for i, exts in enumerate((["py", "smk"], [], None, ["smk", "md", "py"], ["md"]))]
    c = ("owner string, repo string, hash string, committer_epoch double, file_extensions array<string>, snakemake_n_rules_added bigint, "
         "snakemake_n_rules_removed bigint, snakemake_n_modules_added bigint, snakemake_n_modules_removed bigint, snakemake_related boolean")
    r = cyc.evolution_cycles(spark.createDataFrame(rows, c)).collect()
    assert [(x["n_commits"], x["n_commits_snakemake_related"], x["n_snakemake_rules_added"], x["file_extensions"]) for x in r] == [
        (5, 4, 1, ["md", "py", "smk"])]
