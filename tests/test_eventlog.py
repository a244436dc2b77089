"""Event logs: boundaries in both cycles, null dates / actors, PR commit ranges."""

from pyspark.sql import functions as F

from repochron.operators import eventlog as el


def cycles(spark):
    data = [("o", "r", 1, ("h0", 100.0), ("h2", 300.5), 1, 0),
            ("o", "r", 2, ("h2", 300.5), ("h4", 500.0), 0, 0)]
    return spark.createDataFrame(data, "owner string, repo string, cycle_no bigint, "
                                 "begin struct<hash:string,epoch:double>, end struct<hash:string,epoch:double>, "
                                 "n_snakemake_rules_added bigint, n_snakemake_modules_added bigint")


def test_boundaries_and_null_dates(spark):
    from repochron.functions.scalars import GITHUB_TS_FORMAT  # noqa: F401
    iss = spark.createDataFrame(
        [("o", "r", 1, "1970-01-01T00:05:00Z", None, ("ann",)),       # t = 300 -> cycle 1 only
         ("o", "r", 2, "1970-01-01T00:08:20Z", "1970-01-01T00:01:40Z", ("bob",)),  # 500 / 100
         ("o", "r", 3, None, None, ("cid",))],
        "owner string, repo string, number bigint, created_at string, closed_at string, user struct<login:string>")
    log = el.attach_cycles(el.issue_activities(iss), cycles(spark)).collect()
    got = sorted((r["cycle_no"], r["case_id"], r["activity"], r["user"]) for r in log)
    assert got == [(1, "Issue-1", "Issue Created", "ann"), (1, "Issue-2", "Issue Closed", "bob"),
                   (2, "Issue-2", "Issue Created", "bob")]


def test_commits_e05_e06_and_actor_null(spark):
    commits = spark.createDataFrame(
        [("o", "r", "h2" + "x" * 38, 300.9, "c:x"), ("o", "r", "h4" + "y" * 38, 500.0, "c:y")],
        "owner string, repo string, hash string, committer_epoch double, committer string")
    log = el.attach_cycles(el.commit_activities(commits), cycles(spark)).collect()
    got = sorted((r["cycle_no"], r["case_id"], r["activity"], r["timestamp"]) for r in log)
    # int(300.9) = 300 < 300.5: the boundary commit with a fraction misses cycle 2's begin.
    assert got == [(1, "Commit-h2xxxxx", "Committed-Snakemake", "1970-01-01T00:05:00 "),
                   (2, "Commit-h4yyyyy", "Committed", "1970-01-01T00:08:20 ")]
    ev = spark.createDataFrame([("o", "r", 9, "closed", "1970-01-01T00:06:40Z", None, (7,))],
                               "owner string, repo string, id bigint, event string, created_at string, "
                               "actor struct<login:string>, issue struct<number:bigint>")
    e = el.attach_cycles(el.issue_event_activities(ev), cycles(spark)).collect()[0]
    assert (e["case_id"], e["activity"], e["user"], e["cycle_no"]) == ("Issue-7", "closed", None, 2)


def test_pr_commit_ranges(spark):
    hashes = [f"c{i}" for i in range(6)]
    order = spark.createDataFrame([("o", "r", h, i, f"d{i}", float(i)) for i, h in enumerate(hashes)],
                                  "owner string, repo string, hash string, idx bigint, "
                                  "committer_date string, committer_epoch double")
    commits = spark.createDataFrame(
        [("o", "r", "m1", ["c1"]), ("o", "r", "m2", ["c1", "c4"]), ("o", "r", "m3", ["c4", "c1"]),
         ("o", "r", "m4", ["c1", "c2", "c3"]), ("o", "r", "m5", [])],
        "owner string, repo string, hash string, parents array<string>")
    prs = spark.createDataFrame(
        [("o", "r", n, "1970-01-01T00:00:00Z", sha, ("u",)) for n, sha in
         ((1, "m1"), (2, "m2"), (3, "m3"), (4, "m4"), (5, "m5"), (6, None), (7, "zz"))],
        "owner string, repo string, number bigint, created_at string, merge_commit_sha string, "
        "user struct<login:string>")
    got = sorted((r["case_id"], r["commit_hash"], r["timestamp"])
                 for r in el.pr_commit_activities(prs, commits, order).collect())
    assert got == [("Issue-1", "c1", "d1"), ("Issue-2", "c1", "d1"), ("Issue-2", "c2", "d2"),
                   ("Issue-2", "c3", "d3")]


def test_repeats_under_pull_requests_and_sort(spark):
    order = spark.createDataFrame([("o", "r", f"c{i}", i, f"d{i}", float(i)) for i in range(4)],
                                  "owner string, repo string, hash string, idx bigint, "
                                  "committer_date string, committer_epoch double")
    commits = spark.createDataFrame([("o", "r", "m", ["c0", "c3"])],
                                    "owner string, repo string, hash string, parents array<string>")
    prs = spark.createDataFrame([("o", "r", 1, "2024-01-01T00:00:00Z", "m", ("u",)), ("o", "r", 1, "2024-01-01T00:00:00Z", "m", ("u",))],
                                "owner string, repo string, number bigint, created_at string, "
                                "merge_commit_sha string, user struct<login:string>")
    raw = el.pr_commit_activities(prs, commits, order)
    assert raw.count() == 6                      # the PR listed twice: every range commit twice
    assert el.pr_commit_activities(prs, commits, order).count() >= 3
    log = raw.select("owner", "repo", F.lit(1).cast("bigint").alias("cycle_no"), "case_id",
                     "activity", "t", "timestamp", "user")
    ts = [r["t"] for r in el.sort_event_log(log).collect()]
    assert ts == sorted(ts)


def test_event_log_of_a_small_history(spark):
    """Two cycles, worked by hand: times are seconds, cycle 1 is [100, 300.5], cycle 2 [300.5, 500]."""
    def gh(t):
        return f"1970-01-01T00:{t // 60:02d}:{t % 60:02d}Z"

    key = "owner string, repo string, "
    issues = spark.createDataFrame([("o", "r", 1, gh(150), gh(400), ("ann",)), ("o", "r", 2, gh(99), None, ("bob",))],
                                   key + "number bigint, created_at string, closed_at string, user struct<login:string>")
    comments = spark.createDataFrame([("o", "r", 1, "https://x/issues/1", gh(301), ("cid",)), ("o", "s", 2, "x/9", gh(301), ("d",))],
                                     key + "id bigint, issue_url string, created_at string, user struct<login:string>")
    events = spark.createDataFrame([("o", "r", 5, "labeled", gh(500), None, (2,)), ("o", "r", 6, "late", gh(501), None, (2,))],
                                   key + "id bigint, event string, created_at string, actor struct<login:string>, "
                                         "issue struct<number:bigint>")
    commits = spark.createDataFrame(
        [("o", "r", "a" * 40, 100.0, "A", "eve", []), ("o", "r", "b" * 40, 300.5, "B", "eve", ["a" * 40]),
         ("o", "r", "c" * 40, 450.0, "C", "fay", ["a" * 40, "b" * 40]), ("o", "r", "d" * 40, 500.0, "D", "fay", ["c" * 40])],
        key + "hash string, committer_epoch double, committer_date string, committer string, parents array<string>")
    order = commits.withColumn("idx", F.expr("ascii(hash) - 97").cast("bigint"))
    prs = spark.createDataFrame([("o", "r", 7, gh(200), "c" * 40, ("gus",)), ("o", "r", 8, gh(480), "d" * 40, ("gus",)),
                                 ("o", "r", 9, None, "d" * 40, ("hal",)), ("o", "r", 10, "2024-13-01", "d" * 40, ("hal",))],
                                key + "number bigint, created_at string, merge_commit_sha string, user struct<login:string>")
    log = el.event_log(cycles(spark), issues, comments, events, prs, commits, order).collect()
    got = sorted(((r["cycle_no"] or 0, r["case_id"], r["activity"], r["user"]) for r in log), key=str)
    assert got == sorted([
        (1, "Issue-1", "Issue Created", "ann"), (2, "Issue-1", "Issue Closed", "ann"), (2, "Issue-1", "Issue Commented", "cid"),
        (2, "Issue-2", "labeled", None), (1, "Commit-aaaaaaa", "Committed-Snakemake", "eve"),
        (1, "Commit-bbbbbbb", "Committed-Snakemake", "eve"),           # 300 < 300.5: not in cycle 2
        (2, "Commit-ccccccc", "Committed", "fay"), (2, "Commit-ddddddd", "Committed", "fay"),
        (1, "Issue-7", "Pull Request Opened", "gus"), (2, "Issue-8", "Pull Request Opened", "gus"),
        (0, "Issue-7", "Committed", "gus"),                             # commit a: positions [0, 1)
        (0, "Issue-8", "Committed", "gus"),                             # commit c, the parent; 9 and 10 have no date
    ], key=str)


def test_rejects_name_every_skipped_row(spark):
    key = "owner string, repo string, "
    issues = spark.createDataFrame([("o", "r", 1, "2024-13-01T00:00:00Z", None), ("o", "r", 2, None, None),
                                    ("o", "r", 3, "2024-01-01T00:00:00Z", "junk"), ("o", "r", 4, "2024-01-01T00:00:00Z", None)],
                                   key + "number bigint, created_at string, closed_at string")
    dated = key + "id bigint, created_at string"
    comments = spark.createDataFrame([("o", "r", 11, "x")], dated)
    events = spark.createDataFrame([("o", "r", 12, "2024-01-01T00:00:00Z")], dated)
    prs = spark.createDataFrame([("o", "r", 7, "2024-01-01T00:00:00Z", "zz"), ("o", "r", 8, "2024-01-01T00:00:00Z", "m"),
                                 ("o", "r", 9, "", None)], key + "number bigint, created_at string, merge_commit_sha string")
    commits = spark.createDataFrame([("o", "r", "m", ["gone", "a"]), ("o", "r", "a", [])], key + "hash string, parents array<string>")
    got = sorted(tuple(r) for r in el.event_rejects(issues, comments, events, prs, commits).collect())
    assert got == sorted([
        ("event_log", "o", "r", "issue", "1", "malformed created_at"), ("event_log", "o", "r", "issue", "2", "no created_at"),
        ("event_log", "o", "r", "issue", "3", "malformed closed_at"), ("event_log", "o", "r", "comment", "11", "malformed created_at"),
        ("event_log", "o", "r", "pull_request", "7", "merge commit not found"),
        ("event_log", "o", "r", "pull_request", "8", "parent commit not found"),
        ("event_log", "o", "r", "pull_request", "9", "no created_at")])


def test_activities_meet_every_cycle_that_holds_them(spark):
    """J13 against every pair: long and empty cycles, instants on boundaries, activities outside."""
    import random
    rnd = random.Random(3)
    rows, acts = [], []
    for repo in range(8):
        at = rnd.randrange(100) * 1000.0
        for no in range(1, rnd.randrange(2, 9)):
            end = at + (0.0 if no == 1 and repo % 2 else rnd.choice((3600.0, 86400.0, 12.5, 3650 * 86400.0)))
            rows.append(("o", f"r{repo}", no, ("b", at), ("e", end), repo % 3 == 0 and 1 or 0, 0))
            acts += [("o", f"r{repo}", f"Commit-{no}{k}", "Committed", int(t), "x", "u")
                     for k, t in enumerate((at, end, at - 1, end + 1, (at + end) / 2, rnd.uniform(at, end)))]
            at = end
    cyc = spark.createDataFrame(rows, "owner string, repo string, cycle_no bigint, begin struct<hash:string,epoch:double>, "
                                "end struct<hash:string,epoch:double>, n_snakemake_rules_added bigint, n_snakemake_modules_added bigint")
    act = spark.createDataFrame(acts, "owner string, repo string, case_id string, activity string, t bigint, timestamp string, user string")
    got = el.attach_cycles(act, cyc)
    found = sorted((r["repo"], r["cycle_no"], r["case_id"], r["t"], r["activity"]) for r in got.collect())
    wanted = sorted((a[1], c[2], a[2], a[4], "Committed-Snakemake" if c[5] else "Committed")
                    for a in acts for c in rows if a[1] == c[1] and c[3][1] <= a[4] <= c[4][1])
    assert found == wanted and len(wanted) > 150
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan        # no cycle is expanded into days


def test_commits_under_a_pull_request_are_listed_once(spark):
    order = spark.createDataFrame([("o", "r", h, i, f"d{i}", 100.0 + i, "c") for i, h in enumerate(("a", "b", "m"))],
                                  "owner string, repo string, hash string, idx bigint, committer_date string, committer_epoch double, committer string")
    commits = spark.createDataFrame([("o", "r", "a", [], 100.0, "c"), ("o", "r", "b", ["a"], 101.0, "c"), ("o", "r", "m", ["a", "b"], 102.0, "c")],
                                    "owner string, repo string, hash string, parents array<string>, committer_epoch double, committer string")
    prs = spark.createDataFrame([("o", "r", 1, "1970-01-01T00:01:41Z", "m", ("u",))], "owner string, repo string, number bigint, "
                                "created_at string, merge_commit_sha string, user struct<login:string>")
    who = "user struct<login:string>"
    none = [spark.createDataFrame([], f"owner string, repo string, {x}") for x in (
        f"number bigint, created_at string, closed_at string, {who}", f"id bigint, issue_url string, created_at string, {who}",
        "id bigint, event string, created_at string, actor struct<login:string>, issue struct<number:bigint>")]
    cyc = cycles(spark)
    log = {d: sorted((r["case_id"], r["activity"]) for r in el.event_log(cyc, *none, prs, commits, order, dedupe=d).collect()) for d in (False, True)}
    under, opened = ("Issue-1", "Committed"), ("Issue-1", "Pull Request Opened")
    own = [(f"Commit-{h}", "Committed-Snakemake") for h in "abm"]
    assert log[False] == sorted([*own, under, opened]) and log[True] == sorted([*own[1:], under, opened])


def test_ranges_as_blocks(spark):
    """Every position of a range is in exactly one of its blocks, and wide ranges have few."""
    import random
    rnd = random.Random(4)
    ranges = [(b, b + w) for b in (0, 1, 31, 32, 33, 1000, 32767) for w in (1, 2, 31, 32, 33, 64, 1023, 1025, 5000)]
    ranges += [(b := rnd.randrange(10**6), b + rnd.randrange(1, 40_000)) for _ in range(40)] + [(5, 3_000_000_005)]
    df = spark.createDataFrame(ranges, "b bigint, e bigint")
    for r in df.select("b", "e", el.range_blocks(F.col("b"), F.col("e")).alias("x")).collect():
        spans = sorted((x["no"] << x["level"], (x["no"] + 1) << x["level"]) for x in r["x"])
        assert spans[0][0] == r["b"] and spans[-1][1] == r["e"] and len(spans) <= 62 * 7
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_commits_of_overlapping_ranges(spark):
    n = 3000
    order = spark.createDataFrame([("o", r, f"c{i}", i) for r in "pq" for i in range(n)], "owner string, repo string, hash string, idx bigint")
    ranges = [("o", "p", k, b, e) for k, (b, e) in enumerate(((0, n), (5, 6), (100, 1500), (90, 2048), (7, 7), (9, 2)))] + [("o", "q", 9, 1, n - 1)]
    df = spark.createDataFrame(ranges, "owner string, repo string, k int, __b bigint, __e bigint")
    got = el.commits_in_ranges(df, order)
    found = {(r["repo"], r["k"]): (r["n"], r["lo"], r["hi"], r["d"]) for r in got.groupBy("repo", "k").agg(
        F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count_distinct("hash").alias("d")).collect()}
    assert found == {(r, k): (e - b, b, e - 1, e - b) for _, r, k, b, e in ranges if b < e}
    assert el.commits_in_ranges(df.limit(0), order).count() == 0


def test_commits_of_the_log_are_computed_once(spark):
    """Pull requests and the commits' own activities read one written table, not the commits' plan twice."""
    def gh(t):
        return f"1970-01-01T00:0{t // 60}:{t % 60:02d}Z"

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "owner string, repo string, hash string, parents array<string>, committer_epoch double, committer string, committer_date string"
    commits = spark.createDataFrame(
        [("o", "r", f"h{i}", [f"h{i - 1}"] if i else [], 100.0 * (i + 1), "c:x", f"d{i}") for i in range(5)], schema)
    order = commits.selectExpr("owner", "repo", "hash", "cast(substr(hash, 2) as bigint) as idx", "committer_date", "committer_epoch")
    item = "owner string, repo string, number bigint, created_at string, closed_at string, user struct<login:string>"
    com = "owner string, repo string, id bigint, issue_url string, created_at string, user struct<login:string>"
    ev = "owner string, repo string, id bigint, event string, created_at string, actor struct<login:string>, issue struct<number:bigint>"
    pr = "owner string, repo string, number bigint, created_at string, merge_commit_sha string, user struct<login:string>"
    prs = spark.createDataFrame([("o", "r", 7, gh(200), "h2", ("ann",))], pr)
    log = el.event_log(cycles(spark), spark.createDataFrame([], item), spark.createDataFrame([], com), spark.createDataFrame([], ev),
                       prs, commits.mapInArrow(counted, schema), order, dedupe=True)
    got = sorted((r["case_id"], r["activity"]) for r in log.collect())
    assert ("Issue-7", "Committed") in got and ("Commit-h1", "Committed-Snakemake") not in got
    assert seen.value == 5
