"""Repository summary, list joins, upsert and the driver contract."""

from pyspark.sql import functions as F

from repochron.operators import incremental as inc
from repochron.operators import summary as sm


def test_general_summary_and_counts(spark):
    commits = spark.createDataFrame(
        [("o", "r", "h1", "A", "C1", 100.5, "d1"), ("o", "r", "h2", "A", "C2", 50.0, "d2"),
         ("o", "s", "h3", "B", "C1", 7.0, "d3")],
        "owner string, repo string, hash string, author string, committer string, "
        "committer_epoch double, committer_date string")
    s = {r["repo"]: r for r in sm.repo_general_summary(commits, as_of=60.0).collect()}
    assert s["r"]["n_authors"] == 1 and s["r"]["n_committers"] == 2
    assert s["r"]["first_commit_at_epoch"] == 50.0 and s["r"]["last_commit_at_epoch"] == 100.5
    assert s["r"]["first_commit_at"] == "1970-01-01T00:00:50 " and s["r"]["first_committer_date"] == "d2"
    repos = spark.createDataFrame([("o", "r"), ("o", "s"), ("o", "t")], "owner string, repo string")
    issues = spark.createDataFrame([("o", "r", 1), ("o", "r", 2)], "owner string, repo string, number int")
    got = {r["repo"]: r for r in sm.entity_counts(repos, {"commits": commits, "issues": issues}).collect()}
    assert (got["r"]["x_total_commits"], got["r"]["x_total_issues"]) == (2, 2)
    assert (got["t"]["x_total_commits"], got["t"]["x_total_issues"]) == (0, 0)


def test_lists(spark):
    repos = spark.createDataFrame([("a/b",), ("c/d",), ("e/f",)], "full_name string")
    black = spark.createDataFrame([("a/b",)], "full_name string")
    assert sm.merge_skiplists(None, None) is None
    merged = sm.merge_skiplists(black, None)
    assert sorted(r[0] for r in sm.skip_list(repos, merged).collect()) == ["c/d", "e/f"]
    assert sm.allow_list(repos, None).count() == 3
    assert [r[0] for r in sm.allow_list(repos, black).collect()] == ["a/b"]
    t = sm.stage_totals(repos, black, "clone").collect()[0]
    assert (t["n_done"], t["n_failed"]) == (3, 1)
    try:
        sm.analysis("nextflow")
        raise AssertionError("unknown analysis must raise")
    except ValueError:
        pass


def test_upsert_last_wins_and_key_by(spark):
    cols = "id bigint, name string, full_name string, html_url string, description string, " \
           "stargazers_count bigint, forks_count bigint, load_order bigint"
    old = spark.createDataFrame([(1, "x", "o/x", "u", None, 1, 1, 0)], cols)
    new = spark.createDataFrame([(1, "x2", "o/x", "u", "d", 5, 2, 1), (1, "x3", "o/x", "u", None, 6, 3, 2),
                                 (2, "y", "o/y", "u", None, 0, 0, 3)], cols)
    got = {r["id"]: r for r in inc.upsert(old, new).collect()}
    assert got[1]["name"] == "x3" and got[1]["description"] is None and got[2]["name"] == "y"
    allowed = spark.createDataFrame([("o/y",)], "full_name string")
    only = inc.upsert(old, new, allowed=allowed).collect()
    assert sorted((r["id"], r["name"]) for r in only) == [(1, "x"), (2, "y")]
    assert inc.key_by_last(new.filter(F.lit(False)), "id", ["load_order"]).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "codebase_size" in df.columns
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 40


def test_entity_filters_and_joins(spark):
    from repochron.operators import entities as ent
    issues = spark.createDataFrame(
        [("o", "r", 1, 2, {"url": "u"}), ("o", "r", 2, 0, None), ("o", "r", 3, None, None)],
        "owner string, repo string, number bigint, comments bigint, pull_request map<string,string>")
    assert [r["number"] for r in ent.issues_that_are_prs(issues).collect()] == [1]
    assert [r["number"] for r in ent.issues_with_comments(issues).collect()] == [1]
    prs = spark.createDataFrame([("o", "r", 1, "sha")], "owner string, repo string, number bigint, merge_commit_sha string")
    assert ent.issue_pull_requests(issues, prs).collect()[0]["merge_commit_sha"] == "sha"
    com = spark.createDataFrame([("o", "r", "https://x/issues/1"), ("o", "r", "https://x/issues/2")],
                                "owner string, repo string, issue_url string")
    assert ent.issue_comment_rows(issues, com).count() == 1
    info = spark.createDataFrame([("a", True), ("b", None)], "repo string, has_pages boolean")
    assert [r[0] for r in ent.feature_gate(info, "has_pages").collect()] == ["a"]
    c = spark.createDataFrame([("h", True), ("g", None)], "hash string, snakemake_related boolean")
    assert [r[0] for r in ent.related_commits(c).collect()] == ["h"]
    assert ent.concat_lists(info, info.select("repo")).count() == 4


def test_name_checks_and_url_columns(spark):
    from repochron.operators import validate as val
    df = spark.createDataFrame([("a/b",), ("/b",), ("a",), ("a/b/c",), ("",), (None,)], "full_name string")
    got = df.select("full_name", val.is_full_name("full_name").alias("p04")).collect()
    assert [r["p04"] for r in got] == [True, False, False, True, False, False]
    s = val.split_full_name(df).collect()
    assert [(r["owner"], r["repo"], r["valid"]) for r in s] == [
        ("a", "b", True), ("", "b", True), (None, None, False), (None, None, False),
        (None, None, False), (None, None, False)]
    h = spark.createDataFrame([("a" * 40,), ("a" * 39,), (None,)], "h string")
    assert [r[0] for r in h.select(val.is_commit_hash("h")).collect()] == [True, False, False]
    info = spark.createDataFrame([(1, "u", "v", ("acme", "w"))],
                                 "id int, html_url string, url string, owner struct<login:string,html_url:string>")
    out = val.drop_suffix_columns(info)
    assert out.columns == ["id", "url", "owner"] and out.collect()[0]["owner"]["html_url"] == "w"
    rej = val.rejects_of(spark.createDataFrame([("x",)], "full_name string").withColumn("ok", F.lit(False)),
                         F.col("ok"), "list", "bad", "full_name").collect()
    assert [(r["stage"], r["full_name"], r["reason"]) for r in rej] == [("list", "x", "bad")]


def test_partition_overwrite_and_non_empty(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="repochron-k10-") + "/out"
    a = spark.createDataFrame([("x", 1), ("y", 2)], "repo string, n int")
    inc.overwrite_partitions(a, path, ["repo"])
    inc.overwrite_partitions(spark.createDataFrame([("x", 9)], "repo string, n int"), path, ["repo"])
    got = sorted((r["repo"], r["n"]) for r in spark.read.parquet(path).collect())
    assert got == [("x", 9), ("y", 2)]             # only partition x replaced
    assert sm.assert_non_empty(a).count() == 2
    try:
        sm.assert_non_empty(a.filter("n > 5"), "clones")
        raise AssertionError("empty input must raise")
    except RuntimeError:
        pass


def test_approx_distinct_option(spark):
    commits = spark.createDataFrame([("o", "r", f"h{i}", f"a{i % 7}", "c", float(i), "d") for i in range(200)],
                                    "owner string, repo string, hash string, author string, committer string, "
                                    "committer_epoch double, committer_date string")
    r = sm.repo_general_summary(commits, as_of=1e9, approx_distinct=True).collect()[0]
    assert r["n_authors"] == 7 and r["n_committers"] == 1 and abs(r["n_commits_distinct"] - 200) <= 10
