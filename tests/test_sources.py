"""Landing-file scans on small fixture files (S01-S21, S31) and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from repochron.sources import landing as ld
from repochron.sources import sinks


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def make_root():
    root = tempfile.mkdtemp(prefix="repochron-land-")
    h1, h2 = "1" * 40, "2" * 40
    commits = {h1: {"msg": "a", "author": "A:a@x", "committer": "C:c@x", "committer_epoch": 10.5,
                    "parents": [], "files": [{"filename": "Snakefile", "new_path": "Snakefile",
                                              "n_added_lines": 3, "n_deleted_lines": 0}]},
               h2: {"msg": "b", "author": "A:a@x", "committer": "D:d@x", "committer_epoch": 99.0,
                    "parents": [h1], "files": []}}
    write(f"{root}/acme/tool.commits.json", json.dumps(commits))
    write(f"{root}/acme/tool.repo_info.json", json.dumps(
        {"id": 7, "name": "tool", "full_name": "acme/tool", "has_issues": True, "html_url": "u",
         "owner": {"login": "acme", "html_url": "v"}, "topics": ["x"]}))
    write(f"{root}/acme/tool.issues.json", json.dumps(
        [{"number": 1, "created_at": "2024-01-01T00:00:00Z", "user": {"login": "ann"}, "comments": 2},
         {"number": 2, "created_at": "2024-01-02T00:00:00Z", "user": {"login": "bob"},
          "pull_request": {"url": "x"}}]))
    write(f"{root}/acme/tool.pullrequests.json", json.dumps(
        [[{"number": 2, "created_at": "2024-01-02T00:00:00Z", "merge_commit_sha": h2, "user": {"login": "bob"}}],
         [{"number": 5, "created_at": "2024-01-03T00:00:00Z", "merge_commit_sha": None, "user": {"login": "cy"}}]]))
    write(f"{root}/acme/tool.cicd_workflows.json", json.dumps({"total_count": 2, "workflows": [{"id": 1}, {"id": 2}]}))
    write(f"{root}/other/lib.cicd_workflows.json", json.dumps([{"id": 3}]))
    write(f"{root}/other/lib.releases.json", json.dumps({"id": 9}))
    write(f"{root}/other/lib.pullrequests.json", "[]")
    return root, h1, h2


def test_commit_map_and_files(spark):
    root, h1, h2 = make_root()
    c = ld.read_commits(spark, root)
    got = {r["hash"]: r for r in c.collect()}
    assert set(got) == {h1, h2} and got[h1]["owner"] == "acme" and got[h1]["repo"] == "tool"
    assert got[h2]["parents"] == [h1] and got[h1]["committer_epoch"] == 10.5
    f = ld.commit_files_of(c).collect()
    assert [(r["hash"], r["filename"]) for r in f] == [(h1, "Snakefile")]


def test_entities_envelopes_and_nested_prs(spark):
    root, _, h2 = make_root()
    wf = ld.read_entity(spark, root, "cicd_workflows")
    assert sorted((r["owner"], r["id"]) for r in wf.collect()) == [("acme", 1), ("acme", 2), ("other", 3)]
    rel = ld.read_entity(spark, root, "releases").collect()
    assert [(r["repo"], r["id"]) for r in rel] == [("lib", 9)]        # lone object = one row
    prs = ld.read_entity(spark, root, "pull_requests").collect()
    assert sorted((r["number"], r["merge_commit_sha"]) for r in prs) == [(2, h2), (5, None)]
    iss = ld.read_entity(spark, root, "issues")
    assert iss.filter(F.col("pull_request").isNotNull()).count() == 1         # P07
    assert iss.filter(F.coalesce("comments", F.lit(0)) != 0).count() == 1     # P08
    assert ld.read_entity(spark, root, "pages").count() == 0                   # missing = empty


def test_repo_info_tail_and_lists(spark):
    root, _, _ = make_root()
    info = ld.read_repo_info(spark, root).collect()[0]
    assert info["full_name"] == "acme/tool" and info["has_issues"] is True
    tail = ld.read_repo_info(spark, root).select(F.variant_get(F.col("tail")["topics"], "$[0]", "string")).collect()[0][0]
    assert tail == "x"
    write(f"{root}/lists/a.txt", "acme/tool\n\n/bad\nx/y/z\n  other/lib  \n")
    ok, bad = ld.repo_list_from_files(spark, f"{root}/lists/a.txt")
    assert sorted(r["full_name"] for r in ok.collect()) == ["acme/tool", "other/lib"]
    assert bad.count() == 3
    write(f"{root}/lists/skip.json", json.dumps([{"full_name": "acme/tool"}]))
    assert [r[0] for r in ld.read_skiplist(spark, f"{root}/lists/skip.json").collect()] == ["acme/tool"]
    write(f"{root}/search/p1.json", json.dumps({"total_count": 3, "items": [
        {"id": 1, "full_name": "a/b"}, {"id": 2, "full_name": "c/d"}]}))
    write(f"{root}/search/p2.json", json.dumps({"total_count": 3, "items": [{"id": 3, "full_name": "e/f"}]}))
    items, check = ld.search_results(spark, f"{root}/search/*.json")
    assert sorted(r["full_name"] for r in items.collect()) == ["a/b", "c/d", "e/f"]
    assert check.collect() == []


def test_sinks_round_trip(spark):
    out = tempfile.mkdtemp(prefix="repochron-sink-")
    df = spark.createDataFrame([("o", "a", 1), ("o", "b", 2)], "owner string, repo string, n int")
    sinks.write_dataset(df, f"{out}/ds", partition_by=["owner", "repo"])
    back = spark.read.json(f"{out}/ds")
    assert sorted((r["repo"], r["n"]) for r in back.collect()) == [("a", 1), ("b", 2)]
    sinks.mark_done(df, f"{out}/manifest", "extract")
    sinks.mark_done(df.limit(1), f"{out}/manifest", "extract")
    assert sinks.done_keys(spark, f"{out}/manifest", "extract").count() == 2
    assert sinks.done_keys(spark, f"{out}/manifest", "other") is None
    sinks.write_lines(df.select(F.concat_ws("/", "owner", "repo").alias("full_name")), f"{out}/lines")
    assert sorted(r[0] for r in spark.read.text(f"{out}/lines").collect()) == ["o/a", "o/b"]


def test_extend_repositories_info_stage(spark):
    from repochron.plans.stages import extend_repositories_info
    root, h1, h2 = make_root()
    # a repository with commits but no repo info is rejected
    write(f"{root}/other/lib.commits.json", json.dumps({"3" * 40: {"committer_epoch": 5.0, "author": "x"}}))
    ext, rej = extend_repositories_info(spark, root, kind="snakemake", as_of=1e10)
    rows = {(r["owner"], r["repo"]): r for r in ext.collect()}
    assert list(rows) == [("acme", "tool")]
    r = rows[("acme", "tool")]
    assert (r["x_total_commits"], r["x_total_issues"], r["x_total_pull_requests"],
            r["x_total_cicd_workflows"], r["x_total_pages"]) == (2, 2, 2, 2, 0)
    assert r["n_committers"] == 2 and r["first_commit_at_epoch"] == 10.5
    assert "html_url" not in ext.columns and r["n_evolution_cycles"] == 1
    assert [(x["repo"], x["reason"]) for x in rej.collect()] == [("lib", "no repository info")]
    done = spark.createDataFrame([("acme", "tool")], "owner string, repo string")
    again, _ = extend_repositories_info(spark, root, done=done)
    assert again.count() == 0
    forced, _ = extend_repositories_info(spark, root, done=done, force=True)
    assert forced.count() == 1


def test_event_log_and_growth_stages(spark):
    import datetime as dt
    from repochron.plans.stages import codebase_growth_of, event_logs
    root, h1, h2 = make_root()
    log = event_logs(spark, root).collect()
    kinds = sorted({(r["case_id"], r["activity"]) for r in log})
    # one leftover cycle (10.5 .. 99): h1 at whole second 10 < 10.5 falls outside, as in the
    # reference; the PR merge commit h2 has parent h1 (E08, no time filter)
    assert ("Commit-2222222", "Committed") in kinds and ("Issue-2", "Committed") in kinds
    assert ("Commit-1111111", "Committed") not in kinds
    out = tempfile.mkdtemp(prefix="repochron-patch-") + "/p"
    spark.createDataFrame([("r", "a", None, "x.py", "+1\n+2"), ("r", "a", None, "y.md", "+z"),
                           ("r", "b", "a", "x.py", "-1")],
                          "repo string, hash string, parent string, a_path string, patch string") \
        .write.parquet(out)
    commits = spark.createDataFrame([("r", "a", dt.datetime(2024, 1, 1), " first\n"),
                                     ("r", "b", dt.datetime(2024, 1, 2), "second"),
                                     ("r", "c", dt.datetime(2024, 1, 3), "third")],
                                    "repo string, hash string, committed_at timestamp, message string")
    rows = [(r["commit_id"], r["commit_size"], r["codebase_size"], r["commit_message"], r["datetime"])
            for r in codebase_growth_of(spark, out, commits).orderBy("datetime").collect()]
    assert rows == [("a", 5, 5, "first", "2024-01-01T00:00:00+00:00"),
                    ("b", 2, 7, "second", "2024-01-02T00:00:00+00:00"),
                    ("c", 0, 7, "third", "2024-01-03T00:00:00+00:00")]


def test_commit_facts_stage(spark):
    from repochron.plans.stages import commit_facts_of
    root, h1, h2 = make_root()
    write(f"{root}/x/y.commits.json", json.dumps({"4" * 40: {
        "committer_epoch": 1.0, "files": [
            {"filename": "Snakefile", "new_path": "Snakefile", "change_type": "MODIFY",
             "source_code": "rule a:\nrule b:\ninclude: 'r.smk'", "source_code_before": "rule a:"},
            {"filename": "run.py", "new_path": "workflow/scripts/run.py", "change_type": "ADD"}]}}))
    facts = {r["hash"]: r for r in commit_facts_of(ld.read_commits(spark, root)).collect()}
    f = facts["4" * 40]
    assert f["snakemake_related"] and f["snakemake_n_rules_added"] == 1
    assert f["snakemake_included_rules"] == ["r.smk"] and f["file_extensions"] == ["py"]
    assert f["snakemake_included_scripts"] == ["workflow/scripts/run.py"]
    assert facts[h2]["snakemake_related"] is False and facts[h2]["change_types"] == []


def test_text_and_lists(spark):
    root = tempfile.mkdtemp(prefix="repochron-misc-")
    write(f"{root}/repos/alpha/log.txt", "l1\nl2\n")
    write(f"{root}/repos/beta/log.txt", "m1\n")
    got = sorted((r["repo"], r["value"]) for r in ld.read_repo_text(spark, f"{root}/repos", ".txt").collect())
    assert got == [("alpha", "l1"), ("alpha", "l2"), ("beta", "m1")]
    write(f"{root}/black.txt", "a/b\nc/d\n")
    assert sorted(r[0] for r in ld.read_blacklist(spark, f"{root}/black.txt").collect()) == ["a/b", "c/d"]
    whole = ld.read_whole_text(spark, f"{root}/black.txt").collect()
    assert len(whole) == 1 and whole[0]["value"] == "a/b\nc/d\n"
    assert [r["full_name"] for r in ld.repo_list_inline(spark, ["x/y", "bad"]).collect()] == ["x/y"]


def test_unreadable_files_are_rejected_not_counted(spark, tmp_path):
    import json

    from repochron.plans import stages
    for repo in ("good", "bad", "bare"):
        (tmp_path / "o").mkdir(exist_ok=True)
        if repo != "bare":
            (tmp_path / "o" / f"{repo}.repo_info.json").write_text(json.dumps(
                {"id": 1, "full_name": f"o/{repo}", "name": repo, "html_url": "h", "clone_url": "c", "topics": ["x"]}))
        (tmp_path / "o" / f"{repo}.commits.json").write_text(json.dumps(
            {"a" * 40: {"author": "a", "committer": "c", "committer_date": "d", "committer_epoch": 5.0, "parents": []}}))
    (tmp_path / "o" / "good.issues.json").write_text('[{"number": 1}, {"number": 2}]')
    (tmp_path / "o" / "bad.issues.json").write_text('[{"number": 1}')
    (tmp_path / "o" / "bad.pullrequests.json").write_text('[[{"number"')
    root = str(tmp_path)
    landed = stages.land(spark, root)
    wanted = spark.createDataFrame([("o", r) for r in ("good", "bad", "bare", "none")], "owner string, repo string")
    extended, rejects = stages.extend_repositories_info(spark, root, repos=wanted, landed=landed, as_of=1e9)
    rows = {r["repo"]: r for r in extended.collect()}
    assert {k: (r["x_total_issues"], r["x_total_pull_requests"]) for k, r in rows.items()} == {"good": (2, 0), "bad": (0, 0)}
    assert not [c for c in extended.columns if c.endswith("_url")]
    assert not [k for k in rows["good"]["tail"] if k.endswith("_url")] and "topics" in rows["good"]["tail"]
    assert sorted((r["repo"], r["reason"]) for r in rejects.collect()) == [
        ("bad", "unreadable issues file: the document does not end"),
        ("bad", "unreadable pull_requests file: the document does not end"), ("bare", "no repository info"),
        ("none", "no extracted commits")]
    plan = extended._jdf.queryExecution().executedPlan().toString()
    assert "FileScan json" not in plan and "FileScan text" not in plan


def test_commit_table_of_landed_text(spark, tmp_path):
    from repochron.plans import stages
    h, p = "a" * 40, "b" * 40
    for repo, added in (("one", 3), ("two", 5)):
        d = tmp_path / "x" / repo
        d.mkdir(parents=True)
        (d / "commits.log").write_text(f"{h}|A|C|d|one | two|{p} {'c' * 40}\n{p}|A|C|d|root|\nnoise\n")
        (d / "numstat.txt").write_text(f"{h}\t{added}\t1\tf.py\n{h}\t-\t-\tb.png\n")
        (d / "tags.txt").write_text(f"{h}\tv1\n")
    (tmp_path / "x" / "one" / "branches.txt").write_text(f"{p}\tmain~1\n{h}\tmain\n")
    rows, rejects = stages.commit_log_of(spark, str(tmp_path / "x"))
    got = {(r["repo_name"], r["commit_hash"][0]): r for r in rows.collect()}
    assert len(got) == 4 and got["one", "a"]["lines_added"] == 3 and got["two", "a"]["lines_added"] == 5
    assert got["one", "a"]["message"] == "one | two" and got["one", "a"]["changed_files"] == ["b.png", "f.py"]
    assert got["one", "a"]["merged_branch"] == "main~1" and got["two", "a"]["merged_branch"] == ""
    assert got["one", "b"]["changed_files"] == ["unknown"] and got["one", "a"]["tags"] == ["v1"]
    assert [(r["repo_name"], r["line"]) for r in rejects.orderBy("repo_name").collect()] == [("one", "noise"), ("two", "noise")]


def test_a_killed_stage_leaves_one_copy_and_one_mark(spark, tmp_path, monkeypatch):
    import pytest

    from repochron.operators.summary import resume
    df = spark.createDataFrame([("o", "a", 1), ("o", "a", 2), ("o", "b", 3)], "owner string, repo string, n int")
    data, manifest = str(tmp_path / "data"), str(tmp_path / "done")
    marks = sinks.mark_done

    def killed(*_):
        raise KeyboardInterrupt
    monkeypatch.setattr(sinks, "mark_done", killed)
    with pytest.raises(KeyboardInterrupt):          # after the rows, before the marks
        sinks.commit_stage(df, data, manifest, "extract", "night-1")
    monkeypatch.setattr(sinks, "mark_done", marks)
    assert sinks.read_stage(spark, data, manifest, "extract") is None and sinks.done_keys(spark, manifest, "extract") is None
    for _ in range(2):                              # and run twice more
        sinks.commit_stage(df, data, manifest, "extract", "night-1")
    assert sorted(r["n"] for r in sinks.read_stage(spark, data, manifest, "extract").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{manifest}/stage=extract").count() == 2
    more = spark.createDataFrame([("o", "b", 9), ("o", "c", 4)], "owner string, repo string, n int")
    todo = resume(more, sinks.done_keys(spark, manifest, "extract"))
    sinks.commit_stage(todo, data, manifest, "extract", "night-2")
    assert sorted(r["n"] for r in sinks.read_stage(spark, data, manifest, "extract").collect()) == [1, 2, 3, 4]
    (tmp_path / "done" / "stage=extract" / "run=night-2" / "_SUCCESS").unlink()     # marks cut short don't count
    assert sorted(r["repo"] for r in sinks.done_keys(spark, manifest, "extract").collect()) == ["a", "b"]
