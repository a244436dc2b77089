"""Process metrics: exact median, contributors, renames, history range."""

import random
import statistics

from pyspark.sql import functions as F

from repochron.operators import metrics as pm


def test_exact_median_matches_statistics(spark):
    rnd = random.Random(3)
    rows = [(f"g{g}", rnd.choice([0, 1, 1, 2, 3, 5, 8])) for g in range(30) for _ in range(rnd.randrange(1, 12))]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {r["g"]: r["median"] for r in pm.exact_median(df, ["g"], "v").collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == statistics.median([v for k, v in rows if k == g])


def files(spark, rows):
    return spark.createDataFrame(rows, "owner string, repo string, hash string, author string, "
                                 "committer_epoch double, old_path string, new_path string, "
                                 "change_type string, n_added_lines bigint, n_deleted_lines bigint, patch string")


def test_file_metrics_and_changeset(spark):
    rows = [("o", "r", "c1", "ann", 1.0, None, "a.py", "ADD", 100, 0, "+x\n+y"),
            ("o", "r", "c1", "ann", 1.0, None, "b.py", "ADD", 10, 0, "+z"),
            ("o", "r", "c2", "bob", 2.0, "a.py", "a.py", "MODIFY", 2, 1, "-x\n+w\n c\n+v"),
            ("o", "r", "c3", "cid", 3.0, "a.py", "a.py", "MODIFY", 1, 0, "+q")]
    per_file, changes = pm.process_metrics(files(spark, rows))
    m = {r["path"]: r for r in per_file.collect()}
    a = m["a.py"]
    assert a["commitscount_files"] == 3 and a["codechurn_count"] == 102 and a["codechurn_max"] == 100
    assert a["linescount_count"] == 104 and a["linescount_max_added"] == 100
    assert a["contributorscount_count"] == 3
    assert a["contributorscount_minor"] == 2                     # bob 3/104, cid 1/104 < 5 %
    assert abs(a["contributorsexperience_count"] - 100 * 100 / 104) < 1e-9
    assert a["hunkscount_files"] == 1.0                           # hunks 1, 2, 1 -> median 1
    c = changes.collect()[0]
    assert c["changeset_max"] == 2 and abs(c["changeset_avg"] - 4 / 3) < 1e-9


def test_rename_chain_followed(spark):
    rows = [("o", "r", "c1", "a", 1.0, None, "old.py", "ADD", 5, 0, ""),
            ("o", "r", "c2", "a", 2.0, "old.py", "mid.py", "RENAME", 1, 0, ""),
            ("o", "r", "c3", "a", 3.0, "mid.py", "new.py", "RENAME", 1, 0, ""),
            ("o", "r", "c4", "b", 4.0, "new.py", "new.py", "MODIFY", 1, 1, "")]
    per_file, _ = pm.process_metrics(files(spark, rows), hunk_markers=None, follow_renames=True)
    got = {r["path"]: r["commitscount_files"] for r in per_file.collect()}
    assert got == {"new.py": 4}


def test_history_range(spark):
    rows = [("o", "r", f"c{i}", "a", float(i * 86400), None, "a.py", "MODIFY", 1, 0, "") for i in range(5)]
    df = files(spark, rows)
    order = df.select("owner", "repo", "hash", F.col("committer_epoch").cast("bigint").alias("idx"))
    cut = pm.history_range(df, order, from_commit="c1", to_commit="c3")
    assert sorted(r["hash"] for r in cut.collect()) == ["c1", "c2", "c3"]
    since = pm.history_range(df, since="1970-01-03 00:00:00")
    assert sorted(r["hash"] for r in since.collect()) == ["c2", "c3", "c4"]


def test_renames_are_time_aware(spark):
    # t1 create a, t2 rename a->b, t3 a new a, t4 rename b->c, t5 modify the new a
    rows = [("o", "r", "c1", "x", 1.0, None, "a", "ADD", 1, 0, ""),
            ("o", "r", "c2", "x", 2.0, "a", "b", "RENAME", 1, 0, ""),
            ("o", "r", "c3", "x", 3.0, None, "a", "ADD", 1, 0, ""),
            ("o", "r", "c4", "x", 4.0, "b", "c", "RENAME", 1, 0, ""),
            ("o", "r", "c5", "x", 5.0, "a", "a", "MODIFY", 1, 0, "")]
    got = {r["hash"]: r["path"] for r in pm.resolve_renames(files(spark, rows)).collect()}
    assert got == {"c1": "c", "c2": "c", "c3": "a", "c4": "c", "c5": "a"}


def test_binary_only_file_has_no_lines(spark):
    rows = [("o", "r", "c1", "a", 1.0, None, "img.png", "ADD", 0, 0, ""),
            ("o", "r", "c2", "b", 2.0, None, "img.png", "MODIFY", 0, 0, "")]
    per_file, _ = pm.process_metrics(files(spark, rows), hunk_markers=None)
    r = per_file.collect()[0]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert (r["contributorscount_minor"], r["contributorsexperience_count"]) == (0, 0.0)


def test_metrics_of_a_range_between_two_hashes(spark):
    import pytest
    rows = [("o", "r", f"h{i}", "ann", float(i), "a.py", i + 1, 0) for i in range(6)]
    f = spark.createDataFrame(rows, "owner string, repo string, hash string, author string, committer_epoch double, new_path string, "
                              "n_added_lines long, n_deleted_lines long")
    order = spark.createDataFrame([("o", "r", f"h{i}", i) for i in range(6)], "owner string, repo string, hash string, idx long")
    m, c = pm.process_metrics(f, hunk_markers=None, order=order, from_commit="h1", to_commit="h3")
    assert [(r["commitscount_files"], r["codechurn_count"]) for r in m.collect()] == [(3, 9)]
    m, _ = pm.process_metrics(f, hunk_markers=None, order=order, from_commit="h1", to="1970-01-01 00:00:02")
    assert [(r["commitscount_files"], r["codechurn_count"]) for r in m.collect()] == [(2, 5)]
    with pytest.raises(ValueError):
        pm.process_metrics(f, hunk_markers=None, order=order, from_commit="nope", to_commit="h3")
