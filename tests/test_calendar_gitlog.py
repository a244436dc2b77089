"""Date ranges: literal rows and properties; commit-log text parsing."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from repochron.operators import calendar as cal
from repochron.sources import gitlog as gl


def day(text):
    return dt.date.fromisoformat(text)


# (first day, last day, interval) and the ranges, worked by hand from a calendar.
LITERAL = [
    ("2023-11-17", "2024-02-03", "m", [("2023-11-17", "2023-11-30"), ("2023-12-01", "2023-12-31"),
                                       ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-03")]),
    ("2024-02-10", "2024-02-10", "m", [("2024-02-10", "2024-02-10")]),
    ("2024-01-10", "2024-01-16", "w", [("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-16")]),
    ("2024-01-08", "2024-01-14", "w", [("2024-01-08", "2024-01-14")]),
    ("2023-12-31", "2024-01-01", "d", [("2023-12-31", "2023-12-31"), ("2024-01-01", "2024-01-01")]),
    ("2024-03-06", "2024-03-01", "m", []), ("2024-03-06", "2024-03-01", "w", []), ("2024-03-06", "2024-03-01", "d", []),
    ("2024-01-01", "2024-12-31", "q", []),
]


def test_date_ranges_literal(spark):
    for start, end, interval, want in LITERAL:
        df = spark.createDataFrame([(day(start), day(end))], "s date, e date")
        got = sorted((r["range_start"], r["range_end"]) for r in cal.date_ranges(df, "s", "e", interval).collect())
        assert got == [(day(a), day(b)) for a, b in want], (start, end, interval)


def test_log_lines_and_numstat(spark):
    h = "a" * 40
    lines = spark.createDataFrame([
        ("r", f"'{h}|Ann|Cy|2024-01-01 10:00:00 +0100|fix|{'b' * 40} {'c' * 40}'"),
        ("r", f"{'b' * 40}|Ann|Cy|2024-01-01|a | b|{'c' * 40}"),
        ("r", f"{'c' * 40}|Ann|Cy|2024-01-01|root|"),
        ("r", ""),
    ], "repo string, value string")
    strict = gl.parse_log_lines(lines, strict=True).filter("valid").collect()
    assert [r["commit_hash"] for r in strict] == [h, "c" * 40]
    assert strict[0]["date"] == "2024-01-01 10:00:00 +0100"
    loose = gl.parse_log_lines(lines).filter("valid").collect()
    assert [r["message"] for r in loose] == ["fix", "a | b", "root"]
    bad = gl.log_rejects(lines).collect()
    assert [(r["line"], r["reason"]) for r in bad] == [("", "not six fields")]
    assert {r["reason"] for r in gl.log_rejects(lines, strict=True).collect()} == {"not six fields", "bar in a field"}
    ns = spark.createDataFrame([("r", h, "3\t1\ta.py"), ("r", h, "-\t-\tbin.png"), ("r", h, "x\t5\tc.py"),
                                ("r", h, "4\tz\td.py"), ("r", h, ""), ("r", h, "99999999999999999999\t1\te.py")],
                               "repo string, hash string, value string")
    parsed = gl.parse_numstat(ns)
    t = gl.numstat_totals(parsed).collect()[0]
    assert (t["lines_added"], t["lines_deleted"]) == (7, 1)
    files = gl.changed_files(parsed.select(F.col("repo_name").alias("repo"), F.col("commit_hash").alias("hash"),
                                           F.col("path").alias("value")))
    rows = {r["commit_hash"]: r for r in gl.assemble_commits(
        gl.parse_log_lines(lines), totals=gl.numstat_totals(parsed), files=files).collect()}
    assert rows[h]["is_merge_commit"] and rows[h]["merged_branch"] == ""
    assert rows[h]["changed_files"] == ["a.py", "bin.png", "c.py", "d.py", "e.py"]
    root = rows["c" * 40]
    assert not root["is_merge_commit"] and root["merged_branch"] is None
    assert root["changed_files"] == ["unknown"] and root["tags"] == [] and root["branch"] == "unknown"


def test_forks_share_hashes_and_roots_have_no_parent(spark):
    h, p = "a" * 40, "b" * 40
    lines = spark.createDataFrame([(r, f"{x}|A|C|d|m|{parents}") for r in ("one", "two") for x, parents in
                                   ((h, f"{p} {'c' * 40}"), (p, ""))], "repo string, value string")
    ns = spark.createDataFrame([("one", h, "3\t1\tf.py"), ("two", h, "5\t0\tg.py")], "repo string, hash string, value string")
    tags = spark.createDataFrame([("one", h, "v2"), ("one", h, "v1"), ("two", p, "w")], "repo_name string, commit_hash string, tag string")
    names = spark.createDataFrame([("one", h, "main"), ("one", p, "main~1"), ("two", h, "dev")],
                                  "repo_name string, commit_hash string, branch string")
    rows = gl.assemble_commits(gl.parse_log_lines(lines), totals=gl.numstat_commit_stats(gl.parse_numstat(ns)),
                               tags=tags, branches=names).collect()
    got = {(r["repo_name"], r["commit_hash"][0]): r for r in rows}
    assert len(rows) == 4
    assert [(got[k]["lines_added"], got[k]["changed_files"]) for k in (("one", "a"), ("two", "a"), ("one", "b"))] == [
        (3, ["f.py"]), (5, ["g.py"]), (0, ["unknown"])]
    assert got["one", "a"]["tags"] == ["v1", "v2"] and got["two", "a"]["tags"] == [] and got["two", "b"]["tags"] == ["w"]
    assert [got[k]["merged_branch"] for k in (("one", "a"), ("two", "a"), ("one", "b"))] == ["main~1", "", None]
    assert [got[k]["branch"] for k in (("one", "b"), ("two", "a"), ("two", "b"))] == ["main~1", "dev", "unknown"]


def test_date_ranges_cover_without_gap_or_overlap(spark):
    import random
    rnd = random.Random(4)
    spans = []
    for _ in range(40):
        s = dt.date(2019, 1, 1) + dt.timedelta(days=rnd.randrange(0, 2200))
        spans.append((s, s + dt.timedelta(days=rnd.randrange(-3, 120))))
    df = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(spans)], "id int, s date, e date")
    one = dt.timedelta(days=1)
    for interval in ("m", "w", "d"):
        got = cal.date_ranges(df, "s", "e", interval).collect()
        for i, (s, e) in enumerate(spans):
            mine = sorted((r["range_start"], r["range_end"]) for r in got if r["id"] == i)
            if e < s:
                assert mine == []
                continue
            assert mine[0][0] <= s <= mine[0][1] and mine[-1][1] == e
            assert interval == "w" or mine[0][0] == s
            assert all(b + one == a for (_, b), (a, _) in zip(mine, mine[1:]))
            for k, (a, b) in enumerate(mine):
                assert a <= b
                if interval == "d":
                    assert a == b
                if interval == "m":
                    assert (a.year, a.month) == (b.year, b.month) and (k == 0 or a.day == 1)
                    assert b == e or (b + one).day == 1
                if interval == "w":
                    assert a.weekday() == 0 and (b == e or b.weekday() == 6)


def test_log_lines_are_read_from_both_ends(spark):
    """Against the pattern with one group per field, on lines with bars, quotes, blanks and missing fields."""
    pattern = re.compile(r"([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)\|([0-9A-Fa-f ]*)", re.S)
    rng = random.Random(5)
    lines = ["'" * rng.randrange(2) + "".join(rng.choice("a0|||' é") for _ in range(rng.randrange(16))) + "'" * rng.randrange(2)
             for _ in range(3000)] + ["", "'", "|||||", "'|||||'", None, "h|a|c|d|" + "s|" * 500 + "ab cd"]
    df = spark.createDataFrame([("r", k, v) for k, v in enumerate(lines)], "repo string, k int, value string")
    names = ("commit_hash", "author", "committer", "date", "message", "parent_commit")
    want = {}
    for line in lines:
        v = None if line is None else re.sub(r"^'|'\Z", "", line)
        m = None if v is None else pattern.fullmatch(v)
        want[line] = m.groups() if m else None
    assert sum(w is not None for w in want.values()) > 100
    parsed = gl.parse_log_lines(df.select("repo", "value")).collect()
    got = [tuple(r[n] for n in names) if r["valid"] else None for r in parsed]
    assert got == [want[line] for line in lines]
    refused = [r["line"] for r in gl.log_rejects(df.select("repo", "value")).collect()]
    assert refused == [line for line in lines if want[line] is None]


def test_lines_are_built_once(spark):
    """No filter or join makes a line a second time; ``lines`` counts the calls that make one."""
    h, calls = "a" * 40, spark.sparkContext.accumulator(0)

    def made(text):
        calls.add(1)
        return text

    made = F.udf(made, "string")
    log = spark.createDataFrame([("r", f"{h}|A|C|d|m|"), ("r", "no commit"), ("r", f"{'b' * 40}|A|C|d|m|{h}")],
                                "repo string, value string").withColumn("value", made("value"))
    ns = spark.createDataFrame([("r", h, "3\t1\tf.py"), ("r", h, "no count"), ("r", None, "1\t1\tg.py"), (None, h, "1\t1\tg.py")],
                               "repo string, hash string, value string").withColumn("value", made("value"))
    rows = gl.assemble_commits(gl.parse_log_lines(log), totals=gl.numstat_commit_stats(gl.parse_numstat(ns))).collect()
    assert sorted((r["commit_hash"], r["lines_added"], r["changed_files"]) for r in rows) == [
        (h, 3, ["f.py"]), ("b" * 40, 0, ["unknown"])]
    assert calls.value <= 7                             # the lines of a null key may be left out before


def test_names_of_first_parents_are_joined_before_the_path_lists(spark):
    h, p = "a" * 40, "b" * 40
    lines = spark.createDataFrame([("r", f"{h}|A|C|d|m|{p} {'c' * 40}"), ("r", f"{p}|A|C|d|m|")], "repo string, value string")
    ns = spark.createDataFrame([("r", h, "3\t1\tf.py")], "repo string, hash string, value string")
    names = spark.createDataFrame([("r", p, "main")], "repo_name string, commit_hash string, branch string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = gl.assemble_commits(gl.parse_log_lines(lines), totals=gl.numstat_commit_stats(gl.parse_numstat(ns)), branches=names)
        plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) Exchange *\nInput \[\d+\]: (.*)", plan)
        assert moved and not any("changed_files" in m for m in moved)
        assert {r["commit_hash"][0]: (r["branch"], r["merged_branch"]) for r in out.collect()} == {
            "a": ("unknown", "main"), "b": ("main", None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
