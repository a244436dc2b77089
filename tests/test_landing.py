"""Landed files: what is read, what is rejected, never both."""

import json

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from repochron.operators.summary import entity_counts
from repochron.session import write_through
from repochron.sources import landing as ld
from repochron.sources.jsonsplit import json_entries

GOOD = {"number": 1, "created_at": "2024-01-01T00:00:00Z"}
FILES = {
    # a good list, a lone record, an error object, a cut file, a wrong element, an empty list
    "issues": {"list": [GOOD, {"number": 2}], "lone": GOOD, "error": {"message": "Not Found", "status": "404"},
               "cut": '[{"number": 1}, {"number"', "odd": '[{"number": 1}, 7]', "null": "[null]", "none": [], "type": '[{"number": "x"}]'},
    "cicd_artifacts": {"list": {"total_count": 2, "artifacts": [{"id": 1}, {"id": 2}]}, "lone": [{"id": 3}],
                       "error": {"message": "Not Found"}, "cut": '{"artifacts": [{"id": 1}', "odd": {"artifacts": 5},
                       "none": {"artifacts": []}, "null": {"artifacts": None}},
    "pull_requests": {"list": [[{"number": 1}], [{"number": 2}, {"number": 3}]], "error": {"message": "Not Found"},
                      "cut": '[[{"number": 1}], [', "odd": '[[{"number": 1}], "x"]', "none": [], "null": "[[]]"},
    "releases": {"list": [{"id": 1}], "cut": "[", "error": {"message": "Not Found"}},
}
ROWS = {"issues": {"list": 2, "lone": 1}, "cicd_artifacts": {"list": 2, "lone": 1}, "pull_requests": {"list": 3}, "releases": {"list": 1}}
REJECTED = {"issues": {"error", "cut", "odd", "null", "type"}, "cicd_artifacts": {"error", "cut", "odd", "null"},
            "pull_requests": {"error", "cut", "odd"}, "releases": {"cut", "error"}}


def write(folder, entity, repo, content):
    (folder / "o").mkdir(exist_ok=True)
    text = content if isinstance(content, str) else json.dumps(content)
    (folder / "o" / f"{repo}{ld.SUFFIXES[entity]}").write_text(text)


@pytest.mark.parametrize("entity", FILES)
def test_a_file_is_read_or_rejected(spark, tmp_path, entity):
    for repo, content in FILES[entity].items():
        write(tmp_path, entity, repo, content)
    rows, rejects = ld.landed(spark, str(tmp_path), entity)
    assert rows.count() == sum(ROWS[entity].values())              # counted without any column
    assert {r["repo"]: r["count"] for r in rows.groupBy("repo").count().collect()} == ROWS[entity]
    found = rejects.collect()
    assert {r["repo"] for r in found} == REJECTED[entity] and len(found) == len(REJECTED[entity])
    assert all(r["stage"] == "landing" and r["reason"].startswith(f"unreadable {entity} file: ") for r in found)
    repos = spark.createDataFrame([("o", r) for r in FILES[entity]], "owner string, repo string")
    totals = entity_counts(repos, {entity: ld.read_entity(spark, str(tmp_path), entity)}, key=("owner", "repo"))
    assert {r["repo"]: r[f"x_total_{entity}"] for r in totals.collect()} == {r: ROWS[entity].get(r, 0) for r in FILES[entity]}


def test_values_survive_the_cutting(spark, tmp_path):
    write(tmp_path, "issues", "a", [{"number": 5, "created_at": 'x}{",\\é', "user": {"login": "ann"}, "pull_request": {"u\"}": "v"}}])
    r = ld.read_entity(spark, str(tmp_path), "issues").first()
    assert (r["owner"], r["repo"], r["number"], r["created_at"], r["user"]["login"], r["pull_request"]) == \
        ("o", "a", 5, 'x}{",\\é', "ann", {'u"}': "v"})


def test_commit_maps(spark, tmp_path):
    commit = {"author": "a", "committer_epoch": 1.5, "parents": []}
    for repo, content in {"good": {"1" * 40: commit, "2" * 40: commit}, "cut": json.dumps({"1" * 40: commit})[:-1], "list": [commit],
                          "odd": {"1" * 40: commit, "2" * 40: 3}, "bad": '{"a": {"author": tru}}', "none": {}}.items():
        write(tmp_path, "commits", repo, content)
    rows, rejects = ld.landed_commits(spark, str(tmp_path))
    assert sorted((r["repo"], r["hash"][0], r["committer_epoch"]) for r in rows.collect()) == [("good", "1", 1.5), ("good", "2", 1.5)]
    assert sorted(r["repo"] for r in rejects.collect()) == ["bad", "cut", "list", "odd"]


def test_a_large_map_is_read_by_several_tasks(spark, tmp_path):
    """150 MB on one line: several ranges, no value beyond a commit, read and not rejected."""
    code = ('if (x) { y = "}"; }\n' * 5200)
    with open(tmp_path / "big.commits.json", "w") as out:
        out.write("{")
        for k in range(1500):
            out.write((", " if k else "") + json.dumps({f"{k:040d}": {"msg": f"m{k}", "files": [{"source_code": code}]}})[1:-1])
        out.write("}")
    assert (tmp_path / "big.commits.json").stat().st_size > 150_000_000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    try:
        docs = json_entries(spark, str(tmp_path / "big.commits.json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    r = docs.entries.agg(F.count("*").alias("n"), F.count_distinct("at").alias("ranges"), F.max(F.length("value")).alias("longest"),
                         F.count_distinct("key").alias("keys"), F.min(F.length("value")).alias("shortest")).first()
    assert (r["n"], r["keys"]) == (1500, 1500) and r["ranges"] >= 4 and r["longest"] - r["shortest"] < 10
    assert docs.faults.count() == 0


def test_row_groups_are_bounded_by_the_bytes_that_are_read(spark):
    """Rows that compress well: a row group holds its bytes, not those of the compressed file."""
    rows = spark.range(0, 300, 1, 1).select("id", F.repeat(F.format_string("%04d", "id"), 10_000).alias("value"))
    out = write_through(rows, "row-groups", 1 << 20)
    groups = [g for p in ds.dataset(out.inputFiles()[0].removeprefix("file://")).get_fragments() for g in p.row_groups]
    assert max(g.total_byte_size for g in groups) < 5 << 20 and sum(g.num_rows for g in groups) == 300
    assert out.where(F.length("value") == 40_000).count() == 300


def pages(folder, listings):
    for name, contents in listings.items():
        for page, content in contents.items():
            text = content if isinstance(content, str) else json.dumps(content)
            (folder / f"{name}_{page}.json").write_text(text)


def items(n):
    return [{"id": k} for k in range(n)]


def test_listings_must_be_whole(spark, tmp_path):
    pages(tmp_path, {"whole": {1: items(3), 2: items(3), 3: items(1)}, "ended": {1: items(3), 2: []}, "one": {1: items(2)}, "empty": {1: []},
                     "gap": {1: items(3), 4: items(1)}, "headless": {2: items(1)}, "short": {1: items(3), 2: items(2), 3: items(1)},
                     "full": {1: items(3)}, "long": {1: items(4)}, "cut": {1: items(3), 2: "[{"}, "error": {1: {"message": "Not Found"}},
                     "twice": {1: items(3), "01": items(3), 2: items(1)}, "wrong": {1: [{"id": 1}, 5]}})
    rows, rejects = ld.landed_pages(spark, f"{tmp_path}/*.json", page_size=3)
    short = {r["listing"].rsplit("/", 1)[1]: r["count"] for r in rows.groupBy("listing").count().collect()}
    assert short == {"whole": 7, "ended": 3, "one": 2}
    reasons = {}
    for r in rejects.collect():
        reasons.setdefault(r["listing"].rsplit("/", 1)[1], set()).add(r["reason"])
    assert reasons == {
        "gap": {"pages 2 to 3 are missing"}, "headless": {"page 1 is missing"}, "short": {"page 2 is short: 2 records"},
        "full": {"page 1 is full, the next one is missing"}, "long": {"page 1 has 4 records"}, "cut": {"the document does not end"} | {
            "page 1 is full, the next one is missing"}, "error": {"not a list of records"}, "twice": {"page 1 is there twice"},
        "wrong": {"not a list of records"}}
    with pytest.raises(ValueError, match="page"):
        ld.require_whole(rejects)
    by_link, rest = ld.landed_pages(spark, f"{tmp_path}/full_*.json", page_size=3, by_link=True)
    assert by_link.count() == 3
    ld.require_whole(rest)


def test_search_pages_must_add_up(spark, tmp_path):
    def page(total, *ids):
        return {"total_count": total, "items": [{"id": i, "full_name": f"o/{i}"} for i in ids]}
    pages(tmp_path, {"good": {1: page(3, 1, 2), 2: page(3, 3)}, "none": {1: page(0)}, "bare": {1: {"total_count": 1, "message": "x"}},
                     "few": {1: page(9, 1, 2)}, "gap": {1: page(2, 1), 3: page(2, 2)}, "cut": {1: '{"total_count": 1, "items": ['}})
    rows, rejects = ld.search_results(spark, f"{tmp_path}/*.json")
    assert {"o/1", "o/2", "o/3"} <= {r["full_name"] for r in rows.collect()}
    reasons = {}
    for r in rejects.collect():
        reasons.setdefault(r["listing"].rsplit("/", 1)[1], set()).add(r["reason"])
    assert reasons == {"bare": {"no items in the page", "0 of 1 items"}, "few": {"2 of 9 items"}, "gap": {"page 2 is missing"},
                       "cut": {"the document does not end"}}
