"""Per-file and per-commit workflow facts."""

from pyspark.sql import functions as F

from repochron.operators import commits as cf


def files_df(spark, rows):
    return spark.createDataFrame(rows, "owner string, repo string, hash string, filename string, "
                                 "new_path string, source_code string, source_code_before string, "
                                 "change_type string")


def test_rule_moved_between_files(spark):
    # rule r moves from a.smk to b.smk in one commit: commit level 0 / 0, file level 1 and 1.
    rows = [("o", "x", "c1", "a.smk", "a.smk", "rule s:\n", "rule r:\nrule s:\n", "MODIFY"),
            ("o", "x", "c1", "b.smk", "b.smk", "rule r:\nrule r:\n", "", "MODIFY"),
            ("o", "x", "c1", "run.py", "workflow/scripts/run.py", "print()", None, "ADD")]
    f = cf.file_workflow_columns(files_df(spark, rows))
    per_file = {r["filename"]: (r["snakemake_n_rules_added"], r["snakemake_n_rules_removed"],
                                r["snakemake_related"]) for r in f.collect()}
    assert per_file["a.smk"] == (0, 1, True)
    assert per_file["b.smk"] == (2, 0, True)       # repeats counted per occurrence
    assert per_file["run.py"] == (0, 0, True)
    c = cf.commit_workflow_facts(f).collect()[0]
    assert c["snakemake_n_rules_added"] == 0 and c["snakemake_n_rules_removed"] == 0
    assert c["snakemake_rules_from_code"] == ["r", "s"]
    assert c["snakemake_included_scripts"] == ["workflow/scripts/run.py"]
    assert c["snakemake_rule_files"] == ["a.smk", "b.smk"] and c["snakemake_related"]


def test_module_mixup_compat_switch(spark):
    rows = [("o", "x", "c1", "Snakefile", "Snakefile", "module m:\n", "", "MODIFY")]
    compat = cf.file_workflow_columns(files_df(spark, rows), compat=True).collect()[0]
    assert (compat["snakemake_n_rules_added"], compat["snakemake_n_modules_added"]) == (1, 0)
    fixed = cf.file_workflow_columns(files_df(spark, rows)).collect()[0]
    assert (fixed["snakemake_n_rules_added"], fixed["snakemake_n_modules_added"]) == (0, 1)


def test_rename_of_rule_and_defaults(spark):
    rows = [("o", "x", "c1", "Snakefile", "Snakefile", "rule new:\ninclude: 'x.smk'\ninclude: y.txt",
             "rule old:", "MODIFY"),
            ("o", "x", "c2", "README.md", "README.md", "rule z:", "", "MODIFY")]
    facts = cf.commit_workflow_facts(cf.file_workflow_columns(files_df(spark, rows)))
    got = {r["hash"]: r for r in facts.collect()}
    assert (got["c1"]["snakemake_n_rules_added"], got["c1"]["snakemake_n_rules_removed"]) == (1, 1)
    assert got["c1"]["snakemake_included_rules"] == ["x.smk"]
    assert got["c1"]["snakemake_irregular_rule_files"] == ["y.txt"]
    assert not got["c2"]["snakemake_related"] and got["c2"]["snakemake_rules_from_code"] == []
    commits = spark.createDataFrame([("o", "x", "c1"), ("o", "x", "c3")], "owner string, repo string, hash string")
    att = {r["hash"]: r for r in cf.attach_facts(commits, facts).collect()}
    assert att["c3"]["snakemake_n_rules_added"] == 0 and att["c3"]["snakemake_rule_files"] == []


def test_extensions_and_change_types(spark):
    rows = [("o", "x", "c1", "a.PY", "a.PY", None, None, "ADD"),
            ("o", "x", "c1", "Makefile", "Makefile", None, None, "MODIFY"),
            ("o", "x", "c1", "b.", "b.", None, None, "ADD")]
    got = cf.commit_file_sets(files_df(spark, rows)).collect()[0]
    assert got["file_extensions"] == ["py"] and got["change_types"] == ["ADD", "MODIFY"]
    p = cf.project_commits(spark.createDataFrame([("o", "x", "h")], "owner string, repo string, hash string"))
    assert len(p.columns) == 2 + len(cf.COMMIT_FIELDS) and p.select(F.col("msg")).collect()[0][0] is None


def test_attach_code_before(spark):
    rows = [("o", "x", "h1", "a.smk", 1.0, "rule a:"), ("o", "x", "h2", "a.smk", 200000.0, "rule b:"),
            ("o", "x", "h3", "b.smk", 5.0, "rule c:"), ("o", "x", "h4", "a.smk", 200001.0, "rule d:")]
    df = spark.createDataFrame(rows, "owner string, repo string, hash string, new_path string, "
                               "committer_epoch double, source_code string")
    got = {r["hash"]: r["source_code_before"] for r in cf.attach_code_before(df, bucket_seconds=3600).collect()}
    assert got == {"h1": None, "h2": "rule a:", "h3": None, "h4": "rule b:"}


def test_occurrences_missing_from_the_other_list(spark):
    import random

    from repochron.functions.workflow_code import occurrence_diff
    rnd = random.Random(1)
    rows = [([rnd.choice("abcde") * rnd.randrange(3) for _ in range(rnd.randrange(12))], [rnd.choice("abcde") for _ in range(rnd.randrange(6))])
            for _ in range(80)] + [([], []), ([""], []), (["", "a"], [""])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["n"] for r in df.select("i", occurrence_diff("a", "b").alias("n")).collect()}
    assert got == {i: sum(x not in b for x in a) for i, (a, b) in enumerate(rows)}


def test_names_before_equal_names_of_the_text_before(spark):
    rows = [("o", "x", f"h{i}", "Snakefile" if i % 3 else "a.smk", float(i * 50_000), f"rule r{i % 4}:\nmodule m{i % 2}:\nrule q:") for i in range(12)]
    df = spark.createDataFrame(rows, "owner string, repo string, hash string, new_path string, committer_epoch double, source_code string") \
        .withColumn("filename", F.col("new_path"))
    counts = [f"snakemake_n_{x}" for x in ("rules_added", "rules_removed", "modules_added", "modules_removed")]
    texts = cf.file_workflow_columns(cf.attach_code_before(df))
    lagged = cf.names_before(cf.code_names(df))
    names = cf.file_workflow_columns(lagged)
    assert sorted(map(tuple, texts.select("hash", *counts).collect())) == sorted(map(tuple, names.select("hash", *counts).collect()))
    assert "source_code" not in lagged.columns
    for node in cf.attach_code_before(df)._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert not ("Window" in node and "source_code" in node)


def test_files_per_commit(spark):
    df = spark.createDataFrame([("o", "x", "h", "b.py", 2), ("o", "x", "h", "a.py", 1), ("o", "x", "i", "a.py", 5)],
                               "owner string, repo string, hash string, new_path string, n_added_lines long")
    got = {r["hash"]: (r["n_files"], [tuple(f) for f in r["files"]]) for r in cf.files_per_commit(df).collect()}
    assert got == {"h": (2, [("a.py", 1), ("b.py", 2)]), "i": (1, [("a.py", 5)])}


def test_first_parent_sizes(spark):
    from repochron.operators.growth import commit_sizes
    patches = spark.createDataFrame([("r", "m", "p", "x.py", "12345"), ("r", "m", "q", "x.py", "123"), ("r", "p", None, "x.py", "1234567"),
                                     ("r", "q", "p", "x.md", "1"), ("r", "q", "p", "y.smk", "12")],
                                    "repo string, hash string, parent string, a_path string, patch string")
    commits = spark.createDataFrame([("r", "m", ["p", "q"]), ("r", "p", []), ("r", "q", ["p"]), ("r", "z", ["m"])],
                                    "repo string, hash string, parents array<string>")
    assert {r["hash"]: r["commit_size"] for r in commit_sizes(patches, commits).collect()} == {"m": 5, "p": 7, "q": 2, "z": 0}
