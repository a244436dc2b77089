"""Stand-in views: the given tables renamed into the repository-history schema.

``/root/testdata`` holds no repository history, so every registered query runs
the library's operators on a projection of the given tables (the same
projection is written in SQL for the oracle). All views read whole tables.

| view            | from                 | stands for                               |
|-----------------|----------------------|------------------------------------------|
| commits         | events               | one commit per event, repo = user        |
| commit_parents  | commits (by order)   | parent hashes by position                |
| commit_files    | lineitem x orders    | one modified file per line item          |
| patches         | documents            | one patch per document, commit = 3 docs  |
| code            | documents            | file text after / before (previous doc)  |
| issues etc.     | conversations        | issue = turn 0, comments = later turns   |
| pull_requests   | events               | purchases become pull requests           |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repochron.functions.scalars import GITHUB_TS_FORMAT, ts_to_epoch, ts_to_text
from repochron.operators.cycles import commit_order
from repochron.operators.ordered import ordered_scan
from repochron.session import write_through

# Fixed values of the stand-in mapping (identical in the oracle SQL).
OWNER = "acme"
DOCS_PER_COMMIT_SPAN = 60        # documents doc_id // 60 form one commit of a source
BASE_EPOCH = 1704067200          # 2024-01-01T00:00:00Z, issues are placed after it
ISSUE_SPREAD = 2592000           # 30 days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _repo_of(user_col) -> F.Column:
    return F.concat(F.lit("r"), F.col(user_col).cast("string"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> commits with workflow counters (X02 columns) as plain inputs."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    return ev.select(
        F.lit(OWNER).alias("owner"),
        _repo_of("user_id").alias("repo"),
        F.sha1(F.col("event_id").cast("string")).alias("hash"),
        "event_id",
        ts_to_epoch("ts").alias("committer_epoch"),
        ts_to_text("ts").alias("committer_date"),
        F.concat(et, F.lit(":"), et, F.lit("@example.org")).alias("author"),
        F.concat(F.lit("bot"), (F.col("event_id") % 3).cast("string"),
                 F.lit(":ci@example.org")).alias("committer"),
        (et == "signup").cast("bigint").alias("snakemake_n_rules_added"),
        (et == "error").cast("bigint").alias("snakemake_n_rules_removed"),
        (k < 20).cast("bigint").alias("snakemake_n_modules_added"),
        (k >= 95).cast("bigint").alias("snakemake_n_modules_removed"),
        (et.isin("signup", "error") | (k < 20)).alias("snakemake_related"),
        F.array(et).alias("file_extensions"),
    )


def narrow_order(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Commit order written with the columns that positions, dates and parents need (and ``more``)."""
    c = commits(spark, sf_dir).select("owner", "repo", "hash", "event_id", "committer_epoch", "committer_date", *more)
    return commit_order(c, materialize=True)


def commits_with_parents(spark: SparkSession, sf_dir: str, order: DataFrame | None = None) -> DataFrame:
    """Parents by position in commit order: every 10th event is a two-parent merge
    of the commits 5 and 1 back, every 10th+5 a three-parent merge (1, 2, 3 back),
    the rest have the previous commit as parent; the first commit is a root."""
    c = commits(spark, sf_dir)
    if order is None:
        order = narrow_order(spark, sf_dir)
    o = order.select("owner", "repo", "hash", "idx", "event_id")
    back = (F.when((F.col("event_id") % 10 == 0) & (F.col("idx") >= 5), F.array(F.lit(5), F.lit(1)))
             .when((F.col("event_id") % 10 == 5) & (F.col("idx") >= 3),
                   F.array(F.lit(1), F.lit(2), F.lit(3)))
             .when(F.col("idx") >= 1, F.array(F.lit(1)))
             .otherwise(F.array().cast("array<int>")))
    edges = o.select("owner", "repo", F.col("hash").alias("child"),
                     F.posexplode(back).alias("pos", "back"), "idx")
    edges = edges.withColumn("pidx", F.col("idx") - F.col("back"))
    pos_hash = o.select("owner", "repo", F.col("idx").alias("pidx"), F.col("hash").alias("parent"))
    edges = edges.join(pos_hash, ["owner", "repo", "pidx"], "inner")
    parents = (edges.groupBy("owner", "repo", "child")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))),
                                lambda s: s["parent"]).alias("parents"))
               .withColumnRenamed("child", "hash"))
    return (c.join(parents, ["owner", "repo", "hash"], "left")
             .withColumn("parents", F.coalesce("parents", F.array().cast("array<string>"))))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> patches(repo, pos, hash, a_path, patch); en -> .py, de -> .smk."""
    d = table(spark, sf_dir, "documents")
    pos = F.expr(f"doc_id div {DOCS_PER_COMMIT_SPAN}")
    ext = (F.when(F.col("lang") == "en", F.lit(".py"))
            .when(F.col("lang") == "de", F.lit(".smk")).otherwise(F.lit(".txt")))
    return d.select(
        F.col("source").alias("repo"),
        pos.alias("pos"),
        F.sha1(F.concat(F.col("source"), F.lit(":"), pos.cast("string"))).alias("hash"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext).alias("a_path"),
        F.col("text").alias("patch"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders -> commit_files: commit = order, file = part bucket."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    ext = (F.when(F.col("l_returnflag") == "R", F.lit(".smk"))
            .when(F.col("l_returnflag") == "A", F.lit(".py")).otherwise(F.lit(".txt")))
    fname = F.when(F.col("l_partkey") % 200 == 0, F.lit("Snakefile")).otherwise(
        F.concat(F.lit("f"), (F.col("l_partkey") % 200).cast("string"), ext))
    folder = F.when(F.col("l_linestatus") == "F", F.lit("workflow/scripts/")).otherwise(F.lit("src/"))
    return j.select(
        F.col("o_orderpriority").alias("repo"),
        F.col("o_orderkey").cast("string").alias("hash"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 50).cast("string")).alias("author"),
        ts_to_epoch("o_orderdate").alias("committer_epoch"),
        fname.alias("filename"),
        F.concat(folder, fname).alias("new_path"),
        F.col("l_quantity").cast("bigint").alias("n_added_lines"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("n_deleted_lines"),
        F.when(F.col("l_returnflag") == "R", F.lit("DELETE"))
         .when(F.col("l_returnflag") == "A", F.lit("ADD")).otherwise(F.lit("MODIFY"))
         .alias("change_type"),
        F.col("l_linenumber").alias("line_no"),
    )


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> commit_files with code: one file per document, commit = 3 documents
    of a source, each a snapshot after its change (the code before is the previous document of the source, J15).
    en -> a rule file ``Snakefile``, de -> ``rules/<id>.smk``, es -> a script under
    ``workflow/scripts/``, fr -> ``docs/<id>.txt``."""
    d = table(spark, sf_dir, "documents")
    pos = F.expr(f"doc_id div {DOCS_PER_COMMIT_SPAN}")
    ident = F.col("doc_id").cast("string")
    new_path = (F.when(F.col("lang") == "en", F.lit("Snakefile"))
                 .when(F.col("lang") == "de", F.concat(F.lit("rules/"), ident, F.lit(".smk")))
                 .when(F.col("lang") == "es", F.concat(F.lit("workflow/scripts/"), ident, F.lit(".py")))
                 .otherwise(F.concat(F.lit("docs/"), ident, F.lit(".txt"))))
    return d.select(F.lit(OWNER).alias("owner"), F.col("source").alias("repo"),
                 F.sha1(F.concat(F.col("source"), F.lit(":"), pos.cast("string"))).alias("hash"),
                 F.col("doc_id").alias("pos"), new_path.alias("new_path"),
                 F.element_at(F.split(new_path, "/"), -1).alias("filename"),
                 F.col("text").alias("source_code"))


def ladder(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders -> (edges, refs) of one repository with a merge at every commit: orders by key, each one's parents are the two
    before it; a customer's last order is tagged."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = ordered_scan(orders.withColumn("owner", F.lit(OWNER)), ["owner"], ["o_orderkey"], F.expr("o_orderkey div 4096"), index="idx")
    c = write_through(c.select("owner", F.lit("ladder").alias("repo"), "idx", "o_custkey", "o_orderkey",
                               F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("hash")), "ladder")
    down = c.select("owner", "repo", F.col("hash").alias("child"), "idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    edges = (down.withColumn("at", F.col("idx") - F.col("pos") - 1)
             .join(c.select(F.col("idx").alias("at"), F.col("hash").alias("parent")), "at").select("owner", "repo", "child", "pos", "parent"))
    last = c.groupBy("owner", "repo", "o_custkey").agg(F.max_by("hash", "o_orderkey").alias("hash"))
    return edges, last.select("owner", "repo", "hash", F.concat(F.lit("v"), "hash").alias("ref"))


def wide_pull_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders -> (pull requests, commits, order) of one repository: orders by key are its commits; a pull request for each
    priority and status merges the first and the last of its orders, so ranges are as wide as the history."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", ts_to_epoch("o_orderdate").alias("committer_epoch"),
                                              ts_to_text("o_orderdate").alias("committer_date"))
    order = ordered_scan(o.select(F.lit(OWNER).alias("owner"), F.lit("wide").alias("repo"), "*"), ["owner", "repo"], ["o_orderkey"],
                         F.expr("o_orderkey div 4096"), index="idx")
    order = write_through(order.withColumn("hash", F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))), "wide")
    ends = order.groupBy("owner", "repo", "o_orderpriority", "o_orderstatus").agg(
        F.min_by("hash", "idx").alias("first"), F.max_by("hash", "idx").alias("last"), F.min("o_orderkey").alias("number"))
    sha = F.concat(F.lit("m"), F.col("number").cast("string"))
    commits = ends.select("owner", "repo", sha.alias("hash"), F.array("first", "last").alias("parents"))
    prs = ends.select("owner", "repo", "number", F.lit("2024-01-01T00:00:00Z").alias("created_at"), sha.alias("merge_commit_sha"),
                      F.struct(F.col("o_orderpriority").alias("login")).alias("user"))
    return prs, commits, order.select("owner", "repo", "hash", "idx", "committer_date", "committer_epoch")


def patches_to_parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents -> (patches against every parent, commits): the first parent is the commit before; every third commit
    also merges the one before that, and its patch against this parent shows the documents of both."""
    p = patches(spark, sf_dir)
    w = Window.partitionBy("repo").orderBy("pos")
    c = (p.select("repo", "pos", "hash").distinct()
         .select("*", F.lag("hash").over(w).alias("p0"), F.lag("hash", 2).over(w).alias("p1")))
    merge = (F.col("pos") % 3 == 0) & F.col("p1").isNotNull()
    c = c.select("repo", "pos", "hash", "p0", F.when(merge, F.col("p1")).alias("p1"))
    own = p.select("repo", "hash", "a_path", "patch").join(c, ["repo", "hash"])
    before = p.select("repo", F.col("hash").alias("p0"), "a_path", "patch").join(c, ["repo", "p0"])
    out = [own.select("repo", "hash", F.col("p0").alias("parent"), "a_path", "patch")]
    out += [x.where("p1 is not null").select("repo", "hash", F.col("p1").alias("parent"), "a_path", "patch") for x in (own, before)]
    parents = F.filter(F.array("p0", "p1"), lambda x: x.isNotNull())
    return out[0].unionByName(out[1]).unionByName(out[2]), c.select("repo", "hash", parents.alias("parents"))


def issue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> one row per conversation with its created epoch and turns."""
    cv = table(spark, sf_dir, "conversations")
    per = cv.groupBy("conv_id").agg(F.max("turn").alias("max_turn"),
                                    F.min_by("role", "turn").alias("opener"))
    created = F.lit(BASE_EPOCH) + (F.col("conv_id") * F.lit(7919 * 331)) % F.lit(ISSUE_SPREAD)
    return per.select("conv_id", "max_turn", "opener", created.alias("created_epoch"))


def _gh_text(epoch_col) -> F.Column:
    return F.date_format(F.timestamp_seconds(epoch_col), GITHUB_TS_FORMAT)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = issue_times(spark, sf_dir)
    closed = F.when(F.col("max_turn") >= 3,
                    _gh_text(F.col("created_epoch") + F.col("max_turn") * 3600))
    return it.select(
        F.lit(OWNER).alias("owner"),
        F.concat(F.lit("r"), (F.col("conv_id") % 150).cast("string")).alias("repo"),
        F.col("conv_id").alias("number"),
        _gh_text(F.col("created_epoch")).alias("created_at"),
        closed.alias("closed_at"),
        F.col("max_turn").alias("comments"),
        F.struct(F.col("opener").alias("login")).alias("user"),
    )


def issue_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations").filter(F.col("turn") > 0)
    it = issue_times(spark, sf_dir).select("conv_id", "created_epoch")
    j = cv.join(it, "conv_id")
    repo = F.concat(F.lit("r"), (F.col("conv_id") % 150).cast("string"))
    return j.select(
        F.lit(OWNER).alias("owner"), repo.alias("repo"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("https://api.example.com/repos/acme/"), repo, F.lit("/issues/"),
                 F.col("conv_id").cast("string")).alias("issue_url"),
        _gh_text(F.col("created_epoch") + F.col("turn") * 1800).alias("created_at"),
        F.struct(F.col("role").alias("login")).alias("user"),
    )


def issue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations").filter(
        (F.col("turn") > 0) & (F.col("role") == "assistant"))
    it = issue_times(spark, sf_dir).select("conv_id", "created_epoch")
    j = cv.join(it, "conv_id")
    actor = F.when(F.col("turn") == 1, F.lit(None).cast("struct<login:string>")).otherwise(
        F.struct(F.col("role").alias("login")))
    return j.select(
        F.lit(OWNER).alias("owner"),
        F.concat(F.lit("r"), (F.col("conv_id") % 150).cast("string")).alias("repo"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("turn") % 4 == 1, F.lit("labeled")).otherwise(F.lit("assigned")).alias("event"),
        _gh_text(F.col("created_epoch") + F.col("turn") * 1800 + 60).alias("created_at"),
        actor.alias("actor"),
        F.struct(F.col("conv_id").alias("number")).alias("issue"),
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of type purchase -> pull requests merged by that event's commit;
    every 8th (+4) has no merge commit, every 12th (+8) an unknown one."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    created = F.floor(ts_to_epoch("ts")) - 7200
    sha = (F.when(F.col("event_id") % 8 == 4, F.lit(None).cast("string"))
            .when(F.col("event_id") % 12 == 8,
                  F.sha1(F.concat(F.lit("x"), F.col("event_id").cast("string"))))
            .otherwise(F.sha1(F.col("event_id").cast("string"))))
    return ev.select(
        F.lit(OWNER).alias("owner"), _repo_of("user_id").alias("repo"),
        (F.col("event_id") + 100000).alias("number"),
        _gh_text(created).alias("created_at"),
        sha.alias("merge_commit_sha"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login")).alias("user"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> `git log` lines ``hash|author|committer|date|subject|parents``:
    every 50th subject holds a bar, every 97th (+1) order is a root commit, every
    7th a merge of the two previous orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def h(x):
        return F.sha1(F.concat(F.lit("o"), x.cast("string")))

    parents = (F.when(k % 97 == 1, F.lit(""))
                .when(k % 7 == 0, F.concat(h(k - 1), F.lit(" "), h(k - 2)))
                .otherwise(h(k - 1)))
    subject = F.concat(F.lit("order "), k.cast("string"),
                       F.when(k % 50 == 0, F.lit(" | hotfix")).otherwise(F.lit("")))
    value = F.concat_ws("|", h(k), F.concat(F.lit("a"), F.col("o_custkey").cast("string")),
                        F.col("o_orderstatus"),
                        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")),
                        subject, parents)
    # the line is built before a commit's repositories part
    return o.select(_log_repos(k).alias("repos"), value.alias("value")).select(F.explode("repos").alias("repo"), "value")


def _log_repos(order_key) -> F.Column:
    """Repositories that hold an order's commit: seven, and a fork with every fifth commit."""
    own = F.concat(F.lit("g"), (order_key % 7).cast("string"))
    return F.when(order_key % 5 == 0, F.array(own, F.lit("fork"))).otherwise(F.array(own))


def log_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders -> tags (every 11th commit, two on every 22nd) and branch names (every third),
    of their own repositories only."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("g"), (k % 7).cast("string")).alias("repo_name"),
        F.sha1(F.concat(F.lit("o"), k.cast("string"))).alias("commit_hash"), k.alias("k"))
    tags = rows.where("k % 11 = 0").select("repo_name", "commit_hash", F.explode(
        F.when(F.col("k") % 22 == 0, F.array(F.concat(F.lit("v"), F.col("k").cast("string")), F.lit("latest")))
         .otherwise(F.array(F.concat(F.lit("v"), F.col("k").cast("string"))))).alias("tag"))
    branches = rows.where("k % 3 = 0").select("repo_name", "commit_hash",
                                              F.concat(F.lit("main~"), F.col("k").cast("string")).alias("branch"))
    return tags, branches


def numstat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> numstat lines of the order's commit: R rows are binary ('-'),
    line 6 of A rows has a non-numeric first count, line 7 of O rows a second."""
    li = table(spark, sf_dir, "lineitem")
    first = (F.when(F.col("l_returnflag") == "R", F.lit("-"))
              .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 6), F.lit("bin"))
              .otherwise(F.col("l_quantity").cast("bigint").cast("string")))
    second = (F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), F.lit("x"))
               .otherwise(F.round(F.col("l_tax") * 100).cast("bigint").cast("string")))
    path = F.concat(F.lit("src/f"), (F.col("l_partkey") % 200).cast("string"), F.lit(".py"))
    lines = li.select(_log_repos(F.col("l_orderkey")).alias("repos"),
                      F.sha1(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("hash"),
                      F.concat_ws("\t", first, second, path).alias("value"))
    return lines.select(F.explode("repos").alias("repo"), "hash", "value")
