"""Scans of landed files.

The collection stage (REST paging, cloning) is not rebuilt; its results are
files laid out as ``<root>/<owner>/<repo><suffix>``. Every scan reads all
matching files in parallel, takes ``owner`` / ``repo`` from the file path
(``_metadata.file_path``, S31) and applies an explicit schema: keys of the
commit map are hashes, so schema inference is never used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from repochron.functions.scalars import strip
from repochron.operators.validate import is_full_name, split_full_name
from repochron.session import write_through
from repochron.sources import schemas as S
from repochron.sources.jsonsplit import json_entries

# Suffixes of the landed files per entity (as configured in the
# reference's example configuration).
SUFFIXES = {
    "repo_info": ".repo_info.json",
    "repo_info_extended": ".repo_info_extended.json",
    "commits": ".commits.json",
    "issues": ".issues.json",
    "issue_events": ".issue_events.json",
    "issue_comments": ".issue_comments.json",
    "pull_requests": ".pullrequests.json",
    "commit_comments": ".commit_comments.json",
    "cicd_artifacts": ".cicd_artifacts.json",
    "cicd_workflows": ".cicd_workflows.json",
    "cicd_workflow_runs": ".cicd_workflow_runs.json",
    "releases": ".releases.json",
    "pages": ".pages.json",
}
REJECT = "stage string, owner string, repo string, reason string"
# Provider envelopes: the list sits under this field.
ENVELOPES = {"cicd_artifacts": "artifacts", "cicd_workflows": "workflows",
             "cicd_workflow_runs": "workflow_runs"}


def key_from_path(path: Column, suffix: str) -> tuple[Column, Column]:
    """``.../<owner>/<repo><suffix>`` -> (owner, repo)."""
    esc = suffix.replace(".", "\\.")
    pattern = f"([^/]+)/([^/]+){esc}$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def _glob(root: str, entity: str) -> str:
    return f"{root.rstrip('/')}/*/*{SUFFIXES[entity]}"


def _with_key(df: DataFrame, entity: str) -> DataFrame:
    owner, repo = key_from_path(F.col("_metadata.file_path"), SUFFIXES[entity])
    return df.select(owner.alias("owner"), repo.alias("repo"), "*")


# --- repository lists (S01, S02, S04, S28, S29, S03) ------------------------------
def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of every file, stripped (blank lines kept)."""
    return spark.read.text(paths).select(strip(F.col("value")).alias("value"))


def repo_list_from_files(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """S01 + P03 + P04: ``(valid repos, rejects)``; blanks, names without exactly two
    parts and names starting with the slash are rejected."""
    lines = read_lines(spark, paths).withColumnRenamed("value", "full_name")
    split = split_full_name(lines, "full_name").withColumn(
        "valid", F.col("valid") & is_full_name("full_name"))
    ok = split.filter("valid").select("full_name", "owner", "repo")
    bad = split.filter(~F.col("valid")).select(
        F.lit("list").alias("stage"), "full_name", F.lit("not owner/repo").alias("reason"))
    return ok, bad


def repo_list_inline(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The configured literal list (a handful of names from the configuration)."""
    df = spark.createDataFrame([(n,) for n in names], "full_name string")
    return split_full_name(df, "full_name").filter("valid").select("full_name", "owner", "repo")


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """One name per line."""
    return spark.read.text(path).select(F.col("value").alias("full_name"))


def read_skiplist(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of repositories; their ``full_name``."""
    return (spark.read.schema("full_name string").option("multiLine", True).json(path)
            .select("full_name"))


def search_results(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """S03 + S21: ``(items, rejects)`` of landed result pages (``<search>_<page>.json``).

    ``items[]`` of every page. Rejected are pages that aren't JSON or have no ``items`` (an error in the reference), and
    searches whose pages have a gap or a repeat, or whose items don't add up to the largest ``total_count``."""
    docs = json_entries(spark, paths)
    at = F.col("key") == "items"
    parsed = (docs.entries.where("key in ('items', 'total_count')")
              .select("path", F.when(at, F.from_json("value", T.ArrayType(S.SEARCH_ITEM))).alias("items"),
                      F.when(~at, F.expr("try_cast(value as long)")).alias("total")))
    per = (docs.files.select("path")
           .join(parsed.groupBy("path").agg(F.sum(F.size("items")).alias("n"), F.max("total").alias("total")), "path", "left"))
    numbered = write_through(page_numbers(per), "search-pages")
    bare = numbered.where("n is null").select("listing", "path", F.lit("no items in the page").alias("reason"))
    short = (numbered.groupBy("listing").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
             .where("total is null or n is null or n <> total")
             .select("listing", F.lit(None).cast("string").alias("path"),
                     F.format_string("%s of %s items", F.coalesce("n", F.lit(0)), F.coalesce(F.col("total").cast("string"), F.lit("unknown")))
                     .alias("reason")))
    faults = docs.faults.select(page_listing(F.col("path"))[0].alias("listing"), "path", "reason")
    rejects = (bare.unionByName(short).unionByName(page_gaps(numbered)).unionByName(faults)
               .select(F.lit("search").alias("stage"), "listing", "path", "reason"))
    return parsed.select(F.inline("items")), rejects


# --- JSON documents (S05, S06, S07, S08) --------------------------------------------
def read_json_documents(spark: SparkSession, paths: str | Sequence[str], schema) -> DataFrame:
    """Whole-file JSON with an explicit schema; an array gives one row per
    element, a lone object one row."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def read_whole_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Each file as one string, with its path."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value")


def _checked(parsed: DataFrame, faults: DataFrame, entity: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: files of which an entry doesn't parse (``__reason``) are rejected whole, like faulty ones, so
    no file is both read and rejected. The parse that fills the table is the one that judges."""
    parsed = write_through(parsed, f"land-{name}")
    bad = (faults.select("path", "reason").unionByName(parsed.where("__reason is not null").select("path", F.col("__reason").alias("reason")))
           .groupBy("path").agg(F.min("reason").alias("reason")))
    owner, repo = key_from_path(F.col("path"), SUFFIXES[entity])
    bad = write_through(bad.withColumns({"owner": owner, "repo": repo}), "land-bad")
    rows = (parsed.where("__reason is null and not __none").join(bad.select("path"), "path", "left_anti")
            .withColumns({"__owner": owner, "__repo": repo}))
    rejects = bad.select(F.lit("landing").alias("stage"), "owner", "repo",
                         F.concat(F.lit(f"unreadable {entity} file: "), "reason").alias("reason"))
    return rows, rejects


def _strict(value: Column, schema: T.StructType) -> Column:
    """JSON text -> struct with a field ``__bad`` that is set where the text is no such record."""
    return F.from_json(value, T.StructType([*schema.fields, T.StructField("__bad", T.StringType())]),
                       {"columnNameOfCorruptRecord": "__bad"})


def landed_commits(spark: SparkSession, root: str, commit_schema: T.StructType = S.COMMIT) -> tuple[DataFrame, DataFrame]:
    """``{hash: commit}`` per repository -> one row per commit (keys stay data), and the rejected
    files. Large maps are read by many tasks (``jsonsplit``); no value holds more than one commit."""
    docs = json_entries(spark, _glob(root, "commits"))
    parsed = docs.entries.select("path", F.col("key").alias("hash"), _strict(F.col("value"), commit_schema).alias("c"))
    reason = (F.when(F.col("hash").isNull(), "not a map of commits")
              .when(F.col("c").isNull() | F.col("c.__bad").isNotNull(), "a commit is not a JSON object"))
    rows, rejects = _checked(parsed.select("path", "hash", "c", reason.alias("__reason"), F.lit(False).alias("__none")),
                             docs.faults, "commits", "commits")
    return (rows.select(F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), "hash",
                        *[F.col(f"c.{f.name}").alias(f.name) for f in commit_schema.fields]), rejects)


def read_commits(spark: SparkSession, root: str, commit_schema: T.StructType = S.COMMIT) -> DataFrame:
    """The commits of ``landed_commits``."""
    return landed_commits(spark, root, commit_schema)[0]


def commit_files_of(commits: DataFrame) -> DataFrame:
    """Explode the nested file list to one row per modified file."""
    return commits.select("owner", "repo", "hash", "author", "committer_epoch",
                          F.explode("files").alias("f")).select(
        "owner", "repo", "hash", "author", "committer_epoch", "f.*")


def landed_repo_info(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per repository: typed columns for the used fields, all fields as a map of
    VARIANT values (``tail``); files that don't parse are rejected."""
    raw = _with_key(spark.read.text(_glob(root, "repo_info"), wholetext=True), "repo_info")
    typed = F.from_json(F.col("value"), S.REPO_INFO)
    tail = F.from_json(F.col("value"), "map<string,variant>")
    parsed = raw.select("owner", "repo", typed.alias("t"), tail.alias("tail"))
    return (parsed.where("tail is not null").select("owner", "repo", "t.*", "tail"),
            parsed.where("tail is null").select(F.lit("landing").alias("stage"), "owner", "repo",
                                                F.lit("unreadable repo_info file: not a JSON object").alias("reason")))


def read_repo_info(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``landed_repo_info``."""
    return landed_repo_info(spark, root)[0]


def unreadable_files(spark: SparkSession, root: str, entities: Sequence[str]) -> DataFrame:
    """S05-S18 rejects: landed files without valid content, ``(stage, owner, repo, reason)``, as the readers judge them."""
    return reduce(DataFrame.unionByName, (landed(spark, root, entity)[1] for entity in entities),
                  spark.createDataFrame([], REJECT))


# --- provider entities (S09-S19, S21) -----------------------------------------------
def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    cols = [T.StructField("owner", T.StringType()), T.StructField("repo", T.StringType())]
    return spark.createDataFrame([], T.StructType(cols + list(schema.fields)))


def landed(spark: SparkSession, root: str, entity: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of one entity's landed files; no file at all gives two empty tables ("missing = empty")."""
    read = {"commits": landed_commits, "repo_info": landed_repo_info}.get(entity)
    schema = schema or {"commits": S.COMMIT, "repo_info": S.REPO_INFO}.get(entity) or S.ENTITY_SCHEMAS.get(entity, S.RAW_ITEM)
    try:
        return read(spark, root) if read is not None else landed_entity(spark, root, entity, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return _empty(spark, schema), spark.createDataFrame([], REJECT)


def landed_entity(spark: SparkSession, root: str, entity: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of one entity.

    A list gives a row per element (pull requests: a list of lists, flattened, S12). An object is an envelope, whose list
    lies under the entity's field (S19; without it: no row, rejected), or a lone record (S20; rejected if it has none of the
    schema's fields, like a provider's error message). A file of which an element isn't a record is rejected whole."""
    docs = json_entries(spark, _glob(root, entity))
    many, field = T.ArrayType(schema), ENVELOPES.get(entity)
    value = F.col("value")
    if entity == "pull_requests":
        listed = docs.entries.where("key is null").select("path", F.from_json(value, many).alias("r")).select(
            "path", "r", F.when(F.col("r").isNull(), "an element is not a list of records").alias("__reason"))
    else:
        one = docs.entries.where("key is null").select("path", _strict(value, schema).alias("c"))
        listed = one.select(
            "path", F.array(F.struct(*[F.col(f"c.{f.name}").alias(f.name) for f in schema.fields])).alias("r"),
            F.when(F.col("c").isNull() | F.col("c.__bad").isNotNull(), "an element is not a record").alias("__reason"))
    objects = docs.entries.where("key is not null")
    roots = docs.files.where("root = '{'").select("path")
    if field is not None:
        held = objects.where(F.col("key") == field).select("path", F.from_json(value, many).alias("r"))
        lone = roots.join(held, "path", "left").select(
            "path", "r", F.when(F.col("r").isNull(), F.lit(f"no list under {field}")).alias("__reason"))
    elif entity == "pull_requests":
        lone = roots.select("path", F.lit(None).cast(many).alias("r"), F.lit("not a list of pull requests").alias("__reason"))
    else:
        name = F.expr("substring(to_json(array(key)), 2, length(to_json(array(key))) - 2)")
        body = objects.groupBy("path").agg(
            F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(name, F.lit(":"), value)), ","), F.lit("}")).alias("value"),
            F.max(F.col("key").isin([f.name for f in schema.fields])).alias("known"))
        one = roots.join(body, "path", "left").select("path", _strict(value, schema).alias("c"), "known")
        lone = one.select(
            "path", F.array(F.struct(*[F.col(f"c.{f.name}").alias(f.name) for f in schema.fields])).alias("r"),
            F.when(~F.coalesce("known", F.lit(False)) | F.col("c").isNull() | F.col("c.__bad").isNotNull(),
                   "the object is not a record").alias("__reason"))
    records = listed.unionByName(lone).select(
        "path", "__reason", F.explode_outer("r").alias("r"))
    rows, rejects = _checked(records.withColumn("__none", F.col("r").isNull()), docs.faults, entity, entity)
    return rows.select(F.col("__owner").alias("owner"), F.col("__repo").alias("repo"),
                       *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), rejects


def read_entity(spark: SparkSession, root: str, entity: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of ``landed``."""
    return landed(spark, root, entity, schema)[0]


# --- pages of a listing (S21, O04) ----------------------------------------------------
def page_listing(path: Column) -> tuple[Column, Column]:
    """``<listing>_<page>.json`` -> (listing, page)."""
    return F.regexp_extract(path, r"^(.*?)[_-]?(\d+)\.json$", 1), F.regexp_extract(path, r"(\d+)\.json$", 1).cast("long")


def page_numbers(pages: DataFrame) -> DataFrame:
    listing, page = page_listing(F.col("path"))
    return pages.withColumns({"listing": listing, "page": page})


def page_gaps(pages: DataFrame) -> DataFrame:
    """``(listing, path, reason)``: numbers that the pages of a listing lack, and pages landed twice. Pages are few
    rows; each is compared with the one before it."""
    same = Window.partitionBy("listing").orderBy("page", "path")
    before = F.lag("page", 1, 0).over(same)
    reason = (F.when(F.col("page").isNull(), "no page number")
              .when(F.col("page") == F.col("before"), F.format_string("page %s is there twice", "page"))
              .when(F.col("page") == F.col("before") + 2, F.format_string("page %s is missing", F.col("page") - 1))
              .when(F.col("page") > F.col("before") + 1, F.format_string("pages %s to %s are missing", F.col("before") + 1, F.col("page") - 1)))
    return (pages.withColumn("before", before).select("listing", "path", reason.alias("reason")).where("reason is not null"))


def landed_pages(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = S.RAW_ITEM, page_size: int = 100,
                 by_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of listings landed page by page (``<listing>_<page>.json``, a list each).

    A listing is whole if its pages are numbered from 1 without gap or repeat, all but the last hold ``page_size`` records
    and the last one fewer; ``by_link`` (listings that end where no link leads on) allows a full last page. A listing
    that isn't whole, or of which a page isn't valid, is rejected, one row per finding, and none of its rows is returned.
    Listings are judged all at once by windows over one row per page."""
    docs = json_entries(spark, paths)
    parsed = docs.entries.select("path", "key", _strict(F.col("value"), schema).alias("c"))
    bad = F.col("key").isNotNull() | F.col("c").isNull() | F.col("c.__bad").isNotNull()
    parsed = write_through(parsed.select("path", "c", bad.alias("bad")), "page-rows")
    per = (docs.files.select("path", F.col("root").alias("kind"))
           .join(parsed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad")), "path", "left")
           .withColumn("n", F.coalesce("n", F.lit(0))))
    pages = write_through(page_numbers(per), "pages")
    last = F.col("page") == F.max("page").over(Window.partitionBy("listing"))
    size = (F.when((F.col("kind") != "[") | F.coalesce("bad", F.lit(False)), "not a list of records")
            .when(F.col("n") > page_size, F.format_string("page %s has %s records", "page", "n"))
            .when(~F.col("last") & (F.col("n") < page_size), F.format_string("page %s is short: %s records", "page", "n"))
            .when(F.col("last") & (F.col("n") == page_size) & ~F.lit(by_link), F.format_string("page %s is full, the next one is missing", "page")))
    sizes = pages.withColumn("last", last).select("listing", "path", size.alias("reason")).where("reason is not null")
    faults = docs.faults.select(page_listing(F.col("path"))[0].alias("listing"), "path", "reason")
    rejects = write_through(page_gaps(pages).unionByName(sizes).unionByName(faults), "page-rejects")
    whole = pages.join(rejects.select("listing").distinct(), "listing", "left_anti").select("listing", "page", "path")
    rows = parsed.join(whole, "path").select("listing", "page", *[F.col(f"c.{f.name}").alias(f.name) for f in schema.fields])
    return rows, rejects.select(F.lit("pages").alias("stage"), "listing", "path", "reason")


def require_whole(rejects: DataFrame) -> None:
    """Raise if there is any reject (as the reference does at the first failing call); the message names a few."""
    found = rejects.orderBy("reason").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['listing']}: {r['reason']}" for r in found))


# --- text scans (S22-S24, S27, S30) --------------------------------------------------
def read_repo_text(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Text lines of ``<root>/<repo>/<file>``; every sub-folder is a repository."""
    df = spark.read.text(f"{root.rstrip('/')}/*/*{suffix}")
    repo = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return df.select(repo.alias("repo"), "value")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Exported ``patches(repo, hash, parent, a_path, patch)`` table (Parquet)."""
    return spark.read.parquet(path)
