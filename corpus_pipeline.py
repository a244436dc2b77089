"""Training-data pipeline over ``documents``: five stages, each written before the next.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, personal data become pseudonyms, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.llm.common import cut, table
from repochron.llm.decontam import without_leaks
from repochron.llm.packing import pack_documents
from repochron.llm.pii import DEMO_KEY, pseudonyms
from repochron.llm.simhash import one_of_each
from repochron.llm.toxicity import without_toxic


BATCH_ROWS = 1000    # documents that a Python worker is given at once


def _bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows: workers of several stages live side by side on an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    _bounded(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    _bounded(spark)
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _bounded(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; ``n_chars`` follows the text."""
    _bounded(spark)
    own = [c for c in docs.columns if c == "pii"]       # a column of the documents, not the operator's counts
    done = pseudonyms(docs.withColumnsRenamed({c: "__own_pii" for c in own}), DEMO_KEY).drop("pii")
    done = done.withColumnsRenamed({"__own_pii": c for c in own})
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return done


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 1024."""
    _bounded(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best-fit packing", packing_stage),
]

#: Training, latent search and tokenisation are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "pipeline")
    return docs
