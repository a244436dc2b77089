"""Session helpers: UTC everywhere, AQE on, no UI, checkpoint dir from the cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every job of this library relies on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Target ~128 MB per shuffle partition after AQE coalescing and skew splitting,
    # and ~256 MB per file split: sizes that fit executor memory at any input size.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "repochron",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them unset and let the submit configuration decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # getOrCreate may hand back an existing session: pin the SQL settings anyway.
    for key, value in conf.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only a local master may leave
    it unset (tests, single machine): then a fresh scratch folder is set. On a cluster an
    unset folder is an error, since executors could not read each other's files."""
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a SparkContext (e.g. Spark Connect)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    else:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="repochron-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers where they wouldn't find it by themselves: it lies neither in the working
    folder nor on ``PYTHONPATH`` (with ``--py-files`` it is a zip already). Once per context."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    sc = spark.sparkContext
    if not os.path.isdir(root) or os.path.realpath(root) in known or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="repochron-ship-")         # Spark itself hands the file to the executors
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "repochron"), "zip", root, "repochron"))


_SHIPPED: set[str] = set()

#: Folders written by this process, for ``drop_written``.
_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote, once no result that reads them is
    needed any more; returns their number. Goes through Spark's file systems, so it works
    wherever the shared folder lies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def write_through(df: DataFrame, name: str = "stage", row_group: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it
    back: one evaluation for any number of consumers, lineage cut, and the files
    outlive lost executors. ``drop_written`` removes them when the results are out.
    ``row_group``: bytes of a row group, for rows so large that a batch of them is heavy; such files
    are not compressed, since Parquet would measure a row group by its compressed bytes."""
    return write_through_counted(df, name, row_group)[0]


def write_through_counted(df: DataFrame, name: str = "stage", row_group: int | None = None) -> tuple[DataFrame, int]:
    """``write_through`` that also returns the row count, observed while writing
    (no second job)."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/repochron-{name}-{uuid.uuid4().hex}"
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    out = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    out = out.option("compression", "none").option("parquet.block.size", row_group) if row_group else out.option("compression", "zstd")
    out.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path), int(obs.get["n"])
