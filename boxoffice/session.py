"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings meant for a large cluster; spark.checkpoint.dir must be set there as well.
CLUSTER_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Start with many shuffle partitions and let adaptive execution merge small and split hot ones.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256MB",
    # Toggle and check-in streams keep a row per key; that state belongs on disk.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def cluster_session(app: str = "boxoffice") -> SparkSession:
    """A session with ``CLUSTER_SETTINGS``; master, memory and spark.checkpoint.dir come from the submission."""
    return SparkSession.builder.appName(app).config(map=CLUSTER_SETTINGS).getOrCreate()


def local_session(cpus: int | str = "*", app: str = "boxoffice") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, read from the session.

    Only a local master may fall back to a fresh temporary folder: executors on other
    machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="boxoffice-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, purpose: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it back.

    Cuts lineage reliably, survives the loss of executors, and gives the planner real sizes.
    """
    spark = frame.sparkSession
    path = new_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: Spark deletes them at a query's end, not when the driver collects its garbage.

    For frames that are materialized, and whose own plan is not run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
