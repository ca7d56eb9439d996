"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from presswell.sources.commits import Files

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own. ``shared`` is its folder for written stages."""
    builder = SparkSession.builder.master(master).appName("presswell").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_scratch: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is a local one does it fall back
    to a folder of this machine, which is removed when the process ends.
    """
    global _local_scratch
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None or not os.path.isdir(_local_scratch):
        _local_scratch = tempfile.mkdtemp(prefix="presswell-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return f"file://{_local_scratch}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one stage's table below the shared folder."""
    return f"{shared_folder(spark)}/presswell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The written table outlives lost executors and is columnar, so later stages
    prune its columns; it is also what a retry of a later stage reads again.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and whose followers are written by now; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            Files(table.sparkSession, path).delete("")
