"""Session settings the operators expect."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # spatial residuals and folds cost far more per byte than plain joins
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # a file's size says little of the rows in it: repeated values shrink a hundredfold, and a broadcast holds them all on the driver;
    # sides are broadcast by measured size, or if their files are tiny
    "spark.sql.sources.fileCompressionFactor": "40",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2m",
    # the JVM compiles no method beyond 8000 bytes: a longer generated one would be interpreted for every pair of boxes, several times slower
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # folders of many small files are listed by so many tasks, not by one for each folder
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # malformed dates and numbers are data here, never a reason to stop a job
    "spark.sql.ansi.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOLIOFRAME_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode, where all share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="folioframe-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is planned and run inside loses its shuffle files as soon as its run has ended, not when the driver next collects garbage.

    For runs whose plans nobody asks again: a step that was written is read from its table.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_STEPS: dict[str, list[str]] = {}


def cut_lineage(df, compression: str = "snappy", plain: bool = False):
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Survives the loss of executors like a checkpoint, and unlike one it comes back with known sizes, so
    that later joins are planned on facts. Its shuffle files go when it is written; ``clear_steps`` deletes these tables once results are written.
    ``plain``: files as large as their rows are in memory, for rows with long lists of repeated values.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/step-{uuid.uuid4().hex}"
    options = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {"compression": compression}
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    _STEPS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> int:
    """Delete the tables that ``cut_lineage`` has written in this application; results that still read them must be written before."""
    paths = _STEPS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
