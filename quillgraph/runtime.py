"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def expose_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies on the same path (local runs, tests).

    On a cluster the package is installed or sent with ``--py-files``; a missing path is ignored there.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep) if env.get("PYTHONPATH") else []
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/quillgraph-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    Unlike a cache the files survive the loss of any executor, and unlike a deep lineage nothing is
    computed twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_removed(spark):
        df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores (small tables lie in one file of one row group), dealt out to all of them.

    A large scan stays as it is. For plain scans only: other plans would run their shuffles to be counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Spark then deletes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this block, queries delete their shuffle files as they end; for frames that are run once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def remove_scratch(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for frames that nothing reads any more; other frames' files stay."""
    own = f"{shared_dir(spark)}/quillgraph/"
    for path in {file.rsplit("/", 1)[0] for df in frames if df is not None for file in df.inputFiles()}:
        if path.split(":", 1)[-1].lstrip("/").startswith(own.split(":", 1)[-1].lstrip("/")):
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of our own, through Hadoop's file system API so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether the path is one file and not a folder of them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
