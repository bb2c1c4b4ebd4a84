"""The parallelism setting, and scratch paths that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_PARTITIONS = "spark.sql.shuffle.partitions"
#: A session's parallelism, read once: when its first table is written or opened, or it is first asked for.
OPTION = "spark.rowquarry.threads"
_STARTED = "spark.rowquarry.started"


def started(spark: SparkSession) -> None:
    """Apply the session's ``OPTION``; later changes of it have no effect."""
    if spark.conf.get(_STARTED, None) is None:
        spark.conf.set(_STARTED, "true")
        if asked := spark.conf.get(OPTION, None):
            if not asked.isdecimal():
                raise ValueError(f"{OPTION} is a whole number of at least 0")
            threads(spark, int(asked))


def threads(spark: SparkSession, nr_of_threads: int | None = None, reset_after_fork: bool | None = None) -> int:
    """Get or set the session's parallelism (shuffle partitions); returns the value before the call.

    0 stands for all cores of the cluster. There are no forks to guard against: the second
    parameter is checked and has no effect.
    """
    if reset_after_fork is not None and not isinstance(reset_after_fork, bool):
        raise TypeError("Parameter reset_after_fork should be set to TRUE or FALSE")
    started(spark)
    before = int(spark.conf.get(_PARTITIONS))
    if nr_of_threads is not None:
        if isinstance(nr_of_threads, bool) or not isinstance(nr_of_threads, int) or nr_of_threads < 0:
            raise ValueError("The number of threads is a whole number of at least 0")
        spark.conf.set(_PARTITIONS, nr_of_threads or spark.sparkContext.defaultParallelism)
    return before


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) on the JVM's side, for any store that Spark can read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, deleted when the driver ends.

    Where a local session has no such folder (one machine), a temporary one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowquarry-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/rowquarry-{uuid.uuid4().hex}/{name}"
    fs, at = hadoop_path(spark, path)
    fs.deleteOnExit(at.getParent())
    return path
