"""Helpers shared by the training-data operators: shared scratch tables and bounded merges."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python code at once; keeps a worker's memory flat whatever Spark's batch size is.
SLICE_ROWS = 256
#: Bytes of a batch that Spark sends to Python code: very long texts do not pile up in a worker.
BATCH_BYTES = 8 << 20
#: Summaries that one merging task receives.
FAN_IN = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests on one machine), a temporary folder is made and set.
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
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/rowquarry-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath.getParent())
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """An input table; batches of its rows for Python code stay within ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column as UTF-8 bytes without decoding, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> list[bytes]:
    """Merge one bounded summary per input task down to a few and bring those to the driver.

    ``parts`` has columns (part int, payload binary), one row per task. Two rounds of ``FAN_IN``
    summaries each run on the executors, so that the driver receives one payload per 4096 tasks.
    """

    def join_up(pdf):
        payloads = [bytes(p) for p in pdf["payload"]]
        pdf = pdf.head(1).copy()
        pdf["payload"] = [merge(payloads)]
        return pdf[["part", "payload"]]

    for _ in range(2):
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        parts = parts.groupBy("part").applyInPandas(join_up, "part int, payload binary")
    return [bytes(r.payload) for r in parts.toLocalIterator()]


def one_thread() -> None:
    """Keep native libraries of a worker on the one core that its task owns."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def fold(column: str = "doc_id", buckets: int = 5):
    """crc32 of the id as text, modulo ``buckets``: 0 marks the held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets
