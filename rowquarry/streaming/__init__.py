"""Storing a stream: every micro-batch becomes a table of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.table import TableRef
from ..session import hadoop_path
from ..sources.store import write_table

PREFIX = "batch-"


def store_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **how) -> StreamingQuery:
    """Start storing ``stream`` under ``path``; ``how`` goes to ``write_table``.

    A batch that runs again after a failure replaces its own table, so that every row is stored once.
    """

    def put(batch: DataFrame, number: int) -> None:
        write_table(batch, f"{path}/{PREFIX}{number:012d}", **how)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stored_batches(spark: SparkSession, path: str) -> list[TableRef]:
    """References to the tables of all whole batches, in order."""
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    return [TableRef(spark, f"{path}/{n}") for n in names if n.startswith(PREFIX) and ".staged-" not in n]
