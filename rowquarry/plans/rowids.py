"""Row identity: how row numbers are given in one pass and found again by pruning.

A row is written with its task's number and its place within the task in one bigint, ``__pos``.
The values grow in row order, so no second pass over the data and no shuffle is needed to number
rows: only the rows per task (a few bytes per task, ``Spans``) are kept. A row number turns into a
``__pos`` on the driver, and a range of row numbers into a *range of* ``__pos``, which reaches the
Parquet scan as a pushed filter on row-group and page statistics.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import POS, ROW_ID

#: Bits of ``__pos`` below the task's number, as ``monotonically_increasing_id`` has them.
TASK_BITS = 33
#: Tasks whose first row numbers are put into an expression; more of them are joined from a table.
LITERAL_TASKS = 512

SPANS_SCHEMA = "task int, rows long"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``__pos`` in its present row order; evaluated once, by the write that follows."""
    return df.withColumn(POS, F.monotonically_increasing_id())


def spans_of(stored: DataFrame) -> DataFrame:
    """(task, rows): counted from the stored ``__pos`` alone, with partial sums."""
    task = F.shiftright(F.col(POS), TASK_BITS).cast("int").alias("task")
    return stored.select(task).groupBy("task").agg(F.count("*").alias("rows"))


class Spans:
    """Rows per writing task, in order; row numbers start at 1."""

    def __init__(self, tasks: Iterable[tuple[int, int]]):
        held = sorted(t for t in tasks if t[1])
        self.tasks = [t for t, _ in held]
        self.sizes = [n for _, n in held]
        self.first = [0, *accumulate(self.sizes)]

    @property
    def rows(self) -> int:
        return self.first[-1]

    def pos(self, row: int) -> int:
        """The stored value of a row number from 1 to ``rows``."""
        k = bisect_right(self.first, row - 1) - 1
        return (self.tasks[k] << TASK_BITS) + row - 1 - self.first[k]

    def between(self, lo: int, hi: int) -> Column:
        """A pushed-down filter for the rows ``lo`` to ``hi``."""
        if lo > hi:
            return F.lit(False)
        return F.col(POS).between(self.pos(lo), self.pos(hi))

    def isin(self, rows: Iterable[int]) -> Column:
        return F.col(POS).isin([self.pos(r) for r in rows])

    def _bases(self) -> Iterator[tuple[int, int]]:
        """What to take off ``__pos`` to get the row number, per task."""
        for t, first in zip(self.tasks, self.first, strict=False):
            yield t, (t << TASK_BITS) - first - 1

    def with_row_id(self, spark: SparkSession, df: DataFrame, name: str = ROW_ID) -> DataFrame:
        """``df`` (with ``__pos``) and the row numbers of its rows."""
        pos = F.col(POS)
        if len(self.tasks) <= LITERAL_TASKS and (not self.tasks or self.tasks[-1] < 4 * LITERAL_TASKS):
            base = dict(self._bases())
            array = F.array(*[F.lit(base.get(t, 0)).cast("long") for t in range((self.tasks[-1] if self.tasks else 0) + 1)])
            return df.withColumn(name, pos - F.get(array, F.shiftright(pos, TASK_BITS).cast("int")))
        # as many rows as the table had writing tasks; broadcast below the session's size threshold
        table = spark.createDataFrame(list(self._bases()), "__task int, __base long")
        joined = df.join(table, F.shiftright(pos, TASK_BITS).cast("int") == F.col("__task"))
        return joined.withColumn(name, pos - F.col("__base")).drop("__task", "__base")
