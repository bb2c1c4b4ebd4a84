"""Plans for taking rows by number: in any order, with repeats.

contiguous     a pushed range on ``__pos``; no join
few numbers    a pushed ``IN`` list, then a join with the list for order and repeats
many numbers   a pushed range from the least to the greatest, then the join
a DataFrame    the join on ``__row_id``, both sides dealt out by Spark
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import POS, ROW_ID, quoted

if TYPE_CHECKING:
    from ..sources.store import Store

#: A row's 1-based place in the selection.
AT = "__at"
#: Distinct rows that go into an ``IN`` list.
FEW = 1_000
#: Selected rows (16 bytes each) that are broadcast; longer lists are joined by shuffle.
BROADCAST_ROWS = 500_000


def gather(store: Store, numbers: Sequence[int], names: Sequence[str]) -> DataFrame:
    """``__at`` and the columns of these rows; the numbers are within the table."""
    # imported here: operators.meta and this module serve both the store and the table reference
    from ..operators.meta import with_key

    spans, spark = store.spans, store.spark
    columns = [F.col(quoted(n)) for n in names]
    n = len(numbers)
    if not n:
        found = store.rows.where(F.lit(False)).select(F.lit(None).cast("long").alias(AT), *columns)
    elif _contiguous(numbers):
        rows = spans.with_row_id(spark, store.rows.where(spans.between(numbers[0], numbers[-1])))
        found = rows.select((F.col(ROW_ID) - (numbers[0] - 1)).alias(AT), *columns)
    else:
        distinct = set(numbers)
        near = spans.isin(sorted(distinct)) if len(distinct) <= FEW else spans.between(min(distinct), max(distinct))
        wanted = spark.createDataFrame([(at, spans.pos(r)) for at, r in enumerate(numbers, 1)], f"{AT} long, __want long")
        if n <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        found = store.rows.where(near).join(wanted, F.col(POS) == F.col("__want")).select(AT, *columns)
    return with_key(found, [])


def _contiguous(numbers: Sequence[int]) -> bool:
    if isinstance(numbers, range):
        return True
    return numbers[-1] - numbers[0] == len(numbers) - 1 and all(
        b - a == 1 for a, b in zip(numbers, numbers[1:], strict=False)
    )


def gather_listed(store: Store, index: DataFrame, row_col: str, names: Sequence[str]) -> DataFrame:
    """The rows that ``index`` lists, beside its own columns; a hot row number is spread by AQE's skew join."""
    n = store.meta.rows
    c = F.col(quoted(row_col)).cast("long")
    inside = F.when(c.between(1, n), c).otherwise(F.raise_error(F.lit("Row selection out of range")).cast("long"))
    if clash := sorted(set(index.columns) & set(names)):
        raise ValueError(f"The index has columns of the table: {', '.join(clash)}")
    asked = index.withColumn("__want", inside)
    rows = store.spans.with_row_id(store.spark, store.rows)
    found = asked.join(rows, F.col("__want") == F.col(ROW_ID))
    return found.select(*[F.col(quoted(x)) for x in index.columns], *[F.col(quoted(x)) for x in names])
