"""A small analytic workload on stored tables: grouped medians, relabelling, sorting, sampled columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .types import quoted


def group_median(df: DataFrame, by: Sequence[str], medians: Mapping[str, str], count: str = "n") -> DataFrame:
    """Exact medians (``medians``: result name to column) and the number of rows for each group.

    Values are counted per group first, so that what is shuffled and held for a group are its
    distinct values with their frequencies, not its rows.
    """
    keys = [F.col(quoted(b)) for b in by]
    out = df.groupBy(*keys).agg(F.count("*").alias(count))
    for name, column in medians.items():
        counted = df.groupBy(*keys, F.col(quoted(column)).alias("__v")).agg(F.count("*").alias("__n"))
        part = counted.groupBy(*keys).agg(F.expr("percentile(__v, 0.5, __n)").alias(name))
        part = part.select(*[F.col(quoted(b)).alias(f"__{b}") for b in by], name)
        same = [F.col(quoted(b)).eqNullSafe(F.col(quoted(f"__{b}"))) for b in by]
        out = out.join(part, reduce(Column.__and__, same)).drop(*[f"__{b}" for b in by])
    return out


def relabelled(df: DataFrame, column: str, labels: Mapping[str, str], other: str | None = None) -> DataFrame:
    """The column's values replaced by labels; other values become ``other``, or stay if that is None."""
    c = F.col(quoted(column))
    pairs = list(labels.items())
    out = reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), pairs[1:], F.when(c == pairs[0][0], F.lit(pairs[0][1])))
    return df.withColumn(column, out.otherwise(c if other is None else F.lit(other)))


def sampled_table(spark: SparkSession, rows: int, seed: int = 1) -> DataFrame:
    """A logical (85 % true, 10 % false, 5 % missing), an integer (1 to 100), a double (20 values) and a text column."""
    cities = F.array(*[F.lit(x) for x in ("Akron", "Boise", "Dallas", "Fresno", "Mesa", "Omaha", "Reno", "Tulsa")])
    u = F.col("u")  # drawn once for both of its uses
    return spark.range(rows).select(F.rand(seed).alias("u")).select(
        F.when(u < 0.85, True).when(u < 0.95, False).alias("Logical"),
        (F.floor(F.rand(seed + 1) * 100) + 1).cast("int").alias("Integer"),
        (F.floor(F.rand(seed + 2) * 20) * 0.5 + 0.01).alias("Real"),
        F.get(cities, F.floor(F.rand(seed + 3) * 8).cast("int")).alias("Factor"),
    )
