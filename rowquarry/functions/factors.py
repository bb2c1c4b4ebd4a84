"""Factors: a column of values with an ordered list of levels that outlives any subset of rows.

The values stay strings (Parquet's dictionaries give the small codes); the levels are field
metadata. Where a missing value is itself a level, strings cannot tell it from a missing code, so
the column holds 1-based integer codes instead and its null level is the last one.

Metadata: ``n_levels`` always; ``levels`` (without the null level) up to ``INLINE_LEVELS`` of them,
beyond that ``levels_path`` names a Parquet table (code int, level string); ``ordered``;
``na_level`` for the coded form.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..types import quoted

#: Levels that field metadata holds; longer lists go to a table beside the rows.
INLINE_LEVELS = 10_000
LEVELS_SCHEMA = "code int, level string"


def factor(
    df: DataFrame, column: str, levels: Sequence[str] | DataFrame | None = None, ordered: bool = False, na_level: bool = False
) -> DataFrame:
    """``df`` with the column as a factor; values that are no level become null.

    ``levels`` is a list, or for very many a DataFrame (code, level) with codes from 1 on; without
    it the sorted distinct values are the levels. They are a property of the column, so this is the
    one place where distinct values are brought to the driver; beyond ``INLINE_LEVELS`` they stay
    in a table.
    """
    c = F.col(quoted(column)).cast("string")
    if levels is None:
        levels = _sorted_levels(df.select(c.alias("level")))
    if isinstance(levels, DataFrame):
        return _with_table(df, column, c, levels, ordered, na_level)
    levels = list(levels)
    if len(set(levels)) < len(levels) or None in levels:
        raise ValueError("levels are distinct and not null")
    if len(levels) > INLINE_LEVELS:
        table = df.sparkSession.createDataFrame(list(enumerate(levels, 1)), LEVELS_SCHEMA)
        return _with_table(df, column, c, table, ordered, na_level)
    said = {"n_levels": len(levels) + na_level, "levels": levels, "ordered": ordered}
    code = code_of(c, levels)
    if na_level:
        value = F.when(c.isNull(), F.lit(len(levels) + 1)).otherwise(code)
        said["na_level"] = True
    else:
        value = F.when(code.isNotNull(), c)
    return df.withColumn(column, value).withMetadata(column, said)


def _sorted_levels(values: DataFrame) -> list[str] | DataFrame:
    distinct = values.where("level is not null").distinct()
    first = [r[0] for r in distinct.limit(INLINE_LEVELS + 1).collect()]
    if len(first) <= INLINE_LEVELS:
        return sorted(first, key=lambda s: s.encode())
    # too many for the driver: sorted by range and numbered by task
    spark = values.sparkSession
    path = scratch_path(spark, "levels")
    distinct.orderBy("level").withColumn("__pos", F.monotonically_increasing_id()).write.parquet(path)
    from ..plans.rowids import Spans, spans_of

    held = spark.read.parquet(path)
    spans = Spans(tuple(r) for r in spans_of(held).collect())
    return spans.with_row_id(spark, held, "code").select(F.col("code").cast("int"), "level")


def _with_table(df: DataFrame, column: str, c: Column, levels: DataFrame, ordered: bool, na_level: bool) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "levels")
    levels.select(F.col("code").cast("int").alias("code"), F.col("level").cast("string").alias("level")).write.parquet(path)
    table = spark.read.schema(LEVELS_SCHEMA).parquet(path)
    n = table.count()
    known = table.select(F.col("level").alias("__level"), F.col("code").alias("__code"))
    names = df.columns
    joined = df.join(known, c == F.col("__level"), "left")
    if na_level:
        value = F.when(c.isNull(), F.lit(n + 1)).otherwise(F.col("__code"))
    else:
        value = F.col("__level")
    said = {"n_levels": n + na_level, "levels_path": path, "ordered": ordered} | ({"na_level": True} if na_level else {})
    return joined.select(*[value.alias(x) if x == column else F.col(quoted(x)) for x in names]).withMetadata(column, said)


def levels(df: DataFrame, column: str) -> list[str | None]:
    """The levels in order, the null level (if it has one) last; only for inline levels."""
    said = df.schema[column].metadata or {}
    if "levels" not in said:
        raise ValueError(f"'{column}' is not a factor with inline levels; see levels_table")
    return [*said["levels"], *[None] * bool(said.get("na_level"))]


def levels_table(spark: SparkSession, field: T.StructField, root: str = "") -> DataFrame:
    """(code, level) of a factor's field; ``root`` is the folder that relative paths start from."""
    said = field.metadata or {}
    if "levels_path" in said:
        path = said["levels_path"]
        return spark.read.schema(LEVELS_SCHEMA).parquet(path if ":" in path or path.startswith("/") else f"{root}/{path}")
    return spark.createDataFrame(list(enumerate(said["levels"], 1)), LEVELS_SCHEMA)


#: Levels that a row is compared with one by one; more are looked up by a hash.
FEW_LEVELS = 100


def code_of(value: Column, levels: Sequence[str]) -> Column:
    """1-based place among the levels; null for other values."""
    if not levels:
        return F.lit(None).cast("int")
    if len(levels) <= FEW_LEVELS:
        found = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
        return F.when(found > 0, found.cast("int"))
    size = -(-len(levels) // 8)  # about eight levels for each value of the hash
    names: list[list[str]] = [[] for _ in range(size)]
    codes: list[list[int]] = [[] for _ in range(size)]
    for code, level in enumerate(levels, 1):
        place = zlib.crc32(level.encode()) % size
        names[place].append(level), codes[place].append(code)
    place = (F.crc32(value.cast("binary")) % size).cast("int")

    def table(rows: list[list], kind: str) -> Column:
        return F.array(*[F.array(*map(F.lit, r)).cast(f"array<{kind}>") for r in rows])

    found = F.array_position(F.get(table(names, "string"), place), value)
    return F.when(found > 0, F.get(F.get(table(codes, "int"), place), found.cast("int") - 1))


def factor_code(df: DataFrame, column: str) -> Column:
    """The codes of an inline factor column, whichever way it is held; ordered factors sort by it."""
    said = df.schema[column].metadata or {}
    if said.get("na_level"):
        return F.col(quoted(column))
    return code_of(F.col(quoted(column)), said["levels"])


def factor_value(df: DataFrame, column: str) -> Column:
    """The values of an inline factor column as strings."""
    said = df.schema[column].metadata or {}
    if not said.get("na_level"):
        return F.col(quoted(column))
    return F.get(F.array(*[F.lit(x) for x in said["levels"]]).cast("array<string>"), F.col(quoted(column)) - 1)
