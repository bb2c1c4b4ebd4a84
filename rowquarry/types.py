"""The column types that a store takes, their codes, and what a field's metadata says about a type.

A column's logical type is its Spark type plus a few keys of ``StructField.metadata``:

``levels``, ``ordered``, ``na_level``  a factor (see ``functions.factors``)
``storage``                            ``int`` or ``double``: how a date or time was held
``logical``                            ``raw``, ``nanotime`` or ``itime`` on a plain number
``tzone``                              a timestamp's zone; absent, empty and named are three states
``units``                              a duration's display unit
``key_pos``                            1-based place of the column in the table's sort key
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and codes as they appear in metadata records.
TYPE_NAMES = [
    "unknown", "character", "factor", "ordered factor", "integer", "POSIXct", "difftime", "IDate", "ITime", "double",
    "Date", "POSIXct", "difftime", "ITime", "logical", "integer64", "nanotime", "raw",
]
UNKNOWN, CHARACTER, FACTOR, ORDERED, INTEGER, POSIXCT_INT, DIFFTIME_INT, IDATE, ITIME_INT = range(1, 10)
DOUBLE, DATE, POSIXCT, DIFFTIME, ITIME, LOGICAL, INTEGER64, NANOTIME, RAW = range(10, 19)
BASE_CODES = {
    CHARACTER: 2, FACTOR: 3, ORDERED: 3, INTEGER: 4, POSIXCT_INT: 4, DIFFTIME_INT: 4, IDATE: 4, ITIME_INT: 4,
    DOUBLE: 5, DATE: 5, POSIXCT: 5, DIFFTIME: 5, ITIME: 5, LOGICAL: 6, INTEGER64: 7, NANOTIME: 7, RAW: 8,
}

#: Columns that a store adds; no table may have a column of these names.
POS = "__pos"
ROW_ID = "__row_id"
RESERVED = (POS, ROW_ID)


def type_code(field: T.StructField) -> int:
    """The logical type's code; ``UNKNOWN`` for what a store does not take."""
    kind, said = field.dataType, field.metadata or {}
    as_int = said.get("storage") == "int"
    if "n_levels" in said:
        return ORDERED if said.get("ordered") else FACTOR
    if isinstance(kind, T.StringType):
        return CHARACTER
    if isinstance(kind, T.BooleanType):
        return LOGICAL
    if isinstance(kind, T.DateType):
        return IDATE if as_int else DATE
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return POSIXCT_INT if as_int else POSIXCT
    if isinstance(kind, T.DayTimeIntervalType):
        return DIFFTIME_INT if as_int else DIFFTIME
    if isinstance(kind, T.BinaryType) or said.get("logical") == "raw":
        return RAW
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return ITIME_INT if said.get("logical") == "itime" else INTEGER
    if isinstance(kind, T.LongType):
        return NANOTIME if said.get("logical") == "nanotime" else INTEGER64
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return ITIME if said.get("logical") == "itime" else DOUBLE
    return UNKNOWN


def type_name(field: T.StructField) -> str:
    return TYPE_NAMES[type_code(field) - 1]


def base_code(field: T.StructField) -> int:
    return BASE_CODES[type_code(field)]


def check_types(fields: Iterable[T.StructField]) -> None:
    """Refuse nested types, decimals and everything else without a code."""
    for f in fields:
        if type_code(f) == UNKNOWN:
            raise TypeError(f"Unknown type found in column '{f.name}': {f.dataType.simpleString()}")


def quoted(name: str) -> str:
    """The name as Spark's parser takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def tagged(df: DataFrame, column: str, **said) -> DataFrame:
    """``df`` with these keys put into (or, where None, taken out of) the column's metadata."""
    meta = {k: v for k, v in {**(df.schema[column].metadata or {}), **said}.items() if v is not None}
    return df.withMetadata(column, meta)


def as_idate(df: DataFrame, column: str) -> DataFrame:
    """A date column that is held as whole days in integers."""
    return tagged(df, column, storage="int")


def as_posixct(df: DataFrame, column: str, tzone: str | None = None, storage: str = "double") -> DataFrame:
    """A timestamp column with its zone (None: no zone, "": the local one); whole seconds if ``storage`` is int."""
    if storage not in ("int", "double"):
        raise ValueError("storage is 'int' or 'double'")
    if storage == "int":
        df = df.withColumn(column, F.date_trunc("second", F.col(quoted(column))).cast(df.schema[column].dataType))
    return tagged(df, column, tzone=tzone, storage=storage)


def as_difftime(df: DataFrame, column: str, units: str = "secs", storage: str = "double") -> DataFrame:
    """A number of ``units`` (secs, mins, hours, days, weeks) as a duration."""
    seconds = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}[units]
    c = F.col(quoted(column))
    if not isinstance(df.schema[column].dataType, T.DayTimeIntervalType):
        # exact for whole numbers; a double keeps what a microsecond can hold
        micros = (c.cast("double") * (seconds * 1_000_000)).cast("long") if storage == "double" else c.cast("long") * (seconds * 1_000_000)
        df = df.withColumn(column, F.timestamp_micros(micros) - F.timestamp_micros(F.lit(0)))
    return tagged(df, column, units=units, storage=storage)


def as_itime(df: DataFrame, column: str) -> DataFrame:
    """Seconds since midnight in an int or double column."""
    return tagged(df, column, logical="itime")


def as_nanotime(df: DataFrame, column: str) -> DataFrame:
    """Nanoseconds since the epoch in a bigint column."""
    if not isinstance(df.schema[column].dataType, T.LongType):
        raise TypeError("nanoseconds since the epoch need a bigint column")
    return tagged(df, column, logical="nanotime")


def as_raw(df: DataFrame, column: str) -> DataFrame:
    """Bytes 0 to 255 in a smallint column; other values and nulls raise when the column is read."""
    c = F.col(quoted(column))
    byte = F.when(c.between(0, 255), c.cast("short")).otherwise(F.raise_error(F.lit("a raw value is a byte from 0 to 255")))
    return tagged(df.withColumn(column, byte.cast("short")), column, logical="raw")
