"""Stored tables: write, open and read.

A table is a folder with ``rows`` (Parquet, with ``__pos``), ``spans`` (rows per writing task) and
``levels`` (tables of the factors that have very many levels). Names, types, levels, zones and the
sort key are field metadata in the Parquet schema. Nothing is ever read beyond footers and
``spans`` to open one.
"""

from __future__ import annotations

import numbers
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.factors import LEVELS_SCHEMA
from ..operators.meta import Metadata, key_of, truncated_key, with_key
from ..plans.rowids import SPANS_SCHEMA, Spans, numbered, spans_of
from ..session import hadoop_path, started
from ..types import POS, RESERVED, ROW_ID, check_types, quoted, type_code
from ..types import FACTOR, ORDERED

#: Rows of a Parquet page: what a scan reads at least around a wanted row.
PAGE_ROWS = 4096
#: Compression levels up to this use LZ4, higher ones ZSTD.
LZ4_UP_TO = 50
#: ZSTD's level for 100: 19 took fifty times the time of 12 for 3 % less.
_ZSTD_TOP = 12


def codec_options(compress: float) -> dict[str, str]:
    """Parquet writer options for a level from 0 to 100."""
    if isinstance(compress, bool) or not isinstance(compress, numbers.Real) or not 0 <= compress <= 100:
        raise ValueError("Parameter compress should be a value between 0 and 100.")
    level = int(compress)
    if level == 0:
        return {"compression": "uncompressed"}
    if level <= LZ4_UP_TO:
        return {"compression": "lz4_raw"}
    zstd = 1 + (level - LZ4_UP_TO - 1) * (_ZSTD_TOP - 1) // (100 - LZ4_UP_TO - 1)
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(zstd)}


def _checked_path(path: str) -> str:
    if not isinstance(path, str) or not path:
        raise TypeError("Please specify a correct path.")
    path = path.rstrip("/") or path
    return path if ":" in path else os.path.abspath(os.path.expanduser(path))


def _refuse_old_format(old_format: bool) -> None:
    if old_format is not False:
        raise ValueError("Parameter old_format is deprecated; tables of that format can't be read.")


def write_table(
    df: DataFrame,
    path: str,
    compress: float = 50,
    uniform_encoding: bool = True,
    key: Sequence[str] | None = None,
    sort_by: Sequence[str] | None = None,
) -> DataFrame:
    """Store ``df`` in its row order at ``path``, over whatever table is there; returns ``df``.

    ``sort_by`` sorts by these columns (nulls first) and records them as the key. ``key`` records
    an order that the rows have already. Without either, a key in the fields' metadata is kept.
    Text is always stored as UTF-8: ``uniform_encoding`` takes part where bytes become text
    (``functions.encoding.text_column``).

    One pass: rows are written once, numbered as they are written; then the narrow ``__pos`` column
    alone is read to count rows per task. The new table is written beside the old one and takes its
    place when it is whole, so that a table can be written from what was read from it.
    """
    path = _checked_path(path)
    if not isinstance(df, DataFrame):
        raise TypeError("Please make sure 'x' is a data frame.")
    if not isinstance(uniform_encoding, bool):
        raise TypeError("Parameter uniform_encoding should be TRUE or FALSE.")
    options = codec_options(compress)
    _check_columns(df.schema)
    kept = [] if key is None and sort_by is None else [*(sort_by if sort_by is not None else key)]
    if missing := [k for k in kept if k not in df.columns]:
        raise ValueError(f"Undefined columns: {', '.join(missing)}")
    out = with_key(df, kept) if key is not None or sort_by is not None else df
    if sort_by:
        codes = [_sort_key(out, k) for k in sort_by]
        out = out.orderBy(*codes)
    spark = df.sparkSession
    started(spark)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    fs, at = hadoop_path(spark, path)
    _, beside = hadoop_path(spark, staged)
    try:
        out = _with_own_levels(spark, out, staged)
        (
            numbered(out)
            .write.options(**options)
            .option("parquet.page.row.count.limit", str(PAGE_ROWS))
            # pages of version 1: the vectorized reader of this Spark garbles uncompressed pages of version 2
            .option("parquet.writer.version", "PARQUET_1_0")
            .option(f"parquet.enable.dictionary#{POS}", "false")
            .parquet(f"{staged}/rows")
        )
        stored = spark.read.schema(f"{POS} long").parquet(f"{staged}/rows")
        spans_of(stored).coalesce(1).write.parquet(f"{staged}/spans")
    except BaseException:
        fs.delete(beside, True)
        raise
    _replace(spark, path, staged)
    return df


def _replace(spark: SparkSession, path: str, staged: str) -> None:
    """Put the whole staged table in the place of the old one.

    At every moment one of the two is there whole. If the staged one can't take the place, the old
    one goes back and the error names what happened; neither is deleted before the new one stands.
    """
    old = f"{staged}.old"
    fs, at = hadoop_path(spark, path)
    beside, aside = hadoop_path(spark, staged)[1], hadoop_path(spark, old)[1]
    had = fs.exists(at)
    if had and not _renamed(fs, at, aside):
        fs.delete(beside, True)
        raise OSError(f"Error opening table for writing: {path}")
    if not _renamed(fs, beside, at):
        if had and not _renamed(fs, aside, at):
            raise OSError(f"Error opening table for writing: {path}; the table before is {old}, the new one {staged}")
        fs.delete(beside, True)
        raise OSError(f"Error opening table for writing: {path}")
    if had:
        fs.delete(aside, True)


def _renamed(fs, source, target) -> bool:
    try:
        return bool(fs.rename(source, target))
    except Py4JJavaError:
        return False


def _check_columns(schema: T.StructType) -> None:
    names = [f.name for f in schema.fields]
    if clash := sorted(set(RESERVED) & {n.lower() for n in names}):
        raise ValueError(f"Reserved column names: {', '.join(clash)}")
    if len(set(names)) < len(names):
        raise ValueError("Column names are repeated: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    check_types(schema.fields)


def _sort_key(df: DataFrame, name: str):
    from ..functions.factors import factor_code

    said = df.schema[name].metadata or {}
    if type_code(df.schema[name]) in (FACTOR, ORDERED) and "levels" in said:
        return factor_code(df, name).asc_nulls_first()
    return F.col(quoted(name)).asc_nulls_first()


def _with_own_levels(spark: SparkSession, df: DataFrame, staged: str) -> DataFrame:
    """Copies large level lists into the table, so that it holds all that it needs."""
    for i, f in enumerate(df.schema.fields):
        said = dict(f.metadata or {})
        if "levels_path" in said:
            source = said["levels_path"]
            spark.read.schema(LEVELS_SCHEMA).parquet(source).write.parquet(f"{staged}/levels/{i}")
            df = df.withMetadata(f.name, said | {"levels_path": f"levels/{i}"})
    return df


@dataclass(frozen=True)
class Store:
    """An opened table: a snapshot of its metadata and the plan that scans its rows."""

    path: str
    meta: Metadata
    spans: Spans
    rows: DataFrame  # with __pos

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession


def open_store(spark: SparkSession, path: str, old_format: bool = False) -> Store:
    _refuse_old_format(old_format)
    path = _checked_path(path)
    started(spark)
    fs, at = hadoop_path(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"Error opening table for reading: {path}")
    not_ours = ValueError(f"File header information does not contain the table format marker: {path}")
    if not (fs.exists(hadoop_path(spark, f"{path}/rows")[1]) and fs.exists(hadoop_path(spark, f"{path}/spans")[1])):
        raise not_ours
    try:
        rows = spark.read.parquet(f"{path}/rows")
        spans = Spans(tuple(r) for r in spark.read.schema(SPANS_SCHEMA).parquet(f"{path}/spans").collect())
    except AnalysisException as e:
        raise not_ours from e
    if POS not in rows.columns:
        raise not_ours
    fields = [f for f in rows.schema.fields if f.name != POS]
    for f in fields:
        held = (f.metadata or {}).get("levels_path")
        if held and ":" not in held and not held.startswith("/"):
            rows = rows.withMetadata(f.name, dict(f.metadata) | {"levels_path": f"{path}/{held}"})
    fields = tuple(f for f in rows.schema.fields if f.name != POS)
    return Store(path, Metadata(path, spans.rows, fields), spans, rows)


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    from_: float = 1,
    to: float | None = None,
    keyed: bool = False,
    old_format: bool = False,
    row_ids: bool = False,
) -> DataFrame:
    """The rows ``from_`` to ``to`` (1-based, both included; None: the last) of these columns, lazily.

    Columns come in the order asked for. ``keyed`` keeps the sort key in the fields' metadata, as
    far as the columns still hold it. ``row_ids`` adds ``__row_id``; sort by it where order counts.
    """
    return scan(open_store(spark, path, old_format), columns, from_, to, keyed, row_ids)


def scan(
    store: Store,
    columns: Sequence[str] | None = None,
    from_: float = 1,
    to: float | None = None,
    keyed: bool = False,
    row_ids: bool = False,
) -> DataFrame:
    if columns is None:
        columns = store.meta.column_names
    elif isinstance(columns, str):
        columns = [columns]
    elif not isinstance(columns, (list, tuple)) or not all(isinstance(c, str) for c in columns):
        raise TypeError("Parameter 'columns' should be a character vector of column names.")
    if missing := [c for c in columns if c not in store.meta.column_names]:
        raise KeyError(f"Undefined columns: {', '.join(missing)}")
    if len(set(columns)) < len(columns):
        raise ValueError("Columns are asked for more than once")
    lo, hi = _range(from_, to, store.meta.rows)
    df = store.rows
    if (lo, hi) != (1, store.meta.rows):
        df = df.where(store.spans.between(lo, hi))
    if row_ids:
        df = store.spans.with_row_id(store.spark, df)
    df = df.select(*[quoted(c) for c in columns], *[ROW_ID] * row_ids)
    return truncated_key(df) if keyed else with_key(df, [])


def _number(value) -> bool:
    return isinstance(value, numbers.Real) and not isinstance(value, bool) and value == value


def _range(from_, to, rows: int) -> tuple[int, int]:
    if not _number(from_) or from_ < 1:
        raise ValueError("Parameter 'from' should have a numerical value equal or larger than 1.")
    if to is not None and (not _number(to) or to < 1):
        raise ValueError("Parameter 'to' should have a numerical value larger than 1 (or NULL).")
    lo = int(from_)
    hi = rows if to is None or to > rows else int(to)
    if rows == 0 and lo == 1:
        return 1, 0
    if lo > rows or hi < lo:
        raise IndexError("Row selection is out of range")
    return lo, hi


def metadata(spark: SparkSession, path: str, old_format: bool = False) -> Metadata:
    """The record of a stored table, from footers alone."""
    return open_store(spark, path, old_format).meta


def stored_key(df: DataFrame) -> list[str] | None:
    """The key that a keyed read left in ``df``."""
    return key_of(df.schema.fields) or None
