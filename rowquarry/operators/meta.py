"""Metadata records: what is known of a stored table without reading its data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import base_code, tagged, type_code, type_name

RECORD = "column string, position int, base_code int, type_code int, type string, key int"


def key_of(fields: Sequence[T.StructField]) -> list[str]:
    """The sort key that still holds for these columns: its longest prefix whose columns are all there."""
    place = {f.metadata["key_pos"]: f.name for f in fields if "key_pos" in (f.metadata or {})}
    key: list[str] = []
    while len(key) + 1 in place:
        key.append(place[len(key) + 1])
    return key


def with_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` with this key recorded, and no other."""
    for name in df.columns:
        at = key.index(name) + 1 if name in key else None
        if at or "key_pos" in (df.schema[name].metadata or {}):
            df = tagged(df, name, key_pos=at)
    return df


def truncated_key(df: DataFrame) -> DataFrame:
    """``df`` with what is left of its key after a projection; later key columns lose their mark."""
    return with_key(df, key_of(df.schema.fields))


@dataclass(frozen=True)
class Metadata:
    """The record of one stored table; codes and names are in stored column order."""

    path: str
    rows: int
    fields: tuple[T.StructField, ...] = field(repr=False)

    @property
    def keys(self) -> list[str] | None:
        return key_of(self.fields) or None

    @property
    def column_names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def column_types(self) -> list[int]:
        return [type_code(f) for f in self.fields]

    @property
    def column_base_types(self) -> list[int]:
        return [base_code(f) for f in self.fields]

    @property
    def key_col_index(self) -> list[int] | None:
        """1-based positions of the key columns, in key order."""
        return [self.column_names.index(k) + 1 for k in self.keys] if self.keys else None

    @property
    def basename(self) -> str:
        return self.path.rstrip("/").rpartition("/")[2]

    def header(self) -> list[str]:
        return ["<rowquarry table>", f"{self.rows} rows, {len(self.fields)} columns ({self.basename})", ""]

    def lines(self) -> list[str]:
        """The printed record: key columns first, in key order, then the others in stored order."""
        keys = self.keys or []
        shown = {f.name: "'" + f.name.replace("\\", "\\\\").replace("'", "\\'") + "'" for f in self.fields}
        wide = max(map(len, shown.values()), default=0)
        kind = {f.name: type_name(f) for f in self.fields}
        listed = [*keys, *(f.name for f in self.fields if f.name not in keys)]
        mark = {k: f" (key {i})" for i, k in enumerate(keys, 1)}
        return self.header() + [f"* {shown[n]:<{wide}}: {kind[n]}{mark.get(n, '')}" for n in listed]

    def __str__(self) -> str:
        return "\n".join(self.lines())

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per column of the table."""
        keys = self.keys or []
        rows = [
            (f.name, i, base_code(f), type_code(f), type_name(f), keys.index(f.name) + 1 if f.name in keys else None)
            for i, f in enumerate(self.fields, 1)
        ]
        return spark.createDataFrame(rows, RECORD)
