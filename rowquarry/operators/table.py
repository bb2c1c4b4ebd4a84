"""A lazy reference to a stored table, with 1-based positional selection of columns and rows.

    t = TableRef(spark, path)
    t["a"]  t[[1, 3]]  t[[True, False]]     columns, by name, position or (recycled) mask
    t[i, j]  t[:, j]  t[i, :]               rows and columns; ``:`` takes all
    t.select(i, j, drop)                    the same, and whether a single column dropped its dimension
    t.column(j)  t.cell(col, row)           one column, one cell
    t.gather(index)                         rows listed in a DataFrame of any size

Everything returns an unexecuted DataFrame whose scan is pruned to the columns and row groups that
hold the selection. Only positions that the caller holds in memory are resolved on the driver.
A reference is a snapshot: it does not see a later rewrite of its table until ``refresh``.
"""

from __future__ import annotations

import numbers
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.factors import factor_value, levels_table
from ..plans.gather import AT, gather, gather_listed
from ..sources.store import Store, open_store, scan
from ..types import POS, ROW_ID, quoted, type_code, type_name
from .meta import Metadata, with_key
from .preview import grid, shown

HEAD = TAIL = 5


@dataclass(frozen=True)
class Selection:
    """A selected part; ``dropped`` if it is a bare column rather than a table of one column."""

    df: DataFrame
    dropped: bool = False


class TableRef:
    def __init__(self, spark: SparkSession, path: str, old_format: bool = False):
        self._store: Store = open_store(spark, path, old_format)

    def refresh(self) -> TableRef:
        """A new snapshot of what is stored now."""
        return TableRef(self._store.spark, self._store.path)

    # what is known without reading data

    @property
    def meta(self) -> Metadata:
        return self._store.meta

    @property
    def names(self) -> list[str]:
        return self.meta.column_names

    @property
    def nrow(self) -> int:
        return self.meta.rows

    @property
    def ncol(self) -> int:
        return len(self.meta.fields)

    @property
    def dim(self) -> tuple[int, int]:
        return self.nrow, self.ncol

    def __len__(self) -> int:
        return self.nrow

    def row_names(self) -> DataFrame:
        """(row_name string): "1" to the number of rows, made without reading the table."""
        return self._store.spark.range(1, self.nrow + 1).select(F.col("id").cast("string").alias("row_name"))

    def dimnames(self) -> tuple[DataFrame, list[str]]:
        return self.row_names(), self.names

    def structure(self) -> str:
        """One line per column: its name, type and storage."""
        lines = [f"table reference: {self.nrow} rows, {self.ncol} columns ({self._store.path})"]
        wide = max(map(len, self.names), default=0)
        for f in self.meta.fields:
            lines.append(f" $ {f.name:<{wide}}: {type_name(f)} <{f.dataType.simpleString()}>")
        return "\n".join(lines)

    def levels(self, column: str) -> DataFrame:
        """(code, level) of a factor column."""
        return levels_table(self._store.spark, self._field(column), self._store.path)

    def _field(self, name: str):
        return next(f for f in self.meta.fields if f.name == name)

    # selection

    def df(self, row_ids: bool = False) -> DataFrame:
        """All rows and columns; with ``row_ids``, ``__row_id`` as well."""
        return scan(self._store, row_ids=row_ids)

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: scan(self._store, [n]) for n in self.names}

    def __getitem__(self, index) -> DataFrame:
        if isinstance(index, tuple):
            if len(index) != 2:
                raise IndexError("A table has rows and columns")
            i, j = (None if isinstance(x, slice) and x == slice(None) else x for x in index)
            return self.select(i, j).df
        if isinstance(index, slice) and index == slice(None):
            return self.df()
        return self.select_columns(index).df

    def select_columns(self, j) -> Selection:
        """All rows of these columns; never drops."""
        return Selection(scan(self._store, self.column_names(j)))

    def select(self, i=None, j=None, drop: bool = True) -> Selection:
        """Rows ``i`` of columns ``j``; None takes all. A single ``j`` drops unless ``drop`` is False.

        ``i`` lists row numbers in any order and with repeats, or is a list of booleans (not
        recycled; nulls count as False), or a boolean column expression over the table.
        """
        if i is None and j is None:
            return Selection(self.df())
        dropped = j is not None and _length(j) == 1 and drop is not False
        names = self.names if j is None else self.column_names(j)
        if i is None:
            return Selection(scan(self._store, names), dropped)
        if j is None and self.ncol == 1:
            dropped = True  # all columns of a table of one column: the dimension is lost whatever drop says
        if isinstance(i, Column):
            df = self._store.rows.where(i).select(*map(quoted, names))
            return Selection(with_key(df, []), dropped)
        return Selection(gather(self._store, self.row_numbers(i), names).drop(AT), dropped)

    def rows(self, i, j=None) -> DataFrame:
        """As ``select``, with ``__at``: each row's 1-based place in the selection."""
        return gather(self._store, self.row_numbers(i), self.names if j is None else self.column_names(j))

    def gather(self, index: DataFrame, row_col: str = "row", j=None) -> DataFrame:
        """The rows listed in ``index`` (its column ``row_col``; other columns stay), of any number.

        Row numbers outside the table raise when the result is computed.
        """
        return gather_listed(self._store, index, row_col, self.names if j is None else self.column_names(j))

    def column(self, j, exact: bool = True) -> DataFrame | None:
        """One column; None for a name that the table does not have."""
        if not exact:
            import warnings

            warnings.warn("exact ignored", stacklevel=2)
        if isinstance(j, (list, tuple)):
            if not j:
                raise IndexError("Please use a length one integer or character vector to specify the column")
            if len(j) == 2:
                return self.cell(*j)
            if len(j) > 2:
                raise IndexError("Recursive indexing is currently only supported up to level 1.")
            j = j[0]
        if isinstance(j, str):
            return scan(self._store, [j]) if j in self.names else None
        if not _is_number(j):
            raise TypeError("Please use a length 1 integer or character vector to specify the column")
        if not 1 <= int(j) <= self.ncol:
            raise IndexError(f"Invalid column index {int(j)}")
        return scan(self._store, [self.names[int(j) - 1]])

    def col(self, name: str) -> DataFrame | None:
        return self.column(name)

    def cell(self, col, row) -> DataFrame:
        """One cell, as a DataFrame of one row and one column."""
        if isinstance(col, str) or isinstance(row, str):
            raise IndexError("Subscript out of bounds.")
        if not (_is_number(col) and _is_number(row)):
            raise TypeError("Please use a length 1 integer or character vector to specify the column")
        if not 1 <= int(col) <= self.ncol:
            raise IndexError("Subscript out of bounds.")
        if not 1 <= int(row) <= self.nrow:
            raise IndexError("Second index out of bounds.")
        return scan(self._store, [self.names[int(col) - 1]], int(row), int(row))

    # positions

    def column_names(self, j) -> list[str]:
        """Names of the columns that ``j`` selects."""
        found = _listed(j)
        if any(isinstance(x, str) for x in found):
            if missing := [str(x) for x in found if x not in self.names]:
                raise KeyError(f"Undefined columns: {', '.join(missing)}")
            return found
        if any(x is None or x != x for x in found):
            raise IndexError("Subscript out of bounds.")
        if found and all(_is_bool(x) for x in found):
            if len(found) > self.ncol:
                raise IndexError("Subscript out of bounds.")
            return [n for k, n in enumerate(self.names) if found[k % len(found)]]
        if not all(_is_number(x) for x in found):
            raise TypeError("Columns are selected by name, position or mask")
        if any(x <= 0 for x in found):
            raise IndexError("Only positive column indexes supported.")
        if any(x > self.ncol or x < 1 for x in found):
            raise IndexError("Subscript out of bounds.")
        return [self.names[int(x) - 1] for x in found]

    def row_numbers(self, i) -> Sequence[int]:
        """Row numbers that ``i`` selects, in its order; a range stays a range."""
        if isinstance(i, range) and i.step == 1:
            found: Sequence = i
            lo, hi = (i[0], i[-1]) if i else (1, 1)
        else:
            found = _listed(i)
            if found and all(_is_bool(x) or x is None for x in found) and any(_is_bool(x) for x in found):
                found = [k for k, x in enumerate(found, 1) if x]
            elif any(x is not None and not _is_number(x) and x == x for x in found):
                raise TypeError("Row selection should be done using a numeric or logical vector")
            elif any(x is None or x != x for x in found):
                raise IndexError("Subscript out of bounds.")
            found = [int(x) for x in found]
            lo, hi = (min(found), max(found)) if found else (1, 1)
        if not found:
            return []
        if lo < 0 or hi > self.nrow:
            raise IndexError("Row selection out of range")
        if lo < 1:
            raise ValueError("Parameter 'from' should have a numerical value equal or larger than 1.")
        return found

    # preview

    def preview_rows(self, number_of_rows: float = 50) -> DataFrame:
        """``__row_id`` and the rows that a preview shows: head and tail of a long table, else all."""
        n = self.nrow
        if n > number_of_rows and n > HEAD + TAIL:
            ends = [self._store.spans.between(1, HEAD), self._store.spans.between(n - TAIL + 1, n)]
            df = self._store.rows.where(reduce(Column.__or__, ends))
        else:
            df = self._store.rows
        df = self._store.spans.with_row_id(self._store.spark, df)
        return with_key(df.select(ROW_ID, *map(quoted, self.names)), [])

    def preview(self, number_of_rows: float = 50, width: int = 80) -> str:
        """The printed table: a header, the columns' types, and rows (the first and last five if there are many)."""
        head = "\n".join(self.meta.header())
        if not _is_number(number_of_rows):
            number_of_rows = 100
        if number_of_rows != float("inf"):
            number_of_rows = int(number_of_rows)
        if number_of_rows <= 0:
            return head
        wanted = self.preview_rows(number_of_rows)
        readable = [ROW_ID, *(self._printed(wanted, f) for f in self.meta.fields)]
        rows = sorted(wanted.select(*readable).collect(), key=lambda r: r[0])
        split = len(rows) < self.nrow
        labels = [str(r[0]) for r in rows]
        columns = [shown(f, [r[k] for r in rows]) for k, f in enumerate(self.meta.fields, 1)]
        if split:
            labels.insert(HEAD, "--")
            for c in columns:
                c.insert(HEAD, "--")
        types = [f"<{type_name(f)}>" for f in self.meta.fields]
        return head + "\n" + grid(self.names, types, labels, columns, width)

    @staticmethod
    def _printed(df: DataFrame, f) -> Column:
        said = f.metadata or {}
        if "levels" in said:
            return factor_value(df, f.name).alias(f.name)
        if type_code(f) in (6, 11, 8, 12):  # dates and times as text, so that no client's zone is applied
            return F.col(quoted(f.name)).cast("string").alias(f.name)
        return F.col(quoted(f.name))

    def __str__(self) -> str:
        return self.preview()

    def __repr__(self) -> str:
        return f"TableRef({self._store.path!r}: {self.nrow} rows, {self.ncol} columns)"


def _is_bool(x) -> bool:
    return isinstance(x, bool) or type(x).__name__ in ("bool_", "bool")


def _is_number(x) -> bool:
    return isinstance(x, numbers.Real) and not _is_bool(x) and x == x


def _listed(x) -> list:
    if x is None or isinstance(x, (str, numbers.Real)) or _is_bool(x):
        return [x]
    return list(x.tolist() if hasattr(x, "tolist") else x)


def _length(x) -> int:
    return len(_listed(x))


__all__ = ["POS", "Selection", "TableRef"]
