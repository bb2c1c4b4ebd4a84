"""Printing of a few rows as an aligned grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from ..types import DIFFTIME, DIFFTIME_INT, ITIME, ITIME_INT, RAW, type_code

DIGITS = 7


def shown(field: T.StructField, values: Sequence) -> list[str]:
    """The column's values as text, missing ones as NA."""
    code = type_code(field)
    if code in (ITIME_INT, ITIME):
        return ["NA" if v is None else f"{int(v) // 3600:02d}:{int(v) // 60 % 60:02d}:{int(v) % 60:02d}" for v in values]
    if code in (DIFFTIME, DIFFTIME_INT):
        seconds = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}
        units = (field.metadata or {}).get("units", "secs")
        numbers = _numbers([None if v is None else v.total_seconds() / seconds[units] for v in values])
        return [x if x == "NA" else f"{x} {units}" for x in numbers]
    if code == RAW:
        return ["NA" if v is None else (bytes(v).hex() if isinstance(v, (bytes, bytearray)) else f"{v:02x}") for v in values]
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return _numbers(values)
    if isinstance(field.dataType, T.BooleanType):
        return ["NA" if v is None else str(v).upper() for v in values]
    if isinstance(field.dataType, T.StringType) and values:
        text = ["<NA>" if v is None else str(v) for v in values]
        wide = max(map(len, text))
        return [x.ljust(wide) for x in text]
    return ["NA" if v is None else str(v) for v in values]


def _numbers(values: Sequence[float | None]) -> list[str]:
    """As few decimals as show every value to ``DIGITS`` significant digits."""
    finite = [v for v in values if v is not None and v == v and abs(v) != float("inf")]
    decimals = 0
    for v in finite:
        mantissa, _, exponent = f"{v:.{DIGITS - 1}e}".partition("e")
        places = len(mantissa.lstrip("-").replace(".", "").rstrip("0")) - 1 - int(exponent)
        decimals = max(decimals, places)
    wide = any(abs(v) >= 1e15 for v in finite) or decimals > 15

    def one(v) -> str:
        if v is None:
            return "NA"
        if v != v:
            return "NaN"
        if abs(v) == float("inf"):
            return "Inf" if v > 0 else "-Inf"
        return f"{v:.{DIGITS - 1}e}" if wide else f"{v:.{max(decimals, 0)}f}"

    return [one(v) for v in values]


def grid(
    names: Sequence[str], types: Sequence[str], labels: Sequence[str], columns: Sequence[Sequence[str]], width: int
) -> str:
    """Right-aligned columns under their names and types, row labels at the left; wraps at ``width``."""
    left = max(map(len, [*labels, " "]))
    cells = [[n, t, *c] for n, t, c in zip(names, types, columns, strict=True)]
    wide = [max(map(len, c)) for c in cells]
    starts = ["", " ", *labels]
    out: list[str] = []
    at = 0
    while at < len(cells):
        end, used = at, left
        while end < len(cells) and (end == at or used + 1 + wide[end] <= width):
            used += 1 + wide[end]
            end += 1
        for k, label in enumerate(starts):
            out.append(label.ljust(left) + "".join(" " + cells[c][k].rjust(wide[c]) for c in range(at, end)))
        at = end
    return "\n".join(out)
