"""Text that comes as bytes in a known encoding: everything is stored as UTF-8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import quoted

#: Accepted names (as text files and other systems give them) and the JVM's.
CHARSETS = {"native": "UTF-8", "utf-8": "UTF-8", "utf8": "UTF-8", "unknown": "UTF-8", "latin1": "ISO-8859-1", "ascii": "US-ASCII"}


def to_utf8(data: Column, encoding: Column | str) -> Column:
    """A binary column as a string; ``encoding`` is one name, or a column with each row's."""
    if isinstance(encoding, str):
        return F.decode(data, CHARSETS[encoding.lower()])
    name = F.lower(encoding)
    out = F.when(data.isNull(), F.lit(None).cast("string"))
    for known in dict.fromkeys(CHARSETS.values()):
        out = out.when(name.isin([k for k, v in CHARSETS.items() if v == known]), F.decode(data, known))
    return out.otherwise(F.raise_error(F.concat(F.lit("Unknown encoding: "), encoding)).cast("string"))


def text_column(df: DataFrame, column: str, encoding_column: str, uniform_encoding: bool = True) -> DataFrame:
    """``df`` with the binary column as UTF-8 text, by each row's encoding.

    With ``uniform_encoding`` mixed encodings are recoded; without it they are an error, found by
    one aggregate over the encodings before anything is converted.
    """
    c, e = F.col(quoted(column)), F.lower(F.col(quoted(encoding_column)))
    if not uniform_encoding:
        lo, hi = df.where(c.isNotNull()).agg(F.min(e), F.max(e)).first()
        if lo != hi:
            raise ValueError("Character vectors with mixed encodings are currently not supported")
    return df.withColumn(column, to_utf8(c, F.col(quoted(encoding_column)))).withMetadata(column, {"encoding": "UTF-8"})
