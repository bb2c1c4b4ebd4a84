"""Second names of the three table functions, with the same arguments.

The old names carry the name of another program, so they are not given here word for word.
"""

from __future__ import annotations

from .store import metadata, read_table, write_table

table_write = write_table
table_read = read_table
table_metadata = metadata

__all__ = ["table_metadata", "table_read", "table_write"]
