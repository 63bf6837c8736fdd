"""Readers and writers."""

from .readers import census_counts, ordered_lines, read_block, read_range, read_run, stored_roster
from .writers import first_rows, write_csv, write_roster, write_run

__all__ = [
    "census_counts", "first_rows", "ordered_lines", "read_block", "read_range", "read_run", "stored_roster", "write_csv",
    "write_roster", "write_run",
]
