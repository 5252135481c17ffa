"""Rules for the names of tables, rows, fields and branches, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 64


def _fits(name: Column, pattern: str, longest: int = LONGEST) -> Column:
    return F.coalesce(name.rlike(rf"^{pattern}$") & (F.length(name) <= longest) & ~name.startswith("__"), F.lit(False))


def valid_table_id(name: Column) -> Column:
    return _fits(name, r"[A-Za-z_][A-Za-z0-9_-]*")


def valid_row_id(name: Column) -> Column:
    return _fits(name, r"[A-Za-z0-9_][A-Za-z0-9_-]*")


def valid_field_name(name: Column) -> Column:
    return _fits(name, r"[A-Za-z_][A-Za-z0-9_]*")


def valid_branch_name(name: Column) -> Column:
    return _fits(name, r"[A-Za-z_][A-Za-z0-9_-]*")
