"""All registered queries of the library."""

from __future__ import annotations

from tessera.plans import changes, derived, extras, ledgers, lifecycle, lookups, predicates, transitions  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

FLAGSHIP = "q5_row_changes"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
