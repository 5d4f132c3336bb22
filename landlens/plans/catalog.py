"""All queries of the library over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import incremental, layout, ledger, monitor, spatial, text

MODULES = [text, monitor, ledger, spatial, layout, incremental]


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
