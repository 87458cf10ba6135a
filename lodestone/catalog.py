"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from lodestone.plans import reviews, rules, tables  # noqa: F401 (the others register their queries with tables)


def queries() -> dict:
    return dict(tables.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(tables.SQL)
