"""All registered queries of the regime operators, with SQL twins for DuckDB."""

from __future__ import annotations

from cinderlake.plans import areas, extras, multivariate, seasons, spatial, tables
from cinderlake.plans.build import QUERIES, SQL

GROUPS = (areas, extras, multivariate, seasons, spatial, tables)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
