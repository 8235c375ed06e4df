"""Registry of the queries and their DuckDB SQL."""

from __future__ import annotations

from larkspur.plans import graphs, live, series, stores, texts
from larkspur.plans.common import Query

PARTS = (series.REGISTRY, texts.REGISTRY, graphs.REGISTRY, live.REGISTRY, stores.REGISTRY)
QUERIES: dict[str, Query] = {name: query for part in PARTS for name, query in part.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.sql.items()}
