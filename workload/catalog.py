"""Registry of the checked queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.tables import AIRLINE_RULES_SQL, DECISIONS_SQL, EXTRACTIONS_SQL, FLIGHTS_SQL, mail_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TABLES = {
    "mail": mail_sql("duckdb"),
    "decisions": DECISIONS_SQL,
    "extractions": EXTRACTIONS_SQL,
    "flights": FLIGHTS_SQL,
    "airline_rules": AIRLINE_RULES_SQL,
}


def check(name: str, sql: str, tables: str = "mail"):
    """Register a query with the SQL that gives the same rows in DuckDB.

    ``tables`` names the derived tables the SQL reads.
    """
    used = ",\n".join(f"{t} AS ({_TABLES[t]})" for t in tables.split())
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        body = f"WITH {used},\n{sql[5:]}" if used else sql
    else:
        body = f"WITH {used}\n{sql}" if used else sql

    def register(function: Query) -> Query:
        QUERIES[name] = function
        ORACLES[name] = body
        return function

    return register
