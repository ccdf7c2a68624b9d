"""Named checks: each has a Spark form and, where SQL can say it, an SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from careerlens.session import tune
from careerlens.sources.standins import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: str = ""):
    """Register a query; ``using`` names the adapters its SQL needs."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            parts = [f"{n} as ({SQL[n]})" for n in using.split()]
            body = sql.strip()
            if not parts:
                ORACLES[name] = body
            elif body.lower().startswith("with "):
                ORACLES[name] = f"with {', '.join(parts)}, {body[5:]}"
            else:
                ORACLES[name] = f"with {', '.join(parts)} {body}"
        return fn

    return add


# Blank characters for trim() in SQL.
SQL_BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13, 160, 12288))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(terms, lower: bool = False) -> str:
    """A list literal of terms."""
    return "[" + ", ".join(sql_text(t.lower() if lower else t) for t in terms) + "]::varchar[]"


def sql_any(text: str, terms, lower: bool = False) -> str:
    """SQL condition: ``text`` contains one of ``terms``."""
    return f"(len(list_filter({sql_list(terms, lower)}, lambda k: contains({text}, k))) > 0)"


def sql_hits(text: str, terms, lower: bool = True) -> str:
    return f"list_filter({sql_list(terms)}, lambda k: contains({text}, {'lower(k)' if lower else 'k'}))"
