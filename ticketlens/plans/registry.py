"""Named queries: a Spark callable and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}

# SQL forms of the fixed patterns, for an engine whose \s and \w know ASCII only.
SQL_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL_NOT_SPACE = SQL_SPACE.replace("[", "[^", 1)


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run
    return register


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed precision, so that the order of a sum does not show."""
    doubles = [f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles}) if doubles else rows


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_SPACE}', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_round(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
