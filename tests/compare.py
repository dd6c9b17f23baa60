"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def kind(data_type: pa.DataType) -> str:
    if pa.types.is_integer(data_type):
        return "integer"
    if pa.types.is_floating(data_type) or pa.types.is_decimal(data_type):
        return "float" if pa.types.is_floating(data_type) else f"decimal {data_type}"
    if pa.types.is_string(data_type) or pa.types.is_large_string(data_type):
        return "string"
    return str(data_type)


def rows_of(arrow: pa.Table) -> list[tuple]:
    arrow = arrow.select(sorted(arrow.column_names))
    rows = list(zip(*[c.to_pylist() for c in arrow.columns])) if arrow.num_columns else []
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) if not isinstance(x, float) else (False, "f", x) for x in r))


def compare(name: str, spark_rows: pa.Table, sql_rows: pa.Table) -> list[str]:
    problems = []
    left = {f.name: kind(f.type) for f in spark_rows.schema}
    right = {f.name: kind(f.type) for f in sql_rows.schema}
    if left != right:
        problems.append(f"{name}: schema {left} != {right}")
        if set(left) != set(right):
            return problems
    a, b = rows_of(spark_rows), rows_of(sql_rows)
    if len(a) != len(b):
        problems.append(f"{name}: {len(a)} rows in Spark, {len(b)} in SQL")
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        problems.append(f"{name}: {len(different)} rows differ, first {different[0][0]} != {different[0][1]}")
    return problems


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from ticketlens.session import build_session

    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    connection = connect(folder)
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            result = queries[name](spark, folder).toArrow()
            spent = time.time() - start
            if name in oracles:
                start = time.time()
                expected = connection.execute(oracles[name]).to_arrow_table()
                problems = compare(name, result, expected)
                spent_sql = f"{time.time() - start:.2f}"
            else:
                problems, spent_sql = [], "no sql"
        except Exception as error:  # noqa: BLE001 - a report over all queries
            problems, spent, spent_sql, result = [f"{type(error).__name__}: {str(error)[:600]}"], time.time() - start, "-", None
        bad += bool(problems)
        rows = "-" if result is None else result.num_rows
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} rows={rows} spark={spent:.2f}s sql={spent_sql}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
