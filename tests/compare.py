"""Run registered queries on Spark and their SQL on DuckDB and compare all values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Order-free rows with columns sorted by name; values as comparable text."""
    frame = frame[sorted(frame.columns)]

    def show(value) -> str:
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "NULL"
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, float):
            return repr(round(value, 9) + 0.0)
        return f"{type(value).__name__}:{value}"

    columns = []
    for name in frame.columns:
        values = [show(value) for value in frame[name].astype(object)]
        columns.append(values)
    return sorted(zip(*columns)) if columns else []


def as_frame(result) -> pd.DataFrame:
    return pd.DataFrame([tuple(row) for row in result.collect()], columns=result.columns, dtype=object)


def sql_frame(connection: duckdb.DuckDBPyConnection, sql: str) -> pd.DataFrame:
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    return pd.DataFrame(cursor.fetchall(), columns=names, dtype=object)


def main(sf_dir: str, names: list[str]) -> int:
    from evalspark.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, wrong = database(sf_dir), entry_points.oracle_sql(), 0
    for name, query in entry_points.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            ours = as_frame(query(spark, sf_dir))
            took = time.time() - started
            theirs = sql_frame(connection, oracles[name])
            same_names = sorted(ours.columns) == sorted(theirs.columns)
            a, b = (rows_of(ours), rows_of(theirs)) if same_names else ([], [1])
            good = same_names and a == b
            print(f"{'ok  ' if good else 'DIFF'} {name:24s} rows={len(ours)}/{len(theirs)} {took:.2f}s")
            if not good:
                wrong += 1
                if not same_names:
                    print("   columns", sorted(ours.columns), sorted(theirs.columns))
                left, right = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
                print("   spark ", left[:3])
                print("   duckdb", right[:3])
        except Exception as problem:
            wrong += 1
            print(f"FAIL {name}: {str(problem)[:1500]}")
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
