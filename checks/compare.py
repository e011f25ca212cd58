"""Run queries and oracle SQL side by side and report differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle
from checks.queries import QUERIES
from threadstats.storage import use_folder_if_unset

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _ordered(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in places) for row in rows]
    return [columns[i] for i in places], sorted(picked, key=repr)


def spark_rows(df):
    return _ordered(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql: str):
    result = connection.execute(sql)
    return _ordered([d[0] for d in result.description], result.fetchall())


def _types(rows) -> list[str]:
    kinds = [set() for _ in rows[0]] if rows else []
    for row in rows:
        for kind, value in zip(kinds, row):
            if value is not None:
                kind.add(type(value).__name__)
    return ["/".join(sorted(k)) for k in kinds]


def difference(ours, theirs) -> str | None:
    """None if equal, else what differs first."""
    (names, rows), (other_names, other_rows) = ours, theirs
    if names != other_names:
        return f"columns {names} / {other_names}"
    if len(rows) != len(other_rows):
        return f"rows {len(rows)} / {len(other_rows)}"
    if _types(rows) != _types(other_rows):
        return f"types {_types(rows)} / {_types(other_rows)}"
    unequal = [(a, b) for a, b in zip(rows, other_rows) if a != b]
    if unequal:
        only, other_only = set(rows) - set(other_rows), set(other_rows) - set(rows)
        return f"{len(only)} rows differ, e.g. {sorted(only, key=repr)[:2]} / {sorted(other_only, key=repr)[:2]}"
    return None


def main(sf_dir: str, keys: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_folder_if_unset(spark, "/tmp/threadstats-shared")
    connection, statements, failed = connect(sf_dir), oracle.statements(), 0
    for key in keys or QUERIES:
        started = time.time()
        try:
            ours = spark_rows(QUERIES[key](spark, sf_dir))
            took = time.time() - started
            found = difference(ours, sql_rows(connection, statements[key])) if key in statements else None
            state = "no sql" if key not in statements else "ok" if found is None else f"DIFF {found}"
            print(f"{key:26s} {len(ours[1]):8d} {took:6.1f}s {state[:700]}", flush=True)
            failed += found is not None
        except Exception as error:  # report and go on with the next query
            print(f"{key:26s} FAIL {type(error).__name__} {str(error)[:500]}", flush=True)
            failed += 1
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
