"""Run registered queries on Spark and their SQL on DuckDB, and compare the results.

    python -m checks.compare [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, registry

_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str,
               name: str) -> str | None:
    """What differs between both engines for a query, or None."""
    df = registry.queries()[name](spark, sf_dir)
    sql = oracle.statements()[name]
    types = {row[0]: _TYPES.get(row[1], row[1])
             for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    if dict(df.dtypes) != types:
        return f"columns {dict(df.dtypes)} against {types}"
    columns = sorted(types)
    found = _sorted([tuple(row) for row in df.select(*columns).collect()])
    expected = _sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    if not found:
        return "no rows"
    wrong = [pair for pair in zip(found, expected) if pair[0] != pair[1]]
    return f"{len(wrong)} rows, first {columns} {wrong[0]}" if wrong else None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.dir)
    bad = 0
    for name in args.names or registry.queries():
        began = time.perf_counter()
        found = difference(spark, con, args.dir, name)
        bad += found is not None
        print(f"{name:34} {time.perf_counter() - began:6.2f} s  {found or 'ok'}", flush=True)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main()
