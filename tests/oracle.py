"""Run registered queries next to their SQL twins in DuckDB.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def _plain(value: object) -> object:
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    return value


def compare(df: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    got = canonical(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    want = canonical(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    extra, missing = _difference(got, want), _difference(want, got)
    return f"{len(got)} rows, expected {len(want)}; extra {extra[:2]!r}; missing {missing[:2]!r}"


def _difference(left: list[tuple], right: list[tuple]) -> list[tuple]:
    known = {repr(row) for row in right}
    return [row for row in left if repr(row) not in known]


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(run(spark, sf_dir), oracles[name], connection) or "ok"
            else:
                verdict = f"{run(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{time.time() - start:6.2f}s {name}: {verdict[:1200]}", flush=True)


if __name__ == "__main__":
    main()
