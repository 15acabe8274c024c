"""Run registered queries and their SQL side by side and report differences.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def compare(spark, con, sf_dir: str, name: str) -> tuple[str | None, float]:
    """What differs (None if nothing) and how long Spark took."""
    start = time.time()
    df = registered.queries()[name](spark, sf_dir)
    got = [row.asDict() for row in df.collect()]
    took = time.time() - start
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return None, took
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = [dict(zip(columns, row)) for row in result.fetchall()]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", took
    key = sorted(columns)
    left = sorted(repr([_plain(r[c]) for c in key]) for r in got)
    right = sorted(repr([_plain(r[c]) for c in key]) for r in want)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}", took
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    if differing:
        a, b = differing[0]
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 0)
        near = slice(max(0, at - 60), at + 80)
        return f"{len(differing)} rows differ, e.g.\n   got  {a[near]}\n   want {b[near]}", took
    return None, took


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered.queries())
    spark, con = session(), database(sf_dir)
    failed = 0
    for name in names:
        try:
            problem, took = compare(spark, con, sf_dir, name)
        except Exception as error:  # report it and go on with the next query
            problem, took = f"{type(error).__name__}: {str(error)[:600]}", 0.0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
