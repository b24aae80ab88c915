"""Compare registered queries with their DuckDB oracles.

``python tests/oracle_check.py [sf_dir] [query ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    for prefix, name in (
        ("bigint", "i8"), ("hugeint", "i16"), ("integer", "i4"), ("int", "i4"), ("double", "f8"),
        ("decimal", "dec"), ("varchar", "str"), ("string", "str"), ("bool", "bool"),
    ):
        if dtype.startswith(prefix):
            return name
    return dtype


def compare(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    started = time.time()
    columns, got = rows_of(frame.columns, frame.collect())
    print(f"  spark {time.time() - started:.2f}s", flush=True)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: kind(str(d[1])) for d in result.description}
    wanted_columns, wanted = rows_of(names, result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}"
    mine = {name: kind(t) for name, t in frame.dtypes}
    odd = {n: (mine[n], kinds[n]) for n in columns if mine[n] != kinds[n]}
    if odd:
        return f"types (spark, oracle): {odd}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    bad = [(g, w) for g, w in zip(got, wanted) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {columns}: {bad[0]}"
    return ""


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName("pairwright-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    failed = 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in oracles:
                problem = compare(frame, con, oracles[name])
                state = "ok" if not problem else "DIFF " + problem
            else:
                n = len(frame.collect())
                problem, state = "", f"rows only ({n})"
        except Exception as error:  # report and go on with the next query
            problem = state = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += bool(problem)
        print(f"{name:40s} {time.time() - started:6.2f}s {state}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
