"""Run registered queries and their SQL side by side: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark, con, name, sf):
    """Seconds taken by Spark and a list of differences."""
    start = time.time()
    df = queries()[name](spark, sf)
    got = df.collect()
    took = time.time() - start
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    expected = want.fetchall()
    problems = []
    if sorted(df.columns) != sorted(columns):
        return took, len(got), [f"columns {df.columns} / {columns}"]
    types = {c[0]: str(c[1]) for c in want.description}
    for column, kind in df.dtypes:
        if DUCK_TYPES.get(kind) != types[column]:
            problems.append(f"type of {column}: {kind} / {types[column]}")
    mine, theirs = rows_of(df.columns, got), rows_of(columns, expected)
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows / {len(theirs)}")
    if mine != theirs:
        a, b = set(mine), set(theirs)
        problems.append(f"only mine {list(a - b)[:3]}, only theirs {list(b - a)[:3]}")
    return took, len(got), problems


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    # A plain session: no query may depend on the settings of build_session.
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in sys.argv[2:] or oracle_sql():
        try:
            took, n, problems = compare(session, con, name, sf)
        except Exception as error:  # noqa: BLE001
            took, n, problems = 0.0, 0, [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{name:28s} {took:6.2f}s {n:8d} {'ok' if not problems else problems}", flush=True)
    print("failing:", bad)
