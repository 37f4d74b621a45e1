"""Compare registered plans with their SQL text on a second engine (test helper and command line)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def run_spark(plan, spark, folder):
    df = plan(spark, folder)
    return df.columns, rows_of(df.columns, [tuple(r) for r in df.collect()])


def run_sql(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, rows_of(columns, cursor.fetchall())


def compare(plan, sql, spark, con, folder):
    """Return (ok, message)."""
    columns, rows = run_spark(plan, spark, folder)
    if sql is None:
        return True, f"rows-only {len(rows)}"
    other_columns, other = run_sql(con, sql)
    if sorted(columns) != sorted(other_columns):
        return False, f"columns {sorted(columns)} != {sorted(other_columns)}"
    if len(rows) != len(other):
        return False, f"row count {len(rows)} != {len(other)}; spark-only {[r for r in rows if r not in other][:2]}; sql-only {[r for r in other if r not in rows][:2]}"
    bad = [(a, b) for a, b in zip(rows, other) if a != b]
    if bad:
        return False, f"{len(bad)} differing rows of {len(rows)}, first {sorted(columns)}: {bad[0]}"
    return True, f"equal {len(rows)}"


def main(argv):
    from pyspark import SparkConf  # noqa: F401
    from corpusweave.session import get_session
    from corpusweave.plans import load_all
    from corpusweave.plans.registry import CATALOG, ORACLE

    folder, wanted = argv[0], argv[1:]
    load_all()
    spark = get_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, plan in CATALOG.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(plan, ORACLE.get(name), spark, con, folder)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1200]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {message[:1500]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
