"""Run a query on Spark and its SQL on DuckDB, and compare the whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{cell(v)}" for k, v in value.items()) + "}"
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Problem text, or None if both results are the same."""
    started = time.time()
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    spark_seconds = time.time() - started
    if sql is None:
        print(f"{name:28} rows={len(mine[1]):7} spark={spark_seconds:6.2f}s  (rows only)")
        return None if mine[1] else f"{name}: no rows"
    started = time.time()
    result = con.execute(sql)
    theirs = normal([d[0] for d in result.description], result.fetchall())
    print(f"{name:28} rows={len(mine[1]):7} spark={spark_seconds:6.2f}s duck={time.time() - started:6.2f}s", end=" ")
    problem = None
    if mine[0] != theirs[0]:
        problem = f"{name}: columns {mine[0]} vs {theirs[0]}"
    elif mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        problem = (
            f"{name}: {len(mine[1])} vs {len(theirs[1])} rows\n  columns {mine[0]}\n"
            f"  only spark {sorted(a - b)[:3]}\n  only sql   {sorted(b - a)[:3]}"
        )
    elif not mine[1]:
        problem = f"{name}: no rows"
    print("OK" if problem is None else "DIFF")
    return problem


def main(names, sf_dir="/root/testdata/sf0.01"):
    from __spark_entry__ import oracle_sql, queries

    from billgrain.session import local_session

    spark = local_session(8)
    con = connect(sf_dir)
    all_queries, all_sql = queries(), oracle_sql()
    problems = []
    for name in names or all_queries:
        try:
            problem = compare(spark, con, name, all_queries[name], all_sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the next one
            problem = f"{name}: {type(error).__name__}: {str(error)[:1500]}"
            print(name, "FAILED")
        if problem:
            problems.append(problem)
    print("\n".join(problems) or "all equal")


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if not a.startswith("/")], next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01"))
