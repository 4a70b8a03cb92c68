"""Run registered queries against their SQL and report differences.

``python tests/compare.py [folder] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, connection, folder: str, name: str, run, sql: str | None):
    """(problem or None, number of rows, kinds of the columns on both sides)."""
    frame = run(spark, folder)
    mine = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None, len(mine), None
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    both = {c: (t, kinds.get(c)) for c, t in frame.dtypes}
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}", len(mine), both
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}", len(mine), both
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a}\n      against {b}", len(mine), both
    return None, len(mine), both


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from shelfgrain.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, statements, bad = database(folder), oracle_sql(), 0
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem, count, both = compare(spark, connection, folder, name, run, statements.get(name))
        except Exception as failure:  # report and go on
            problem, count, both = f"{type(failure).__name__}: {str(failure)[:1500]}", 0, None
        odd = {c: v for c, v in (both or {}).items() if kinds.get(v[0]) != v[1]}
        bad += problem is not None
        print(f"{'ok  ' if not problem else 'BAD '} {name:28} {count:8} rows {time.time() - start:6.2f} s"
              f"{'' if name in statements else '  (no SQL)'} {odd or ''}", flush=True)
        if problem:
            print("     ", problem[:1800], flush=True)
    print(f"{bad} differences")
