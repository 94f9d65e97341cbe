"""Command line check: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as contract
from rollbook.session import local_session
from tests.oracle import connect, spark_rows, sql_rows


def main(folder: str, names: list[str]) -> int:
    spark, connection = local_session(), connect(folder)
    queries, oracles, bad = contract.queries(), contract.oracle_sql(), 0
    for name in names or queries:
        start = time.time()
        try:
            columns, rows = spark_rows(queries[name](spark, folder))
            took = time.time() - start
            if name not in oracles:
                print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            expected_columns, expected = sql_rows(connection, oracles[name])
            took_sql = time.time() - start - took
        except Exception as problem:  # a report of all queries is more use than the first failure
            bad += 1
            print(f"FAIL {name} {type(problem).__name__} {str(problem)[:1500]}", flush=True)
            continue
        if columns != expected_columns or rows != expected:
            bad += 1
            print(f"DIFF {name} {len(rows)} {len(expected)} {columns} {expected_columns}", flush=True)
            only = sorted(set(rows) - set(expected))[:3], sorted(set(expected) - set(rows))[:3]
            print("   spark", only[0], "\n   sql  ", only[1], flush=True)
        else:
            print(f"ok   {name} {len(rows)} {took:.1f}s sql {took_sql:.1f}s", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
