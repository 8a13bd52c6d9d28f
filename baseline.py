"""The bench queries against their DuckDB twins on the same machine: ``python baseline.py DIR COPIES``.

DIR holds events.parquet; with COPIES above 1 the events are repeated so often, each copy with users of its own.
Prints a row for each query: seconds on Spark and on DuckDB (medians of 3 after a first run), and the number of
exchanges, sorts and windows of the physical plan.
"""

from __future__ import annotations

import os
import re
import statistics
import sys
import tempfile
import time

import duckdb
from bench import QUERIES, session


def replica(sf_dir: str, copies: int) -> str:
    if copies == 1:
        return sf_dir
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    duckdb.sql(f"COPY (SELECT e.* REPLACE (user_id + k * 1000000 AS user_id, event_id + k * 100000000 AS event_id) FROM '{sf_dir}/events.parquet' e, range({copies}) r(k)) TO '{out}/events.parquet' (ROW_GROUP_SIZE 200000)")
    return out


def main(sf_dir: str, copies: int) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    where, spark = replica(sf_dir, copies), session(cpus)
    from trailspark import registry

    con = duckdb.connect(config={"threads": int(cpus)})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{where}/events.parquet'")
    print(f"| query | Spark s | DuckDB s | Spark / DuckDB | Exchange / Sort / Window |\n|---|---|---|---|---|  ({copies} copies)")
    both = [0.0, 0.0]
    for name in QUERIES:
        times: list[list[float]] = [[], []]
        df = registry.QUERIES[name](spark, where)
        for side, run in ((0, lambda: registry.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()), (1, lambda: con.execute(registry.ORACLES[name]).fetchall())):  # noqa: B023
            for _ in range(4):
                began = time.perf_counter()
                run()
                times[side].append(time.perf_counter() - began)
        a, b = (statistics.median(t[1:]) for t in times)
        both[0] += a
        both[1] += b
        plan = df._jdf.queryExecution().sparkPlan().toString()
        plan = df._jdf.queryExecution().executedPlan().toString() if "Exchange" not in plan else plan
        counts = " / ".join(str(len(re.findall(rf"(?m)^[ :+*()0-9|-]*{x}\b", plan))) for x in ("Exchange", "Sort", "Window"))
        print(f"| {name} | {a:.2f} | {b:.2f} | {a / b:.1f} | {counts} |", flush=True)
    print(f"| sum | {both[0]:.2f} | {both[1]:.2f} | {both[0] / both[1]:.1f} | |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]))
