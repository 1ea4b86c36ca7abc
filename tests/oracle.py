"""Run registered queries against their DuckDB texts and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(f))[0]
        con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in v.items())
    return v


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def compare(spark, con, sf_dir, query, sql, check=None) -> str | None:
    """None if equal, else what differs; ``check`` sees the DataFrame first."""
    df = query(spark, sf_dir)
    if check:
        check(df)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; columns {got_cols}; "
            f"only Spark ({sum(extra.values())}): {sorted(extra, key=str)[:4]}; "
            f"only DuckDB ({sum(missing.values())}): {sorted(missing, key=str)[:4]}"
        )
    return None if sum(got.values()) else "empty result"


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ridership.registry import ORACLES, QUERIES
    from ridership.session import get_spark

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    wanted = sys.argv[1:]
    spark = get_spark("oracle", os.environ.get("TEST_MASTER", "local[8]"), spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key, fn in QUERIES.items():
        if wanted and not any(key == w or key.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if key in ORACLES:
                diff = compare(spark, con, sf_dir, fn, ORACLES[key])
            else:
                n = len(fn(spark, sf_dir).collect())
                diff = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {key} {time.time() - t0:.1f}s {diff or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
