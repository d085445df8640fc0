"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's check: same column names, same row count, same multiset of rows (columns
sorted by name, doubles rounded). Usage:

    python tests/harness.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskweave.sources.tables import TABLE_NAMES  # noqa: E402

SF001 = "/root/testdata/sf0.01"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _canon(v.tolist())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_canon(r[i]) for i in order) for r in records)


def compare(spark_df, con, sql):
    srows = spark_df.collect()
    scols = spark_df.columns
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    a = rows_of(scols, [tuple(r) for r in srows])
    b = rows_of(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(x != y for x, y in zip(a, b))} rows), e.g. {diff}"
    return True, f"{len(srows)} rows"


def main(argv):
    from riskweave.plans.registry import ORACLE, QUERIES, load_all
    from riskweave.session import build_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else SF001
    names = [a for a in argv if not a.startswith("/")]
    load_all()
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                ok, msg = compare(df, con, ORACLE[name])
            else:
                n = df.count()
                ok, msg = True, f"rows-only {n} rows"
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:34s} {time.time() - t0:6.1f}s {msg}", flush=True)
    print(f"{bad} failing of {len(names or QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
