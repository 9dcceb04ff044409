"""Run registered queries against DuckDB: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return [norm(x) for x in v.values()]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([norm(r[i]) for i in order]) for r in rows)


def plain(t: str) -> str:
    t = t.lower()
    return {"varchar": "string", "integer": "int", "hugeint": "HUGEINT", "timestamp": "timestamp_ntz"}.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir) -> list[str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return [] if got is not None else ["no rows"], len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: plain(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    bad = []
    if sorted(df.columns) != sorted(names):
        bad.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
        return bad, len(got), t1 - t0, t2 - t1
    for n, t in df.dtypes:
        if not t.startswith(("array", "map", "struct")) and t != types[n]:
            bad.append(f"type of {n}: {t} vs {types[n]}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        bad.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        bad.append(f"values differ: {len(only_a)}/{len(only_b)}; {sorted(names)}")
        bad += [f"   spark {x}" for x in only_a[:3]] + [f"   sql   {x}" for x in only_b[:3]]
    return bad, len(got), t1 - t0, t2 - t1


def main() -> int:
    import logging

    logging.disable(logging.CRITICAL)
    from scorelake.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            bad, n, ts, td = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            bad, n, ts, td = [f"{type(exc).__name__}: {str(exc)[:700]}"], 0, 0, 0
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name} rows={n} spark={ts:.1f}s sql={td:.1f}s"
              + ("" if name in oracles else " (rows only)"), flush=True)
        for line in bad:
            print("     ", line, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
