"""Run registered queries beside their oracle SQL and compare values: ``python tests/verify.py [sf_dir] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return float(value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    got = bag(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return "rows-only", sum(got.values()), took, []
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", 0, took, [sorted(df.columns), sorted(names)]
    want = bag(names, rel.fetchall())
    if got == want:
        return "ok", sum(got.values()), took, []
    diff = [("rows", sum(got.values()), sum(want.values()))]
    diff += [("spark", r) for r in list((got - want))[:2]] + [("duck", r) for r in list((want - got))[:2]]
    return "DIFF", sum((got - want).values()), took, diff


def main():
    import __spark_entry__ as entry

    from docquarry.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    queries, oracles = entry.queries(), entry.oracle_sql()
    unknown = set(oracles) - set(queries)
    assert not unknown, unknown
    spark, con = local_session("8"), connect(sf)
    bad = 0
    for name, fn in queries.items():
        if keys and not any(name == k or (k.endswith("*") and name.startswith(k[:-1])) for k in keys):
            continue
        try:
            status, n, took, diff = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as exc:
            status, n, took, diff = "ERROR", 0, 0.0, [str(exc)[:1500]]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {name:32} rows={n} {took:.1f}s", flush=True)
        for d in diff:
            print("    ", str(d)[:900], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
