"""Run registered queries next to their DuckDB SQL.

``python tests/oracle.py [--sf DIR] [--time] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set threads=8")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, str):
        return v
    f = float(v)
    return "nan" if math.isnan(f) else (0.0 if f == 0 else f)


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(df, con, sql: str):
    """None where both sides hold the same bag of rows, else what differs."""
    cols = sorted(df.columns)
    left = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(left), f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=key)
    if len(left) != len(right):
        return len(left), f"rows {len(left)} vs {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            return len(left), f"first difference {bad} in {dict(zip(cols, a))}"
    return len(left), None


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        del argv[i : i + 2]
    from __spark_entry__ import oracle_sql, queries
    from galespark.session import local_session

    spark = local_session(os.environ.get("TEST_CPUS", "8"))
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    prefix = [a for a in argv if not a.startswith("-")]
    failed = 0
    for name, fn in qs.items():
        if prefix and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in prefix):
            continue
        start = time.time()
        try:
            if name in sqls:
                rows, why = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                rows, why = len(fn(spark, sf_dir).collect()), None
        except Exception as e:  # a broken query must not hide the others
            rows, why = 0, f"{type(e).__name__}: {str(e)[:700]}"
        failed += why is not None
        print(f"{'FAIL' if why else 'ok':4} {name:28} {rows:8} {time.time() - start:6.1f}s {why or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
