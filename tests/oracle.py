"""Run registered queries against their check SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from artifactlake.plans.bindings import TABLES
from artifactlake.registry import ORACLES, QUERIES, load_all


#: queries that still lack check SQL; any other one without it fails
NO_SQL: set[str] = set()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        return {k: norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): norm(x) for k, x in v.items()}
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([norm(r[i]) for i in order]) for r in rows))


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, sf, name, con=None):
    """(ok, message) of one query."""
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return name in NO_SQL, f"{len(got)} rows, no SQL"
    con = con or connect(sf)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return True, f"{len(got)} rows"
    gs, ws = set(got), set(want)
    only_got = [r for r in got if r not in ws][:3]
    only_want = [r for r in want if r not in gs][:3]
    return False, (
        f"{len(got)} rows, want {len(want)}\n  cols  {sorted(cols)}\n  spark {only_got}\n  sql   {only_want}"
    )


def main(argv):
    from artifactlake.session import local_session

    load_all()
    spark = local_session()
    sf = argv[0]
    wanted = argv[1:]
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    bad = []
    con = connect(sf)
    for n in names:
        t = time.time()
        try:
            ok, msg = compare(spark, sf, n, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            bad.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n:34s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
