"""Run registered queries against their SQL counterparts and report differences.

Usage: python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(spark, con, name, query, sql, folder) -> str | None:
    """None when row count, columns and all values agree, else a short description."""
    df = query(spark, folder)
    got_names = df.columns
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns differ: only spark {set(got_names) - set(want_names)}, only sql {set(want_names) - set(got_names)}"
    order = sorted(got_names)
    a = sorted(tuple(_plain(r[got_names.index(c)]) for c in order) for r in got)
    b = sorted(tuple(_plain(r[want_names.index(c)]) for c in order) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cells = [(c, p, q) for c, p, q in zip(order, x, y) if p != q][:4]
        return f"{len(bad)} of {len(a)} rows differ, e.g. {cells}"
    return None


if __name__ == "__main__":
    from expogrid.plans import catalog
    from expogrid.plans.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark, con = local_session(), database(folder)
    failed = 0
    for n in names:
        start = time.time()
        try:
            found = compare(spark, con, n, catalog.QUERIES[n], catalog.ORACLES.get(n), folder)
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {n} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
