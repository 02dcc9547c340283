"""Run registered queries in Spark and DuckDB side by side: ``python -m checks.compare [names]``."""

import math
import os
import sys
import time
from collections import Counter

import duckdb

from checks import fixtures as fx
from checks.catalog import ORACLES, QUERIES
from hearthgrid.session import local_session


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9) + 0.0)
    return repr(v)


def fingerprint(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in fx.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """(matches, message) for one query; a query without SQL only has to return rows."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        return bool(rows), f"{len(rows)} rows, no SQL"
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = fingerprint(df.columns, rows), fingerprint(names, want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return False, f"{len(rows)} against {len(want)} rows; {sum((a - b).values())} differ: {only_a} / {only_b}"
    return True, f"{len(rows)} rows"


def main():
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(cpus=8), duck(sf_dir)
    failed = []
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s  {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
