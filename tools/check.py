"""Run registered queries next to their SQL: python tools/check.py [--sf 0.01] [--only regex] [--timing]"""

from __future__ import annotations

import argparse
import glob
import math
import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from barloom.plans import load_plans  # noqa: E402
from barloom.plans.registry import parse_columns  # noqa: E402
from barloom.session import local_session  # noqa: E402

#: how far floating values of both engines may differ, relative; smaller ones are what is left of sums that cancel
REL, LEAST = 1e-8, 1e-9
#: what the last digits of amounts of about one leave
LAST = 1e-14
#: the same for a column that is a difference of large amounts: a share of another column of the row (strike, and spot near it)
DIFFERENCES = {("black_scholes", "price"): ("strike", 2e-14)}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rounded(x):
    """Six significant digits, halves settled the same way on both sides: for the order of rows only."""
    return x if x is None else 0.0 if abs(x) < LEAST else float(f"{x * (1 + 3.7e-8):.5e}")


def rows_of(names, rows, floats=()):
    """Rows with columns by name, in the order of their other columns, then of their floating values."""
    order = sorted(names)
    idx = [names.index(c) for c in order]
    key = [i for i, c in enumerate(order) if c not in floats]
    near = [i for i, c in enumerate(order) if c in floats]
    by = lambda r: tuple((v is None, str(v)) for v in [*[r[i] for i in key], *[rounded(r[i]) for i in near]])
    return order, sorted([tuple(r[i] for i in idx) for r in rows], key=by)


def same(x, y, floor=LAST):
    if not (isinstance(x, float) and isinstance(y, float)):
        return x == y
    return max(abs(x), abs(y)) < LEAST or math.isclose(x, y, rel_tol=REL, abs_tol=floor)


def unlike(plan, names, a, b):
    """Columns in which two rows differ."""
    floor = {c: abs(a[names.index(of)]) * share for (name, c), (of, share) in DIFFERENCES.items() if name == plan.name}
    return {c for c, x, y in zip(names, a, b) if not same(x, y, floor.get(c, LAST))}


def compare(plan, spark, con, sf_dir):
    t0 = time.time()
    df = plan.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if plan.sql is None:
        return len(got), t1 - t0, 0.0, "rows-only" if got else "EMPTY"
    cur = con.execute(plan.oracle())
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    floats = {c for c, kind in parse_columns(plan.columns) if kind == "f"}
    gn, g = rows_of(df.columns, got, floats)
    wn, w = rows_of(names, want, floats)
    status = "ok"
    if gn != wn:
        status = f"COLUMNS {gn} != {wn}"
    elif len(g) != len(w):
        status = f"ROWS spark={len(g)} sql={len(w)}"
    elif not g:
        status = "EMPTY"
    else:
        bad = [(a, b) for a, b in zip(g, w) if unlike(plan, gn, a, b)]
        if bad:
            cols = {c for a, b in bad for c in unlike(plan, gn, a, b)}
            status = f"VALUES {len(bad)}/{len(g)} rows differ in {sorted(cols)}\n    " + "\n    ".join(f"{gn}\n    spark {a}\n    sql   {b}" for a, b in bad[:3])
    if status == "ok":
        for i, c in enumerate(gn):
            if all(r[i] is None for r in g):
                status = f"ok (all NULL: {c})"
    return len(got), t1 - t0, t2 - t1, status


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--rows", default="")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(8), duck(sf_dir)
    fails = 0
    plans = [p for p in load_plans().values() if re.search(args.only, p.build.__module__ + ":" + p.name)]
    for p in plans:
        try:
            n, ts, td, status = compare(p, spark, con, sf_dir)
        except Exception as e:
            text = str(e) if not isinstance(e, duckdb.Error) else str(e)
            n, ts, td, status = 0, 0, 0, "ERROR " + type(e).__name__ + " " + text[:700]
            if isinstance(e, (TypeError, NameError, KeyError, AttributeError)):
                status += "\n" + traceback.format_exc()[-900:]
        bad = not (status.startswith("ok") or status == "rows-only")
        fails += bad
        if bad or status != "ok" or ts > 5 or td > 8:
            print(f"{p.name:36s} {n:8d} spark={ts:6.2f} sql={td:6.2f} {status}", flush=True)
    print(f"{len(plans)} plans, {fails} failing")
    sys.exit(1 if fails else 0)


if __name__ == "__main__":
    main()
