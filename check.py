"""Compare every registered query with its SQL counterpart on one data folder.

usage: python check.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "item"):
        return _plain(value.item())
    return str(value) if not isinstance(value, (int, str, bool)) else value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(rec[i]) for i in order) for rec in records], key=repr), sorted(columns)


def differences(spark, con, folder, entry):
    frame = entry.run(spark, folder)
    got, got_names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if entry.sql is None:
        return len(got), None
    result = con.execute(entry.sql)
    names = [d[0] for d in result.description]
    want, want_names = rows_of(names, result.fetchall())
    if got_names != want_names:
        return len(got), f"columns {sorted(set(got_names) ^ set(want_names))}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows, expected {len(want)}"
    off = [(a, b) for a, b in zip(got, want) if a != b]
    if off:
        a, b = off[0]
        cells = [(n, x, y) for n, x, y in zip(got_names, a, b) if x != y]
        return len(got), f"{len(off)} of {len(got)} rows differ, first: {cells[:6]}"
    return len(got), ""


def main() -> int:
    from poolgrade.catalog import load
    from poolgrade.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = [a for a in sys.argv[2:] if not a.startswith("--")]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, entry in load().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            count, problem = differences(spark, con, folder, entry)
        except Exception as error:  # report and go on with the next query
            count, problem = 0, f"{type(error).__name__}: {str(error)[:1500]}"
        spent = time.time() - start
        state = "rows" if problem is None else ("ok" if problem == "" else "DIFF")
        bad += state == "DIFF"
        print(f"{state:5} {name:34} {count:7} {spent:6.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
