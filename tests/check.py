"""Compare registered queries with their SQL forms: check.py [sf] [name-part ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(pdf):
    import numpy as np
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for rec in pdf.itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif isinstance(v, (bool, np.bool_)):
                row.append(bool(v))
            elif isinstance(v, (int, np.integer)):
                row.append(float(v))
            elif isinstance(v, (float, np.floating)):
                row.append(float(v) + 0.0)
            else:
                row.append(str(v))
        rows.append(tuple(row))
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(got, want) -> tuple[bool, str]:
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} / {len(want)}"
    if len(got) == 0:
        return False, "no rows"
    a, b = canon(got), canon(want)
    if a == b:
        kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
        return True, f"dtype {kinds}" if kinds else ""
    names = sorted(got.columns)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return False, f"{len(bad)} of {len(a)} rows differ {names}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"


def main(argv):
    import __spark_entry__ as e
    from tapeworks.session import local_session

    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    oracle = e.oracle_sql()
    bad = []
    for name, fn in e.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            t0 = time.time()
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracle:
                print(f"\nrows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                if len(got) == 0:
                    bad.append(name)
                continue
            want = con.execute(oracle[name]).df()
            t2 = time.time()
            ok, why = compare(got, want)
            print("\n" + f"{"ok  " if ok else 'FAIL'} {name} {len(got)} {t1 - t0:.1f}s / {t2 - t1:.1f}s {why}", flush=True)
            if not ok:
                bad.append(name)
        except Exception as ex:  # noqa: BLE001
            print(f"\nFAIL {name} {type(ex).__name__}: {str(ex)[:600]}", flush=True)
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
