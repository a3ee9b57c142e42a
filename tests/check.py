"""Compare registered queries with their SQL: python tests/check.py [sf] [name prefix ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple("~" if pd.isna(v) else (repr(float(v)) if isinstance(v, float) else str(v)) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for c in got.columns:
        if got[c].isna().any() or want[c].isna().any():
            got[c], want[c] = got[c].astype(object), want[c].astype(object)
            got.loc[got[c].notna(), c] = got.loc[got[c].notna(), c].map(lambda v: float(v) if not isinstance(v, (str, bool)) else v)
            want.loc[want[c].notna(), c] = want.loc[want[c].notna(), c].map(lambda v: float(v) if not isinstance(v, (str, bool)) else v)
    a, b = canon(got), canon(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} differ of {len(a)}; {bad[:2]}" if bad else ""


def main(argv):
    from wattloom.catalog import ORACLES, QUERIES
    from wattloom.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", 8, quiet=True)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = []
    for name, run in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            msg = compare(got, con.execute(ORACLES[name]).df()) if name in ORACLES else "rows only"
        except Exception as e:
            took, got, msg = time.time() - start, [], f"ERROR {type(e).__name__}: {str(e)[:700]}"
        ok = msg in ("", "rows only")
        if not ok or len(got) == 0:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} rows={len(got)} {took:.1f}s {msg}", flush=True)
    print("failing:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
