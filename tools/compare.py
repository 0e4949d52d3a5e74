"""Run registered queries against their DuckDB oracle: compare.py [sf] [name-part ...]."""

import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import warnings  # noqa: E402

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from seedloom.plans.registry import TABLES, oracle_queries, spark_queries  # noqa: E402
from seedloom.session import local_session  # noqa: E402


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    out = df.astype(object).where(df.notna(), None)
    rows = sorted(map(tuple, out.values.tolist()), key=lambda r: tuple((v is None, str(v)) for v in r))
    return pd.DataFrame(rows, columns=df.columns, dtype=object)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    warnings.simplefilter('ignore')
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(sf_dir)
    qs, oracle = spark_queries(), oracle_queries()
    bad = []
    for name, run in qs.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
            stop.start()
            got = run(spark, sf_dir).toPandas()
            stop.cancel()
            t1 = time.time()
            if name not in oracle:
                print(f"rows  {name} rows={len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            stop = threading.Timer(30, con.interrupt)
            stop.start()
            want = con.execute(oracle[name]).df()
            stop.cancel()
            a, b = canonical(got), canonical(want)
            same = list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)
            if not same and list(a.columns) == list(b.columns) and len(a) == len(b):
                same = all(x == y or (x is None and y is None) for r, s in zip(a.values, b.values) for x, y in zip(r, s))
            types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in a.columns if c in want and str(got[c].dtype) != str(want[c].dtype)]
            if same:
                print(f"ok    {name} rows={len(got)} {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", types or "", flush=True)
            else:
                bad.append(name)
                print(f"DIFF  {name} spark={a.shape} duck={b.shape}", flush=True)
                if a.shape == b.shape:
                    n = 0
                    for r, s in zip(a.values.tolist(), b.values.tolist()):
                        if r != s:
                            print("   S", str(r)[:300]), print("   D", str(s)[:300])
                            n += 1
                            if n == 3:
                                break
                else:
                    print(a.head(5).to_string()[:1200]), print(b.head(5).to_string()[:1200])
        except Exception as e:
            stop.cancel()
            bad.append(name)
            print(f"FAIL  {name}: {str(e).split(chr(10)+chr(9))[0][:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    os._exit(0)


if __name__ == "__main__":
    main()
