"""Compare registered queries with their checking SQL: python tools/check.py [sf] [name-part ...]"""

import functools
import math
import os
import sys
import time
from decimal import Decimal

print = functools.partial(print, flush=True)
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cotejo.plans import catalog  # noqa: E402,F401
from cotejo.plans.registry import all_oracles, all_queries  # noqa: E402
from cotejo.plans.relations import TABLES  # noqa: E402
from cotejo.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return "~null~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        return f"{v:.2f}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sqls, bad = all_oracles(), 0
    for name, fn in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR   {name}: {str(e)[:1500]}")
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            exp_cols = [d[0] for d in cur.description]
            exp = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQL   {name}: {str(e)[:1500]}")
            continue
        if sorted(cols) != sorted(exp_cols):
            bad += 1
            print(f"COLS  {name}: {sorted(cols)} / {sorted(exp_cols)}")
            continue
        ix = [exp_cols.index(c) for c in cols]
        odd = [(c, k, str(cur.description[i][1])) for (c, k), i in zip(df.dtypes, ix)
               if "decimal" in k.lower() + str(cur.description[i][1]).lower() and k.lower() != str(cur.description[i][1]).lower()]
        if odd:
            bad += 1
            print(f"TYPES {name}: {odd}")
        a = sorted(tuple(norm(v) for v in r) for r in got)
        b = sorted(tuple(norm(r[i]) for i in ix) for r in exp)
        if a == b:
            print(f"ok    {name}: {len(a)} rows {t1 - t0:.1f}s{'  EMPTY' if not a else ''}")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"DIFF  {name}: {len(a)} / {len(b)} rows  cols={cols}")
            for r in sorted(sa - sb)[:4]:
                print("   spark ", r)
            for r in sorted(sb - sa)[:4]:
                print("   sql   ", r)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
