"""Check that every relation is the same on both engines: python tools/relcheck.py [sf]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import duckdb  # noqa: E402
from check import norm  # noqa: E402

from cotejo.plans.relations import RELATIONS, TABLES, Corpus, oracle_ctes  # noqa: E402
from cotejo.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
folder = f"/root/testdata/sf{sf}"
spark = local_session()
spark.sparkContext.setLogLevel("ERROR")
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
corpus = Corpus(spark, folder)
for name in RELATIONS:
    if sys.argv[2:] and name not in sys.argv[2:]:
        continue
    try:
        df = getattr(corpus, name)
        a = sorted(tuple(norm(v) for v in r) for r in df.collect())
        cur = con.execute("WITH " + oracle_ctes([name]) + f" SELECT {', '.join(df.columns)} FROM {name}")
        b = sorted(tuple(norm(v) for v in r) for r in cur.fetchall())
        print("ok  " if a == b else "DIFF", name, len(a), len(b))
        if a != b:
            print(sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2])
    except Exception as e:  # noqa: BLE001
        print("ERR ", name, str(e)[:600])
