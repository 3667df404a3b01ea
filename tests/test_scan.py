"""The ordered scan against a row-by-row fold, over spans of every kind."""

import random

from pyspark.sql import functions as F

from cotejo.operators.scan import ordered_scan


def _fold(rows):
    out = {}
    for key in {r[0] for r in rows}:
        prev, total, last = None, None, None
        for _, seq, x in sorted(r for r in rows if r[0] == key):
            before = last
            total = x if total is None else (total + x if x is not None else total)
            last = x if x is not None else last
            out[(key, seq)] = (prev, total, last, before)
            prev = x
    return out


def test_scan_equals_fold(spark):
    rnd = random.Random(7)
    rows = []
    for key in ("a", "b", "c"):
        seqs = set()
        for _ in range(300):
            seqs.add(rnd.choice([rnd.randrange(50), rnd.randrange(1 << 21), rnd.randrange(1 << 44)]))
        rows += [(key, s, None if rnd.random() < 0.3 else rnd.randrange(100)) for s in seqs]
    df = spark.createDataFrame(rows, "k string, seq bigint, x bigint").repartition(7)
    for levels in ((20, 40), (3, 9), (4,), (2, 5, 9)):
        got = ordered_scan(df, ["k"], "seq", lag={"p": F.col("x")}, running={"t": F.col("x")},
                           latest={"l": F.col("x")}, before={"b": F.col("x")}, levels=levels).collect()
        exp = _fold(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r.p, r.t, r.l, r.b) == exp[(r.k, r.seq)], (levels, r)
