"""The closing of ledger accounts: one pass over the months, whatever the spans an account crosses."""

import random

from pyspark.sql import functions as F

from cotejo.operators import rules_ledger as rl
from cotejo.operators.rules_ledger import close_accounts, natures

MONTHS = "doc_id long, cuenta string, orden int, seq long, c int, a int, s int"


def months_of(spark, rows):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    return spark.createDataFrame(rows, MONTHS).select(
        "doc_id", "cuenta", "orden", "seq", money("c").alias("cargos"), money("a").alias("abonos"), money("s").alias("saldo"),
        money("c").alias("acum_cargos"), money("a").alias("acum_abonos"))


def test_accounts_inside_a_span_and_across_spans_agree_with_a_plain_loop(spark):
    rnd, rows, opening = random.Random(7), [], {}
    for account in range(40):
        key = (account % 3, f"A{account}")
        opening[key] = None if account % 7 == 0 else 0
        step = 1 << 21 if account % 4 == 0 else 1
        for n, at in enumerate(rnd.sample(range(50), 14)):
            rows.append((*key, None if n == 13 else rnd.randint(1, 5), at * step + (account << 40), rnd.randint(0, 2), rnd.randint(0, 2),
                         None if rnd.random() < 0.1 else rnd.randint(-2, 2)))
    heads = spark.createDataFrame([(*k, v) for k, v in opening.items()], "doc_id long, cuenta string, i int").select(
        "doc_id", "cuenta", F.col("i").cast("decimal(18,2)").alias("saldo_inicial"))
    want = {}
    for key, start in opening.items():
        mine = [r for r in rows if r[:2] == key]
        prev, d, a = start, 0, 0
        for r in sorted((r for r in mine if r[2] is not None), key=lambda r: (r[2], r[3])):
            net = r[4] - r[5]
            if r[6] is not None and prev is not None and net:
                d, a = d + (prev + net == r[6]), a + (prev - net == r[6])
            prev = r[6]
        last = max(mine, key=lambda r: (r[2] or -1, -r[3]))
        want[key] = ("" if start is None or d == a else "D" if d > a else "A", last[6], last[4])
    months = months_of(spark, rows)
    got = {(r.doc_id, r.cuenta): (r.naturaleza, r.saldo_final, r.total_cargos) for r in close_accounts(heads, months).collect()}
    assert got == want
    assert {(r.doc_id, r.cuenta): r.naturaleza for r in natures(heads, months).collect()} == {k: v[0] for k, v in want.items()}


def test_months_move_once(spark):
    """The months themselves go through one exchange; all others carry accounts."""
    months = months_of(spark, [(1, "A", m, m, 1, 0, m) for m in range(1, 13)])
    heads = spark.createDataFrame([(1, "A", 0)], "doc_id long, cuenta string, i int").select(
        "doc_id", "cuenta", F.col("i").cast("decimal(18,2)").alias("saldo_inicial"))
    plan = natures(heads, months)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and plan.count("LogicalRDD") <= 3


def test_months_in_order_are_dealt_out_once_for_both_rules(spark):
    """With the stored months V17 and V18 give the cases they give without, and V18 moves no month."""
    rnd, rows = random.Random(9), []
    for account in range(12):
        for n in range(12):
            rows.append((account % 3, f"A{account}", n + 1, (account << 18) + n, rnd.randint(0, 2), rnd.randint(0, 2), None if rnd.random() < 0.2 else rnd.randint(-2, 2)))
    months = months_of(spark, rows).withColumn("periodo", F.col("orden").cast("string")).withColumn("acum_cargos", F.when(F.col("seq") % 5 > 0, F.col("acum_cargos")))
    heads = spark.createDataFrame([(a % 3, f"A{a}", a, 0, "DA"[a % 2]) for a in range(12)], "doc_id long, cuenta string, seq long, i int, naturaleza string").select(
        "doc_id", "cuenta", "seq", F.col("i").cast("decimal(18,2)").alias("saldo_inicial"), "naturaleza", F.col("i").cast("decimal(18,2)").alias("saldo_final"))
    plain = [rl.monthly_balance(heads, months), rl.accumulated(months)]
    both = rl.ledger_rules(heads, months)[:2]
    for a, b in zip(plain, both, strict=True):
        assert sorted(map(str, a.frame.collect())) == sorted(map(str, b.frame.collect()))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        moved = [r.frame._jdf.queryExecution().executedPlan().toString() for r in (plain[1], both[1])]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    carried = [sum("Exchange" in e and "_span#" in e and "REPARTITION" in e for e in p.split("\n")) for p in moved]
    assert carried[0] > 0 and carried[1] == 0
