"""Hand-made rows of the published cases, and properties every rule must keep."""

from decimal import Decimal

from pyspark.sql import functions as F

from cotejo.operators import rules_journal as rj
from cotejo.operators import rules_ledger as rl
from cotejo.operators import rules_subledger as rs
from cotejo.operators import rules_trial as rt
from cotejo.operators.suites import suite_discrepancies, suite_results
from cotejo.operators.verdict import contract_violations, enforce_contract, rule_results

AUX = ("doc_id bigint, seq bigint, cuenta string, fecha string, saldo_inicial_cuenta decimal(18,2), "
       "debe decimal(18,2), haber decimal(18,2), saldo decimal(18,2), es_subtotal boolean, "
       "saldo_origen string, pagina bigint")


def d(x):
    return None if x is None else Decimal(x)


def aux(spark, rows, opening="0"):
    """rows: (cuenta, debe, haber, saldo[, subtotal])"""
    data = []
    for i, r in enumerate(rows):
        sub = len(r) > 4
        data.append((1, i, r[0], "01/01/2025", d(opening), d(r[1]), d(r[2]), d(r[3]), sub,
                     "impreso" if r[3] is not None else "sin_saldo", 1))
    return spark.createDataFrame(data, AUX)


def run_v6(df):
    return rule_results(rs.running_balance(df, rs.accounts(df))).collect()[0]


CREDIT = [("201", "0", "339097.31", "339097.31"), ("201", "230000", "0", "109097.31"),
          ("201", "0", "338668.01", "447765.32")]


def test_credit_account_balances_and_mirror(spark):
    r = run_v6(aux(spark, CREDIT))
    assert (r.estado, r.exactas) == ("cuadra", 3)
    m = run_v6(aux(spark, [(a, h, x, s) for a, x, h, s in CREDIT]))
    assert (m.estado, m.exactas) == ("cuadra", 3)


def test_two_natures(spark):
    r = run_v6(aux(spark, [("101", "1000", "0", "1000"), ("101", "0", "400", "600"),
                           ("201", "0", "500", "500"), ("201", "200", "0", "300")]))
    assert (r.estado, r.exactas) == ("cuadra", 4)


def test_broken_row_is_one_discrepancy(spark):
    r = run_v6(aux(spark, [("101", "1000", "0", "1000"), ("101", "0", "400", "600"),
                           ("101", "250", "0", "999.99"), ("101", "100", "0", "1099.99")]))
    assert (r.estado, r.discrepancias) == ("falla", 1)


def test_no_nature_is_not_verifiable(spark):
    r = run_v6(aux(spark, [("101", "5", "5", "0"), ("101", "7", "7", "0")]))
    assert (r.estado, r.aplicables, r.evaluados) == ("no_verificable", 2, 0)


def test_account_in_two_sections_restarts(spark):
    """The chain restarts on a change of adjacent account; nature is per account."""
    rows = [("101", "10", "0", "10"), ("102", "5", "0", "5"), ("101", "3", "0", "3")]
    r = run_v6(aux(spark, rows))
    assert (r.estado, r.evaluados, r.exactas) == ("cuadra", 3, 3)


def test_refill_debit_and_credit(spark):
    a = aux(spark, [("101", "1000", "0", "1000"), ("101", "0", "400", None), ("101", "250", "0", "850"),
                    ("101", "1250", "400", "850", True)])
    got = {r.seq: r for r in rs.refill(a, rs.accounts(a)).collect()}
    assert got[1].saldo == Decimal("600.00") and got[1].saldo_origen == "recalculado"
    a = aux(spark, [("201", "0", "5000", "5000"), ("201", "1500", "0", None), ("201", "0", "800", "4300"),
                    ("201", "1500", "5800", "4300", True)])
    got = {r.seq: r for r in rs.refill(a, rs.accounts(a)).collect()}
    assert got[1].saldo == Decimal("3500.00")


def test_no_anchor_no_refill(spark):
    for tail in ([], [("101", "1251", "400", "850", True)]):
        a = aux(spark, [("101", "1000", "0", "1000"), ("101", "0", "400", None), ("101", "250", "0", "850"), *tail])
        assert {r.seq: r.saldo for r in rs.refill(a, rs.accounts(a)).collect()}[1] is None


def golden(spark):
    rows = """101,1,,D,10000,0,5000,1250.25,13749.75,0
101-01,2,101,D,4000,0,2000,1250.25,4749.75,0
101-02,2,101,D,6000,0,3000,0,9000,0
102,1,,D,250000,0,150000,70500.75,329499.25,0
102-01,2,102,D,200500,0,150000,61750.25,288749.75,0
102-01-0001,3,102-01,D,200000,0,150000,60000,290000,0
102-01-0002,3,102-01,D,500,0,0,1750.25,-1250.25,0
102-02,2,102,D,49500,0,0,8750.50,40749.50,0
201,1,,A,0,60000,40000,8000,0,28000
201-01,2,201,A,0,45000,30000,5000,0,20000
201-02,2,201,A,0,15000,10000,3000,0,8000
301,1,,A,0,200000,0,0,0,200000
401,1,,A,0,0,0,150000,0,150000
601,1,,D,0,0,34751,0,34751,0
601-01,2,601,D,0,0,25500.75,0,25500.75,0
601-02,2,601,D,0,0,9250.25,0,9250.25,0""".splitlines()
    data = []
    for i, line in enumerate(rows):
        f = line.split(",")
        data.append((1, i, f[0], int(f[1]), f[2], f[3], f[0], *[d(x) for x in f[4:]], False, "explicita"))
    return spark.createDataFrame(
        data, "doc_id bigint, seq bigint, cuenta string, nivel int, cuenta_padre string, naturaleza string, "
        "nombre string, saldo_ini_deudor decimal(18,2), saldo_ini_acreedor decimal(18,2), debe decimal(18,2), "
        "haber decimal(18,2), saldo_fin_deudor decimal(18,2), saldo_fin_acreedor decimal(18,2), "
        "es_acumulativa boolean, naturaleza_origen string")


def totals(spark):
    return spark.createDataFrame([(1, d("229751.00"), d("229751.00"))],
                                 "doc_id bigint, debe decimal(18,2), haber decimal(18,2)")


def test_golden_trial_balance_is_clean_and_its_twin_has_one_fault(spark):
    b = golden(spark)
    assert suite_discrepancies(rt.trial_rules(b, totals(spark))).count() == 0
    bad = b.withColumn("saldo_fin_deudor", F.when(F.col("cuenta") == "102-02", F.lit(Decimal("40849.50")))
                       .otherwise(F.col("saldo_fin_deudor")).cast("decimal(18,2)"))
    found = suite_discrepancies(rt.trial_rules(bad, totals(spark))).collect()
    assert [(r.regla, r.indice) for r in found] == [("renglon", 7)]


def test_results_keep_their_contract_and_do_not_depend_on_partitions(spark):
    b = golden(spark)
    one = suite_results(rt.trial_rules(b, totals(spark)))
    many = suite_results(rt.trial_rules(b.repartition(9), totals(spark)))
    assert contract_violations(one).count() == 0
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert enforce_contract(one).count() == 4


def test_relabelled_documents_keep_their_verdicts(spark):
    a = aux(spark, CREDIT)
    two = a.unionByName(a.withColumn("doc_id", F.lit(77).cast("bigint")))
    rows = rule_results(rs.running_balance(two, rs.accounts(two))).drop("doc_id").collect()
    assert rows[0] == rows[1]


def test_entries_without_moves_and_open_blocks_stay_in_the_universe(spark):
    e = spark.createDataFrame([(1, 1, 1, True), (1, 2, 2, False), (1, 3, 3, True)],
                              "doc_id bigint, seq bigint, poliza_id bigint, completa boolean")
    m = spark.createDataFrame([(1, 1, d("5"), d("0")), (1, 1, d("0"), d("5")), (1, 2, d("1"), d("0"))],
                              "doc_id bigint, poliza_id bigint, debe decimal(18,2), haber decimal(18,2)")
    r = rule_results(rj.double_entry(e, rj.entry_totals(m))).collect()[0]
    assert (r.estado, r.aplicables, r.evaluados) == ("cuadra", 3, 1)
    assert r.motivo == ("1 de 3 polizas no cerraron dentro de lo leido; "
                        "1 de 3 polizas no trajeron ningun movimiento")


def test_empty_document_is_reported(spark):
    m = spark.createDataFrame([], AUX)
    docs = spark.createDataFrame([(9,)], "doc_id bigint")
    r = rule_results(rs.running_balance(m, rs.accounts(m)), docs).collect()[0]
    assert (r.doc_id, r.estado, r.motivo) == (9, "no_verificable", "el documento no trajo movimientos")


def test_accumulated_skips_unreadable_months(spark):
    rows = [(1, i, "A", i, "m", d("10"), d("0"), None, acum, None) for i, acum in
            enumerate([d("10"), None, d("20")], 1)]
    m = spark.createDataFrame(rows, "doc_id bigint, seq bigint, cuenta string, orden int, periodo string, "
                              "cargos decimal(18,2), abonos decimal(18,2), saldo decimal(18,2), "
                              "acum_cargos decimal(18,2), acum_abonos decimal(18,2)")
    r = rule_results(rl.accumulated(m)).collect()[0]
    assert (r.aplicables, r.evaluados, r.exactas) == (6, 2, 2)
