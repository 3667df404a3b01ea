"""Formats learned, stored and reused; cells to typed rows and outcomes."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cotejo.operators import templates as tp
from cotejo.operators import trial_chain as ch
from cotejo.session import shared_dir

MAP = {"cuenta": 0, "nombre": 1, "saldo_inicial": 2, "debe": 3, "haber": 4, "saldo_final": 5}
SPLIT = {"cuenta": 0, "nombre": 1, "saldo_ini_deudor": 2, "saldo_ini_acreedor": 3, "debe": 4, "haber": 5, "saldo_fin_deudor": 6, "saldo_fin_acreedor": 7}


def template(tenant="t1", key="aaa", fails=0, version=1, by="", kind="balanza", sure=True, doc=1, strategy="pdf_text"):
    return (doc, tenant, key, kind, strategy, MAP, "saldo_con_signo", "aritmetica", sure, 3, ("-", [], None, None, 0),
            ("0.01", "nivel_1", True), (2, fails, 1), not sure or kind == "estado_cuenta", by, "", version, "")


def templates(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, " + tp.TEMPLATE)


def test_first_sound_document_of_a_new_key_is_learned(spark):
    store = tp.shaped(templates(spark, template(key="old", strategy="first")))
    built = templates(spark, template(key="old"), template(key="bad", fails=1), template(key="new", doc=7, strategy="late"),
                      template(key="new", doc=2, strategy="early"), template(tenant="t2", key="new", doc=9), template(tenant="../x", key="new"),
                      template(tenant=None, key="new"), template(key="no good"))
    got = {(r.tenant_id, r.huella): (r.estrategia, r.mapeo) for r in tp.learn(store.drop("doc_id"), built).collect()}
    assert got == {("t1", "old"): ("first", MAP), ("t1", "new"): ("early", MAP), ("t2", "new"): ("pdf_text", MAP)}
    assert tp.split_valid(built)[1].count() == 3
    assert tp.learn(tp.empty(spark), built.limit(0)).count() == 0


def test_two_writers_lose_no_row(spark):
    folder = f"{shared_dir(spark)}/templates-writers"
    tp.append(spark, folder, tp.empty(spark))
    seen = tp.stored(spark, folder)
    first = tp.fresh(seen, templates(spark, template(key="a", strategy="one"), template(key="b", strategy="one")))
    second = tp.fresh(seen, templates(spark, template(key="b", strategy="two"), template(key="c", strategy="two")))
    tp.append(spark, folder, first)  # both looked before either wrote
    tp.append(spark, folder, second)
    assert {r.huella: r.estrategia for r in tp.stored(spark, folder).collect()} == {"a": "one", "b": "one", "c": "two"}


def test_a_batch_without_manifest_is_not_seen(spark):
    folder = f"{shared_dir(spark)}/templates-dead"
    tp.append(spark, folder, templates(spark, template(key="a")).drop("doc_id"))
    tp.shaped(templates(spark, template(key="dead")).drop("doc_id")).write.parquet(f"{folder}/rows/batch=99999")
    with pytest.raises(Exception, match="broken"):
        tp.append(spark, folder, templates(spark, template(key="x")).withColumn("forma", F.raise_error(F.lit("broken")).cast("string")))
    assert [r.huella for r in tp.stored(spark, folder).collect()] == ["a"]


def test_a_confirmation_is_a_new_version(spark):
    folder = f"{shared_dir(spark)}/templates-confirmed"
    tp.append(spark, folder, templates(spark, template(key="a", sure=False), template(key="b", sure=False), template(key="s", kind="estado_cuenta")).drop("doc_id"))
    store = tp.stored(spark, folder)
    asked = spark.createDataFrame([("t1", "a", "ana", "2025"), ("t1", "a", "eva", "2026"), ("t2", "a", "ana", "2025")], "tenant_id string, huella string, por string, cuando string")
    new, unknown = tp.confirm(store, asked)
    assert [(r.tenant_id, r.huella) for r in unknown.collect()] == [("t2", "a")]
    tp.append(spark, folder, new.filter("version > 1"))
    got = {r.huella: (r.pendiente, r.confirmada_por, r.version) for r in tp.stored(spark, folder).collect()}
    assert got == {"a": (False, "ana", 2), "b": (True, "", 1), "s": (True, "", 1)}
    asks = {r.huella: (r.campo, r.propone_debe, r.propone_haber) for r in tp.pending_questions(tp.stored(spark, folder)).collect()}
    assert asks == {"b": ("orientacion debe/haber", 3, 4), "s": ("separador de continuacion", None, None)}


def test_a_statement_always_stays_pending(spark):
    reading = spark.createDataFrame([(1, "t1", "a", "estado_cuenta", "pdf_text", MAP, "tabla", "aritmetica", True, 0), (2, "t1", "b", "balanza", "pdf_text", MAP, "x", "aritmetica", True, 0),
                                     (3, "t1", "c", "balanza", "pdf_text", MAP, "x", "vocabulario", None, 4)],
                                    "doc_id long, tenant_id string, huella string, tipo string, estrategia string, mapeo map<string,int>, forma string, "
                                    "verificado_por string, orientacion_verificada boolean, filas_afectadas long")
    cover = spark.createDataFrame([(k, 1, 0, 0) for k in (1, 2, 3)], "doc_id long, cuadran long, fallan long, no_verificables long")
    schemes = spark.createDataFrame([(2, "-", [1], None, None, 0)], "doc_id long, separador string, anchos array<int>, marca_ini int, marca_fin int, largo int")
    rules = spark.createDataFrame([(2, "0.01", "nivel_1", True)], "doc_id long, tolerancia string, subconjunto_totales string, exige_partida_doble boolean")
    got = {r.doc_id: (r.pendiente, r.esquema and r.esquema.separador, r.reglas and r.reglas.tolerancia) for r in tp.build(reading, schemes, rules, cover).collect()}
    assert got == {1: (True, None, None), 2: (False, "-", "0.01"), 3: (True, None, None)}


def lines(doc, rows, page=1):
    return [(doc, page, n, k, text) for n, row in enumerate(rows) for k, text in enumerate(row) if text is not None]


def test_a_learned_format_reads_the_next_document_without_a_search(spark):
    rows = [["100", "CAJA", "10.00", "5.00", "2.00", "13.00"], [None, "sigue"], ["100-01", "UNA", "10.00", "5.00", "2.00", "13.00"],
            ["200", "PASIVO", "50.00", "1.00", "4.00", "53.00"], ["200-01", "QUIETA", "50.00", "1.00", "1.00", "50.00"],
            [None, "2 Cuentas Totales:", None, "6.00", "6.00", None]]
    cells = spark.createDataFrame(lines(1, rows) + lines(2, rows) + lines(3, [["x", "y"]]), "doc_id long, page int, line int, idx int, texto string")
    readings = spark.createDataFrame([(1, "t1", "a"), (2, "t1", "b"), (3, "t1", "b"), (4, "t2", "a")], "doc_id long, tenant_id string, huella string")
    looked = []

    def search(docs):
        looked.extend(sorted(r.doc_id for r in docs.collect()))
        return spark.createDataFrame([(2, "saldo_con_signo", MAP, "", True, "aritmetica"), (3, None, None, "ninguno", None, None)],
                                     "doc_id long, forma string, asigna map<string,int>, motivo string, orientada boolean, verificado_por string")

    store = templates(spark, template(key="a")).drop("doc_id")
    chosen = ch.choose_mappings(readings, store, search)
    got = {r.doc_id: (r.asigna, r.reutilizada) for r in chosen.collect()}
    assert looked == [2, 3, 4] and got == {1: (MAP, True), 2: (MAP, False), 3: (None, False)}
    raw, balanza, totales = ch.read_trials(cells, chosen)
    seen = {(r.doc_id, r.cuenta): (r.nombre, r.naturaleza, r.naturaleza_origen, r.saldo_fin_deudor, r.saldo_fin_acreedor) for r in balanza.collect()}
    zero = Decimal("0.00")
    want = {"100": ("CAJA sigue", "D", "derivada", Decimal("13.00"), zero), "100-01": ("UNA", "D", "derivada", Decimal("13.00"), zero),
            "200": ("PASIVO", "A", "derivada", zero, Decimal("53.00")), "200-01": ("QUIETA", "A", "heredada", zero, Decimal("50.00"))}
    assert seen == {(d, k): v for d in (1, 2) for k, v in want.items()}
    assert sorted(tuple(r) for r in totales.collect()) == [(d, Decimal("6.00"), Decimal("6.00")) for d in (1, 2)]
    missing = spark.createDataFrame([(4, 3, "saldo_con_signo", "haber")], "doc_id long, n long, forma string, faltan string")
    out = {r.doc_id: (r.estado, r.motivo, r.reutilizada, r.fallan) for r in ch.outcomes(readings, chosen, missing, ch.verdicts(balanza, totales)).collect()}
    assert out[1] == ("con_discrepancias", "", True, 1) and out[2] == ("con_discrepancias", "", False, 1)  # 200-01 moves 1.00 of the 4.00
    assert out[3] == ("rechazado", "ninguno", False, 0)
    assert out[4] == ("rechazado", "el layout no parece una balanza; faltan las columnas: haber", False, 0)


def test_both_forms_in_one_plan(spark):
    split = [["100", "CAJA", "10.00", "0.00", "5.00", "2.00", "13.00", "0.00"], ["200", "DEUDA", "0.00", "9.00", "1.00", "2.00", None, "10.00"]]
    signed = [["100", "CAJA", "10.00", "5.00", "2.00", "13.00"]]
    cells = spark.createDataFrame(lines(1, split) + lines(2, signed), "doc_id long, page int, line int, idx int, texto string")
    mapped = spark.createDataFrame([(1, SPLIT), (2, MAP), (3, None)], "doc_id long, asigna map<string,int>")
    _, balanza, _ = ch.read_trials(cells, mapped)
    got = {(r.doc_id, r.cuenta): (str(r.saldo_ini_deudor), str(r.saldo_ini_acreedor), str(r.saldo_fin_deudor), str(r.saldo_fin_acreedor)) for r in balanza.collect()}
    assert got == {(1, "100"): ("10.00", "0.00", "13.00", "0.00"), (1, "200"): ("0.00", "9.00", "0.00", "10.00"), (2, "100"): ("10.00", "0.00", "13.00", "0.00")}
    states = {(r.doc_id, r.regla): r.estado for r in ch.verdicts(balanza, mapped.select("doc_id", F.lit(None).cast("decimal(18,2)").alias("debe"),
                                                                                      F.lit(None).cast("decimal(18,2)").alias("haber")).limit(0)).collect()}
    assert states[1, "renglon"] == states[2, "renglon"] == "cuadra" and states[1, "totales"] == "no_verificable"


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "doc_id long, page int, line int, idx int, texto string")
    mapped = spark.createDataFrame([], "doc_id long, asigna map<string,int>")
    assert [x.count() for x in ch.read_trials(cells, mapped)] == [0, 0, 0]
