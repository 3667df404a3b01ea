"""Named queries of document reading: documents are printed from typed tables and read back.

The checking SQL is the typed table itself, so it shares nothing with the reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import layout as ly
from cotejo.operators import reading as rd
from cotejo.operators import reading_bank as bk
from cotejo.operators import tokens as tk
from cotejo.plans.queries_layout import parts_of, stored
from cotejo.plans.relations import M as D
from cotejo.plans.relations import _signed_text
from cotejo.plans.registry import query, view
from cotejo.session import stage, stage_by

c = F.col

# ------------------------------------------------------------------------- journals
@stored("pj_blocks", staged=True)
def blocks(t):
    """Words are dealt out once, by the spans of the scans; lines and what is found of them meet where they are read."""
    parts = parts_of(t.pj_words)
    words = t.pj_words.withColumn("_span", rd.reading_span()).repartition(parts, *rd.SPAN)
    return rd.journal_blocks(rd.dealt_lines(rd.pack_lines(words, ["_span"]), parts))


_LABELLED = "(doc_id % 2 = 0 OR doc_id > 16)"
_PID = ("'P' || CASE WHEN length(CAST(n AS STRING)) < 5 THEN lpad(CAST(n AS STRING), 5, '0') ELSE CAST(n AS STRING) END")
view("pj_num", "SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY poliza_id) AS n FROM pj_heads")
query("R8_R9_journal_entries", f"""
SELECT doc_id, {_PID} AS poliza_id, CASE WHEN {_LABELLED} THEN tipo ELSE '' END AS tipo, '' AS naturaleza, fecha,
  CASE WHEN {_LABELLED} THEN descripcion ELSE tipo || ' cliente' END AS descripcion,
  CASE WHEN completa THEN total_debe END AS total_debe, CASE WHEN completa THEN total_haber END AS total_haber,
  completa AND total_debe IS NOT NULL AS completa FROM pj_num""")(
    lambda t: rd.journal_entries(blocks(t)).drop("seq"))
query("R10_R11_R13_journal_moves", f"""
SELECT m.doc_id, {_PID} AS poliza_id, r AS orden, cuenta, CASE WHEN r % 5 = 0 THEN nombre_cuenta || ' largo' ELSE nombre_cuenta END AS nombre_cuenta,
  debe, haber, m.page AS pagina FROM pj_movs m JOIN pj_num p ON p.doc_id = m.doc_id AND p.poliza_id = m.page - 1""")(
    lambda t: rd.journal_moves(blocks(t)).drop("seq").withColumn("pagina", c("pagina").cast("bigint")))
query("R12_journal_anchors", "SELECT DISTINCT doc_id, CAST(400 AS DOUBLE) AS izq, CAST(500 AS DOUBLE) AS der FROM polizas")(
    lambda t: rd.amount_anchors(blocks(t)).select("doc_id", F.round("izq", 3).alias("izq"), F.round("der", 3).alias("der")))
query("R14_journal_cfdi", f"""
SELECT c.doc_id, {_PID} AS poliza_id, c.fecha, documento, CASE WHEN uuid = '' THEN '' WHEN c.seq % 4 < 2 THEN uuid || 'ABCD-12' ELSE uuid END AS uuid,
  CASE WHEN uuid = '' THEN '' ELSE rfc END AS rfc, CASE WHEN uuid = '' THEN '(Manual)' ELSE c.tipo END AS tipo
FROM pj_cfdi c JOIN pj_num p ON p.doc_id = c.doc_id AND p.poliza_id = c.seq""")(
    lambda t: rd.journal_cfdi(blocks(t)).drop("seq"))
query("R15_main_run", f"""
SELECT doc_id, page, CASE WHEN {_LABELLED} THEN 'Tipo de poliza: ' || tipo ELSE tipo || ' cliente' END AS texto FROM pj_heads""")(
    lambda t: rd.pack_lines(t.pj_words).filter("line = 0").select(
        "doc_id", "page", rd.main_run_text(F.lit(125.0)).alias("texto")))

# ------------------------------------------------------------------- general ledgers
@stored("pm_lines")
def ledger_lines(t):
    """Words are dealt out by page once; their lines and what their page inherits meet there."""
    parts = parts_of(t.pm_words)
    packed = rd.pack_lines(t.pm_words.repartition(parts, *ly.PAGE)).withColumn("dentro", c("line") > 0)
    return rd.ledger_lines(packed, keep=lambda lines: stage_by(lines, ly.PAGE, parts))


query("R16_ledger_heads", """
SELECT doc_id, cuenta, 'BANCOS' AS nombre_cuenta, saldo_inicial, CAST(cuenta AS BIGINT) - 999999 AS pagina_inicio FROM mayor_base""")(
    lambda t: rd.ledger_heads(ledger_lines(t)).select("doc_id", "cuenta", "nombre_cuenta", "saldo_inicial",
                                                      c("pagina_inicio").cast("bigint").alias("pagina_inicio")))
query("R16_R17_ledger_months", """
SELECT doc_id, cuenta, CAST(orden AS BIGINT) AS orden, periodo, cargos, abonos, saldo, acum_cargos, acum_abonos FROM mayor_meses""")(
    lambda t: rd.ledger_months(ledger_lines(t), t.mayor_base.select("doc_id").distinct().select(
        "doc_id", F.array(*[F.lit(float(x)) for x in (200, 280, 360, 440, 520)]).alias("anclas")))
    .drop("seq", "pagina").withColumn("orden", c("orden").cast("bigint")))

# ------------------------------------------------------------------------ subledgers
@stored("pa_classes")
def sub_classes(t):
    roles = t.pa_words.groupBy(*rd.LINE).agg(*[
        F.coalesce(F.max(F.when(c("rol") == f, c("text"))), F.lit("")).alias(f) for f in rd.SUB_FIELDS])
    packed = rd.pack_lines(t.pa_words).join(roles, rd.LINE).withColumn("dentro", F.lit(True)).withColumn(
        "es_encabezado", F.lit(False))
    return rd.subledger_classes(packed)


query("R2_R3_subledger_sections", f"""
SELECT doc_id, page, CASE WHEN tipo = 1 THEN 'seccion_etiquetada' ELSE 'seccion_en_fila' END AS clase, cuenta,
  CASE WHEN tipo = 1 THEN '7CUENTA larga' ELSE 'BANORTE' END AS nombre, CAST(1000.00 AS {D}) AS inicial FROM pa_runs""")(
    lambda t: rd.subledger_sections(sub_classes(t)).select(
        "doc_id", F.shiftright("seq", rd.PAGE_BITS).alias("page"), "clase", "cuenta", "nombre", "inicial"))
query("R4_subtotal_lines", "SELECT doc_id, page, COUNT(*) AS n FROM pa_rows WHERE es_subtotal GROUP BY ALL")(
    lambda t: sub_classes(t).filter("clase = 'subtotal'").groupBy("doc_id", c("page").cast("bigint").alias("page")).agg(
        F.count(F.lit(1)).alias("n")))
query("R5_R6_subledger_rows", """
SELECT doc_id, cuenta, CASE WHEN CAST(cuenta AS BIGINT) % 2 = 1 THEN '7CUENTA larga' ELSE 'BANORTE' END AS nombre_cuenta, saldo_inicial_cuenta,
  folio, fecha, '' AS tipo_movimiento, CASE WHEN es_subtotal THEN '' ELSE documento END AS documento, '' AS tercero,
  CASE WHEN es_subtotal THEN '' WHEN ln % 28 < 4 THEN concepto || ' sigue' ELSE concepto END AS concepto,
  debe, haber, saldo, es_subtotal, page AS pagina, saldo_origen FROM pa_rows""")(
    lambda t: rd.subledger_rows(sub_classes(t)).drop("seq").withColumn("pagina", c("pagina").cast("bigint")))

# -------------------------------------------------------------------- trial balances
_MON = ("saldo_ini_deudor", "saldo_ini_acreedor", "debe", "haber", "saldo_fin_deudor", "saldo_fin_acreedor")


def _roles(t):
    names = ("cuenta", "nombre", *_MON)
    return t.totales.select("doc_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("idx", "campo"))


def _role_rows(t):
    return rd.role_rows(t.pb_cells, _roles(t), ("cuenta", "nombre", "naturaleza", *_MON))


query("R1_trial_rows", f"""
SELECT doc_id, page, ln AS line, cuenta, CASE WHEN ln % 18 = 2 THEN nombre || ' continuado' ELSE nombre END AS nombre, '' AS naturaleza,
  CASE WHEN es_acumulativa THEN 'acumulativa' ELSE '' END AS marca, {', '.join(_MON)} FROM pb_rows""")(
    lambda t: rd.trial_rows(_role_rows(t), t.pb_cells.filter("idx = 1").select(
        *rd.LINE, rd.row_mark(F.split("texto", " ")).alias("marca")), _MON))
query("R1_trial_totals", "SELECT doc_id, debe, haber FROM totales")(lambda t: rd.trial_totals(_role_rows(t)))

# ------------------------------------------------------------------- bank statements
@stored("pe_joined")
def bank_words(t):
    """Words of the statements with signs joined to their amounts (K4)."""
    return tk.join_signs(t.pe_words)


@stored("pe_lines")
def bank_lines(t):
    top = c("line").cast("double") * 12
    return rd.pack_lines(bank_words(t)).withColumn("top", top).withColumn("bottom", top + 8)


def _fields(t, vocab):
    return ly.label_fields(ly.labels(bank_words(t)), vocab)


@stored("pe_fields")
def table_fields(t):
    return _fields(t, t.vocab_tabla)


@stored("pe_acc_fields")
def account_fields(t):
    return _fields(t, t.vocab_cuentas)


def _with_cab(fields, heads):
    return fields.join(heads, ly.LINE, "left_semi").withColumn("cab", rd.reading_order())


@stored("pe_accounts")
def account_rows(t):
    heads = ly.statement_headers(bank_words(t), account_fields(t), "cuentas")
    return bk.account_rows(bank_lines(t), heads, _with_cab(account_fields(t), heads))


query("R20_statement_identity", """
SELECT doc_id, 'BANCA UNO, Institución de Banca' AS banco, 'AAA010101AAA' AS rfc, '012180001234567890' AS clabe, '00112233-4' AS num_cuenta, '2024' AS anio,
  'NACIONAL' AS moneda, '01 ENE 2024' AS periodo_ini, '31 ENE 2024' AS periodo_fin FROM est_meta""")(
    lambda t: bk.identity(bank_lines(t)))
query("R21_account_rows", """
SELECT doc_id, FALSE AS es_total, num AS num_cuenta, '' AS clabe, 'ENLACE ' || nombre AS producto, saldo_inicial, saldo_corte FROM pe_acc
UNION ALL SELECT doc_id, TRUE, '', '', 'TOTAL', total_saldo_inicial, total_saldo_corte FROM est_meta
WHERE total_saldo_inicial IS NOT NULL OR total_saldo_corte IS NOT NULL""")(
    lambda t: account_rows(t).drop("seq"))
# Horizontal summaries printed for every account: labels above, amounts below.
view("hs", "SELECT doc_id, seq AS page, saldo_inicial, depositos, retiros, saldo_corte FROM est_cuentas")


def _horizontal(t):
    acc = t.est_cuentas.select("doc_id", c("seq").alias("page"), "saldo_inicial", "depositos", "retiros", "saldo_corte")
    names = (("Saldo inicial", "saldo_inicial"), ("Depósitos", "depositos"), ("Retiros", "retiros"), ("Saldo al corte", "saldo_corte"))
    labels = acc.select("doc_id", "page", F.lit(5).cast("bigint").alias("line"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("n_etiqueta"), F.lit(n).alias("etiqueta"), F.lit(100.0 * i).alias("x_min"), F.lit(100.0 * i + 60).alias("x_max"))
        for i, (n, _) in enumerate(names, 1)])))
    words = acc.select("doc_id", "page", F.lit(6).cast("bigint").alias("line"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), c(f).cast("string").alias("text"), F.lit(100.0 * i + 10).alias("x0"),
                 F.lit(100.0 * i + 50).alias("x1"), F.lit(1).alias("run")) for i, (_, f) in enumerate(names, 1)]))).filter("text IS NOT NULL")
    return labels, rd.pack_lines(words)


query("R22_horizontal_summary", """
SELECT doc_id, page, campo, valor FROM (SELECT doc_id, page, unnest(['saldo_inicial', 'depositos', 'retiros', 'saldo_corte']) AS campo,
  unnest([saldo_inicial, depositos, retiros, saldo_corte]) AS valor FROM hs) WHERE valor IS NOT NULL""")(
    lambda t: (lambda lw: bk.horizontal_summary(lw[0], lw[1], t.vocab_saldos).select("doc_id", "page", "campo", "valor"))(_horizontal(t)))


def _label_value(t):
    """'Saldo promedio 1.00 Saldo Inicial 2.00 Abonos (+) 53 3.00' as words of one line per account."""
    acc = t.est_cuentas.select("doc_id", c("seq").alias("page"), F.lit(3).cast("bigint").alias("line"), "saldo_inicial", "retiros", "depositos")
    items = [F.lit("Saldo"), F.lit("promedio"), F.lit("1.00"), F.lit("Saldo"), F.lit("Inicial"), c("saldo_inicial").cast("string"),
             F.lit("Abonos"), F.lit("(+)"), F.lit("53"), c("depositos").cast("string"), F.lit("Cargos"), c("retiros").cast("string")]
    return acc.select("doc_id", "page", "line", F.posexplode(F.array(*items)).alias("pos", "text")).filter("text IS NOT NULL").select(
        "*", (c("pos") * 30.0).alias("x0"), (c("pos") * 30.0 + 20).alias("x1"))


query("R23_label_values", """
SELECT doc_id, page, 'saldo_inicial' AS campo, saldo_inicial AS valor FROM hs UNION ALL SELECT doc_id, page, 'depositos', depositos FROM hs WHERE depositos IS NOT NULL
UNION ALL SELECT doc_id, page, 'retiros', retiros FROM hs""")(
    lambda t: bk.label_values(_label_value(t), t.vocab_saldos).select("doc_id", "page", "campo", "valor"))
query("R22_R23_first_balances", """
SELECT doc_id, arg_min(saldo_inicial, page) AS saldo_inicial, arg_min(depositos, page) FILTER (WHERE depositos IS NOT NULL) AS depositos,
  arg_min(retiros, page) AS retiros, CAST(NULL AS DECIMAL(18,2)) AS saldo_corte FROM hs GROUP BY doc_id""")(
    lambda t: bk.first_balances(bk.label_values(_label_value(t), t.vocab_saldos)))


# Even documents keep their summary rows; every account of an odd one is a statement of its own, with one account.
_OWN = 1000


def _accounts(t):
    odd = c("doc_id") % 2 == 1
    rows = account_rows(t).filter("NOT es_total").withColumn("_own", F.regexp_extract("producto", r"N(\d+)$", 1).cast("bigint") + _OWN)
    split = rows.withColumn("saldo_corte", F.when(~odd, c("saldo_corte"))).withColumn("_de", c("doc_id")).withColumn("doc_id", F.when(odd, c("_own")).otherwise(c("doc_id")))
    ident = bk.identity(bank_lines(t)).withColumnRenamed("doc_id", "_de").join(split.select("_de", "doc_id").distinct(), "_de").drop("_de")
    values = bk.label_values(_label_value(t), t.vocab_saldos).withColumn("doc_id", F.when(odd, c("page") + _OWN).otherwise(c("doc_id")))
    bal = bk.first_balances(values).withColumn("saldo_corte", F.lit("0.00").cast(D))
    return bk.resolve_accounts(split.drop("_own", "_de"), ident, bal)


query("R24_resolve_accounts", f"""
SELECT doc_id, num AS num_cuenta, '' AS clabe, 'ENLACE ' || nombre AS producto, '' AS moneda, saldo_inicial, NULL AS depositos, NULL AS retiros, saldo_corte
FROM pe_acc f WHERE doc_id % 2 = 0 AND (SELECT COUNT(*) FROM pe_acc a WHERE a.doc_id = f.doc_id) > 1
UNION ALL SELECT own - 10 + {_OWN}, CASE WHEN num = '' THEN '00112233-4' ELSE num END, '012180001234567890', 'ENLACE ' || nombre, 'NACIONAL', f.saldo_inicial, h.depositos,
  h.retiros, 0.00 FROM pe_acc f JOIN hs h ON h.doc_id = f.doc_id AND h.page = own - 10 WHERE f.doc_id % 2 = 1
UNION ALL SELECT f.doc_id, CASE WHEN num = '' THEN '00112233-4' ELSE num END, '012180001234567890', 'ENLACE ' || nombre, 'NACIONAL', f.saldo_inicial, h.depositos,
  h.retiros, f.saldo_corte FROM pe_acc f JOIN hs h ON h.doc_id = f.doc_id AND h.page = own - 10
WHERE f.doc_id % 2 = 0 AND (SELECT COUNT(*) FROM pe_acc a WHERE a.doc_id = f.doc_id) = 1""")(_accounts)


@stored("pe_sections")
def sections(t):
    return bk.section_lines(bank_lines(t), account_rows(t).filter("NOT es_total"))


@stored("pe_table")
def table_lines(t):
    heads = ly.statement_headers(bank_words(t), table_fields(t))
    first = account_rows(t).groupBy("doc_id").agg(F.min_by("num_cuenta", "seq").alias("primera"))
    return bk.table_lines(bank_lines(t), heads, sections(t), first)


@stored("pe_moves")
def bank_moves(t):
    heads = ly.statement_headers(bank_words(t), table_fields(t))
    meta = t.est_meta.select("doc_id", "periodo_ini", "periodo_fin", "anio")
    return bk.moves(table_lines(t), _with_cab(table_fields(t), heads), meta, " ")


# A row of the accounts table opens with its own product name, too; the longest name that opens it wins.
view("pe_keys", f"""SELECT doc_id, CAST(2 AS BIGINT) AS page, ln, 'enlace' || lower(nombre) || num ||
  regexp_replace({_signed_text('saldo_inicial')} || {_signed_text('saldo_corte')}, '[^0-9]', '', 'g') AS k FROM pe_acc
  UNION ALL SELECT doc_id, page, 0, 'enlace' || lower(nombre) FROM pe_sec""")
query("R25_section_lines", """SELECT k.doc_id, k.page, arg_max(a.num, length(a.nombre)) AS seccion FROM pe_keys k JOIN pe_acc a ON a.doc_id = k.doc_id
AND starts_with(k.k, 'enlace' || lower(a.nombre)) GROUP BY k.doc_id, k.page, k.ln""")(
    lambda t: sections(t).select("doc_id", F.shiftright("seq", rd.PAGE_BITS).alias("page"), "seccion"))
query("R26_move_cells", """
SELECT doc_id, page, ln AS line, dia || '-ENE' AS c_fecha, descripcion AS c_descripcion, referencia AS c_referencia FROM pe_movs""")(
    lambda t: bk.move_cells(table_lines(t).filter("NOT _h AND seccion IS NULL"), _with_cab(table_fields(t), ly.statement_headers(bank_words(t), table_fields(t))))
    .filter("c_fecha <> ''").select("doc_id", "page", "line", "c_fecha", "c_descripcion", "c_referencia"))
query("R27_R28_R30_statement_moves", """
SELECT m.doc_id, a.num AS num_cuenta, dia, (CASE WHEN length(dia) = 1 THEN '0' ELSE '' END) || dia || '/01/2024' AS fecha,
  CASE WHEN ln % 24 = 10 THEN descripcion || ' sigue' ELSE descripcion END AS descripcion, referencia, deposito, retiro, saldo, m.page AS pagina
FROM pe_movs m JOIN (SELECT doc_id, own, num FROM pe_acc) a ON a.doc_id = m.doc_id AND a.own = m.page
WHERE NOT (deposito = 0 AND retiro = 0 AND descripcion = 'SALDO ANTERIOR')""")(
    lambda t: bank_moves(t).drop("seq").withColumn("pagina", c("pagina").cast("bigint")))
query("R28_without_openings", """
SELECT doc_id, seq FROM est_movs WHERE NOT (deposito = 0 AND retiro = 0 AND descripcion = 'SALDO ANTERIOR')""")(
    lambda t: bk.without_openings(t.est_movs).select("doc_id", "seq"))
query("R29_report_kind", f"""
SELECT seq + {_OWN} AS doc_id, CASE WHEN seq % 3 = 0 OR (depositos = 0 AND retiros = 0) THEN 'sin_movimientos' ELSE 'no_identificado' END AS clave
FROM est_cuentas WHERE doc_id % 2 = 1""")(
    lambda t: bk.report_kind(
        t.est_cuentas.select(F.when(c("doc_id") % 2 == 1, c("seq") + _OWN).otherwise(c("doc_id")).alias("doc_id"), *[
            F.when((c("doc_id") % 2 == 1) & (c("seq") % 3 == 0), F.lit("0.00").cast(D)).otherwise(c(x)).alias(x) for x in ("depositos", "retiros")]),
        t.est_movs).select("doc_id", "clave"))
query("R30_empty_amounts", """
SELECT doc_id, seq, deposito, retiro, saldo FROM est_movs""")(
    lambda t: t.est_movs.select("doc_id", "seq", *[bk.empty_amounts(F.when(c(x) != 0, c(x).cast("string"))).alias(x) for x in ("deposito", "retiro")],
                                bk.empty_amounts(c("saldo").cast("string"), True).alias("saldo")))
