"""Named queries of suites, result shaping, diagnostics, templates, sinks and intake."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import functions as F

from cotejo.functions.text import reason_template
from cotejo.operators import diagnostics as dg
from cotejo.operators import rules_bank as rb
from cotejo.operators import rules_journal as rj
from cotejo.operators import rules_ledger as rl
from cotejo.operators import rules_subledger as rs
from cotejo.operators import rules_trial as rt
from cotejo.operators import shape as sh
from cotejo.operators.registry import RULES
from cotejo.operators.suites import stored_rules, suite_discrepancies, suite_results, suite_tolerated
from cotejo.operators.verdict import Rule, compare, contract_violations, coverage, enforce_contract, half_comparisons
from cotejo.plans.queries_rules import D, S, _filled, _heads, names_sql
from cotejo.plans.registry import query, view
from cotejo.session import shared_dir, stage
from cotejo.sources import sinks
from cotejo.streaming import intake

# ------------------------------------------------------- rule suites as stage tables
SUITES = {
    "polizas": ["journal_double_entry", "journal_totals", "journal_invoices_attached",
                "journal_invoices_crossed"],
    "auxiliar": ["subledger_running_balance", "subledger_subtotals", "subledger_refill_anchor"],
    "balanza": ["trial_row_identity", "trial_hierarchy", "trial_totals", "trial_double_entry"],
    "estado-cuenta": ["bank_summary_identity", "bank_summary_against_moves", "bank_running_balance",
                      "bank_declared_total"],
    "mayor": ["ledger_monthly_balance", "ledger_accumulated", "ledger_against_trial"],
}
_BUILD = {
    "polizas": lambda t: rj.journal_rules(t.polizas, t.movimientos, t.cfdi),
    "auxiliar": lambda t: rs.subledger_rules(_filled(t), refilled=True),
    "balanza": lambda t: rt.trial_rules(t.balanza, t.totales),
    "estado-cuenta": lambda t: rb.bank_rules(t.est_meta, t.est_cuentas, t.est_movs),
    "mayor": lambda t: rl.ledger_rules(_heads(t), t.mayor_meses, t.par_balanza),
}
_done: dict[tuple, object] = {}
_cases: dict[tuple, list[Rule]] = {}


def suite(t, kind: str, part: str):
    """Results, discrepancies or tolerated cases of one kind, stored once per corpus."""
    corpus = (t.spark.sparkContext.applicationId, t.folder, kind)
    key = (*corpus, part)
    if key not in _done:
        if corpus not in _cases:
            _cases[corpus] = stored_rules(_BUILD[kind](t))
        rules = _cases[corpus]
        make = {"results": suite_results, "discrepancies": suite_discrepancies,
                "tolerated": suite_tolerated}[part]
        _done[key] = stage(make(rules).withColumn("tipo", F.lit(kind)))
    return _done[key]


def everything(t, part: str):
    return reduce(lambda a, b: a.unionByName(b), [suite(t, k, part) for k in SUITES])


_kv = {k: k.replace("-", "_") for k in SUITES}
for _kind, _rules in SUITES.items():
    view(f"zr_{_kv[_kind]}", " UNION ALL ".join(
        f"SELECT *, {i} AS n_regla, '{_kind}' AS tipo FROM r_{r}" for i, r in enumerate(_rules, 1)))
    # A rule that never fails hands its differences over in the reason, but still lists them.
    view(f"zd_{_kv[_kind]}", " UNION ALL ".join(
        f"SELECT *, {i} AS n_regla, '{_kind}' AS tipo FROM d_{r}" for i, r in enumerate(_rules, 1)))
    _slug = {"polizas": "journal", "auxiliar": "subledger", "balanza": "trial",
             "estado-cuenta": "bank", "mayor": "ledger"}[_kind]
    query(f"V22_{_slug}_suite", f"SELECT * FROM zr_{_kv[_kind]}")(
        lambda t, k=_kind: suite(t, k, "results"))
    query(f"V25_{_slug}_discrepancies", f"SELECT * FROM zd_{_kv[_kind]}")(
        lambda t, k=_kind: suite(t, k, "discrepancies"))
view("zr", " UNION ALL ".join(f"SELECT * FROM zr_{v}" for v in _kv.values()))
view("zd", " UNION ALL ".join(f"SELECT * FROM zd_{v}" for v in _kv.values()))

query("V21_contract_violations", """
SELECT doc_id, regla, estado, 'x' AS violacion FROM zr WHERE (estado = 'cuadra' AND evaluados = 0)
  OR aplicables < evaluados OR exactas_impresas + exactas_recalculadas <> exactas""")(
    lambda t: contract_violations(everything(t, "results")))
query("V21_half_comparisons", "SELECT * FROM zd WHERE (esperado IS NULL) <> (obtenido IS NULL)")(
    lambda t: half_comparisons(everything(t, "discrepancies")))
query("V20_V21_strict_results", "SELECT tipo, doc_id, regla, estado, aplicables, evaluados FROM zr")(
    lambda t: enforce_contract(everything(t, "results")).select(
        "tipo", "doc_id", "regla", "estado", "aplicables", "evaluados"))
view("zc", f"""SELECT *, {S('reglas')} || ' reglas: ' || {S('cuadran')} || ' cuadran, ' || {S('fallan')} ||
  ' fallan, ' || {S('no_verificables')} || ' no verificable' || CASE WHEN no_verificables <> 1 THEN 's' ELSE '' END
  || '; ' || {S('evaluados')} || ' de ' || {S('aplicables')} || ' casos evaluados' || CASE WHEN
  exactas_recalculadas > 0 THEN '; OJO: ' || {S('exactas_recalculadas')} || ' de esas comprobaciones cayeron '
  || 'sobre saldos recalculados por el sistema, no sobre dato impreso' ELSE '' END AS resumen
  FROM (SELECT tipo, doc_id, COUNT(*) AS reglas, COUNT(*) FILTER (WHERE estado = 'cuadra') AS cuadran,
  COUNT(*) FILTER (WHERE estado = 'falla') AS fallan,
  COUNT(*) FILTER (WHERE estado = 'no_verificable') AS no_verificables,
  CAST(SUM(aplicables) AS BIGINT) AS aplicables, CAST(SUM(evaluados) AS BIGINT) AS evaluados,
  CAST(SUM(exactas_recalculadas) AS BIGINT) AS exactas_recalculadas, CAST(0 AS BIGINT) AS sin_universo,
  CAST(SUM(discrepancias) AS BIGINT) AS discrepancias FROM zr GROUP BY tipo, doc_id)""")


def cover(t):
    return coverage(everything(t, "results"), ("tipo", "doc_id"))


query("V23_coverage", "SELECT * FROM zc")(cover)

# -------------------------------------------------------------------------- shaping
view("o1", """SELECT p.doc_id, p.poliza_id, tipo, naturaleza, fecha, descripcion, folio,
  total_debe AS total_debe_declarado, ld AS total_debe_leido, total_haber AS total_haber_declarado,
  lh AS total_haber_leido, completa AND COALESCE(total_debe = ld AND total_haber = lh, FALSE) AS completa
  FROM polizas p LEFT JOIN pol_leidos m ON m.doc_id = p.doc_id AND m.poliza_id = p.poliza_id""")


def _o1(t):
    return sh.journal_heads(t.polizas, rj.entry_totals(t.movimientos))


query("O1_journal_heads", "SELECT * FROM o1")(_o1)
view("may_sum", f"""SELECT doc_id, cuenta, CAST(SUM(cargos) AS {D}) AS lc, CAST(SUM(abonos) AS {D}) AS la
  FROM mayor_meses GROUP BY doc_id, cuenta""")
query("O2_ledger_heads", """
SELECT h.doc_id, h.cuenta, nombre_cuenta, saldo_inicial, saldo_final, total_cargos AS total_cargos_declarado,
  lc AS total_cargos_leido, total_abonos AS total_abonos_declarado, la AS total_abonos_leido, naturaleza,
  pagina_inicio FROM may_heads h LEFT JOIN may_sum s ON s.doc_id = h.doc_id AND s.cuenta = h.cuenta""")(
    lambda t: sh.ledger_heads(_heads(t), rl.read_totals(t.mayor_meses)))
view("o1_heads", f"""SELECT p.doc_id, p.poliza_id, tipo, naturaleza, fecha, descripcion, folio, total_debe AS total_debe_declarado, ld AS total_debe_leido,
  total_haber AS total_haber_declarado, lh AS total_haber_leido, completa AND COALESCE(total_debe = ld AND total_haber = lh, FALSE) AS completa
  FROM polizas p LEFT JOIN pol_leidos l ON l.doc_id = p.doc_id AND l.poliza_id = p.poliza_id""")
view("o2_heads", f"""SELECT h.doc_id, h.cuenta, nombre_cuenta, saldo_inicial, saldo_final, total_cargos AS total_cargos_declarado, lc AS total_cargos_leido,
  total_abonos AS total_abonos_declarado, la AS total_abonos_leido, naturaleza, pagina_inicio FROM may_heads h
  LEFT JOIN may_sum s ON s.doc_id = h.doc_id AND s.cuenta = h.cuenta""")
O3_JOURNAL = f"""SELECT m.*, {", ".join(sinks.JOURNAL_HEAD)} FROM movimientos m LEFT JOIN o1_heads p ON p.doc_id = m.doc_id AND p.poliza_id = m.poliza_id"""
O3_LEDGER = f"""SELECT m.*, {", ".join(sinks.LEDGER_HEAD)} FROM mayor_meses m LEFT JOIN o2_heads h ON h.doc_id = m.doc_id AND h.cuenta = m.cuenta"""
query("O3_journal_flat", O3_JOURNAL)(
    lambda t: sinks.journal_flat(t.movimientos, sh.journal_heads(t.polizas, rj.entry_totals(t.movimientos))))
query("O3_ledger_flat", O3_LEDGER)(
    lambda t: sinks.ledger_flat(t.mayor_meses, sh.ledger_heads(_heads(t), rl.read_totals(t.mayor_meses))))
query("O4_top_discrepancies", """
SELECT tipo, doc_id, lugar, fila, subregla AS regla, esperado IS NOT NULL AS numerica,
  CASE WHEN esperado IS NULL THEN '' ELSE format('{:,.2f}', CAST(esperado AS DOUBLE)) END AS esperado,
  CASE WHEN esperado IS NULL THEN '' ELSE format('{:,.2f}', CAST(obtenido AS DOUBLE)) END AS obtenido,
  total AS total_discrepancias FROM (SELECT *, COUNT(*) OVER (PARTITION BY tipo, doc_id) AS total,
  ROW_NUMBER() OVER (PARTITION BY tipo, doc_id ORDER BY n_regla, indice, fila, subregla, esperado NULLS FIRST, obtenido NULLS FIRST) AS lugar
  FROM zd) WHERE lugar <= 50""")(
    lambda t: sh.top_discrepancies(everything(t, "discrepancies"), ("tipo", "doc_id")))
query("O5_rule_records", f"""
SELECT *, regla || ': ' || concat_ws(', ', {S('evaluados')} || ' de ' || {S('aplicables')} || ' evaluados',
  {S('exactas')} || ' exactos', CASE WHEN exactas_recalculadas > 0 THEN {S('exactas_impresas')} ||
  ' contra dato impreso y ' || {S('exactas_recalculadas')} || ' contra saldo recalculado por el sistema' END,
  CASE WHEN con_tolerancia > 0 THEN {S('con_tolerancia')} || ' dentro de tolerancia' END,
  CASE WHEN discrepancias > 0 THEN {S('discrepancias')} || ' con diferencia' END) AS linea FROM zr""")(
    lambda t: sh.rule_records(everything(t, "results")))
query("O5_rule_records_json")(lambda t: sh.rule_records_json(everything(t, "results")))
query("O6_trial_summary", """
SELECT doc_id, COUNT(*) AS filas, COUNT(*) FILTER (WHERE nivel = 1) AS nivel_1,
  COUNT(*) FILTER (WHERE nivel = 2) AS nivel_2, COUNT(*) FILTER (WHERE nivel = 3) AS nivel_3,
  COUNT(*) FILTER (WHERE nivel NOT IN (1, 2, 3)) AS otros_niveles FROM balanza GROUP BY doc_id""")(
    lambda t: sh.trial_summary(t.balanza))
query("O6_subledger_summary", """
SELECT doc_id, COUNT(*) AS filas, COUNT(*) FILTER (WHERE es_subtotal) AS subtotales,
  COUNT(saldo) AS legibles, COUNT(*) - COUNT(saldo) AS sin_saldo FROM auxiliar GROUP BY doc_id""")(
    lambda t: sh.subledger_summary(t.auxiliar))
query("O6_journal_summary", """
SELECT doc_id, COUNT(*) AS polizas, COUNT(*) FILTER (WHERE NOT completa) AS sin_cerrar,
  (SELECT COUNT(*) FROM movimientos m WHERE m.doc_id = p.doc_id) AS movimientos,
  (SELECT COUNT(*) FROM cfdi c WHERE c.doc_id = p.doc_id) AS cfdi FROM polizas p GROUP BY doc_id""")(
    lambda t: sh.journal_summary(t.polizas, t.movimientos, t.cfdi))
query("O6_bank_summary", """
SELECT c.doc_id, c.seq, COALESCE(NULLIF(producto, ''), NULLIF(c.num_cuenta, ''), '(sin identificar)') AS etiqueta,
  COALESCE(n, 0) AS movimientos, saldo_corte FROM est_cuentas c LEFT JOIN (SELECT doc_id, num_cuenta,
  COUNT(*) AS n FROM est_movs GROUP BY ALL) m ON m.doc_id = c.doc_id AND m.num_cuenta = c.num_cuenta""")(
    lambda t: sh.bank_summary(t.est_cuentas, t.est_movs))
query("O6_ledger_summary", """
SELECT doc_id, COUNT(*) AS cuentas, COUNT(*) FILTER (WHERE naturaleza = '') AS sin_naturaleza,
  (SELECT COUNT(*) FROM mayor_meses m WHERE m.doc_id = h.doc_id) AS meses FROM may_heads h GROUP BY doc_id""")(
    lambda t: sh.ledger_summary(_heads(t), t.mayor_meses))
query("O7_exit_codes", "SELECT tipo, doc_id, CASE WHEN fallan > 0 THEN 1 ELSE 0 END AS codigo FROM zc")(
    lambda t: sh.exit_codes(cover(t), ("tipo", "doc_id")))

view("o8_kinds", "SELECT DISTINCT tipo FROM zr")
view("o8_expected", """SELECT 'polizas' AS tipo, o_custkey % 18 AS doc_id FROM orders GROUP BY 2
  UNION ALL SELECT 'mayor', o_custkey % 17 FROM orders GROUP BY 2
  UNION ALL SELECT 'auxiliar', user_id % 8 FROM events GROUP BY 2""")
view("o8_rejected", """SELECT 'mayor' AS tipo, doc_id, 'sin importes' AS motivo FROM may_zero
  GROUP BY doc_id HAVING COUNT(saldo) = 0""")
view("o8_templates", "SELECT tipo, doc_id, doc_id % 3 = 0 AS pendiente, doc_id % 2 = 0 AS reutilizada FROM lecturas")


def _expected(t):
    pol = t.orders.select(F.lit("polizas").alias("tipo"), (F.col("o_custkey") % 18).alias("doc_id"))
    may = t.orders.select(F.lit("mayor").alias("tipo"), (F.col("o_custkey") % 17).alias("doc_id"))
    aux = t.events.select(F.lit("auxiliar").alias("tipo"), (F.col("user_id") % 8).alias("doc_id"))
    return pol.union(may).union(aux).distinct()


query("O8_inventory", f"""
SELECT e.tipo, e.doc_id, CASE WHEN r.motivo IS NOT NULL THEN 'rechazado' WHEN c.evaluados IS NOT NULL
  THEN 'aceptado' ELSE 'ausente' END AS grupo,
  CASE WHEN r.motivo IS NULL THEN {S('evaluados')} || ' de ' || {S('aplicables')} END AS cobertura,
  CASE WHEN r.motivo IS NULL THEN {S('cuadran')} || '/' || {S('fallan')} || '/' || {S('no_verificables')} END AS reglas,
  CASE WHEN r.motivo IS NULL AND c.evaluados IS NOT NULL THEN CASE WHEN t.pendiente IS NULL THEN 'no'
    WHEN pendiente THEN 'pendiente' WHEN reutilizada THEN 'reutilizada' ELSE 'aprendida' END END AS plantilla,
  CASE WHEN r.motivo IS NULL AND c.evaluados IS NOT NULL THEN CASE WHEN fallan > 0 THEN 1 ELSE 0 END END AS codigo,
  r.motivo FROM o8_expected e LEFT JOIN o8_rejected r ON r.tipo = e.tipo AND r.doc_id = e.doc_id
  LEFT JOIN zc c ON c.tipo = e.tipo AND c.doc_id = e.doc_id
  LEFT JOIN o8_templates t ON t.tipo = e.tipo AND t.doc_id = e.doc_id""")(
    lambda t: sh.inventory(
        _expected(t), cover(t),
        rl.without_amounts(t.may_zero).select(F.lit("mayor").alias("tipo"), "doc_id",
                                              F.lit("sin importes").alias("motivo")),
        t.lecturas.select("tipo", "doc_id", (F.col("doc_id") % 3 == 0).alias("pendiente"),
                          (F.col("doc_id") % 2 == 0).alias("reutilizada"))))
view("o9_docs", """SELECT 'mayor' AS tipo, (year(o_orderdate) - 1992) * 16 + o_custkey % 20 AS doc_id FROM orders GROUP BY 2""")
query("O9_rejections", """
SELECT d.tipo, d.doc_id, 'no_reconocido' AS clave, COALESCE(m.motivo,
  'no se encontro ninguna tabla de mayor en el documento') AS motivo, COALESCE(m.ev, '') AS evidencia
FROM o9_docs d LEFT JOIN (SELECT doc_id, 'sin importes' AS motivo,
  'e1 | e2 | e3 | e4 | e5 | e6' AS ev FROM may_zero GROUP BY doc_id HAVING COUNT(saldo) = 0) m ON m.doc_id = d.doc_id
WHERE NOT EXISTS (SELECT 1 FROM may_zero z WHERE z.doc_id = d.doc_id AND z.saldo IS NOT NULL)""")(
    lambda t: sh.rejections(
        t.orders.select(F.lit("mayor").alias("tipo"), ((F.year("o_orderdate") - 1992) * 16 + F.col("o_custkey") % 20).alias("doc_id")).distinct(),
        t.may_zero.filter("saldo IS NOT NULL").select(F.lit("mayor").alias("tipo"), "doc_id"),
        rl.without_amounts(t.may_zero).select(
            F.lit("mayor").alias("tipo"), "doc_id", F.lit(None).cast("string").alias("clave"),
            F.lit("sin importes").alias("motivo"),
            F.array(*[F.lit(f"e{i}") for i in range(1, 7)]).alias("evidencia"))))

# ---------------------------------------------------------------------- diagnostics
# Moves of every tenth account carry another account, so the subtotals are orphans.
view("aux_perdido", """SELECT doc_id, seq, CASE WHEN CAST(cuenta AS BIGINT) % 10 = 0 AND NOT es_subtotal THEN cuenta || '-9'
  WHEN CAST(cuenta AS BIGINT) % 20 = 0 THEN cuenta || '-000' ELSE cuenta END AS cuenta, CASE WHEN CAST(cuenta AS BIGINT) % 30 = 0 THEN 0 ELSE debe END AS debe,
  CASE WHEN CAST(cuenta AS BIGINT) % 30 = 0 THEN 0 ELSE haber END AS haber, es_subtotal FROM auxiliar
""")


def _lost_moves(t):
    n = F.col("cuenta").cast("bigint")
    a = t.auxiliar
    zero = F.lit(0).cast(D)
    return a.select("doc_id", "seq", F.when((n % 10 == 0) & ~F.col("es_subtotal"), F.concat("cuenta", F.lit("-9")))
                    .when(n % 20 == 0, F.concat("cuenta", F.lit("-000")))
                    .otherwise(F.col("cuenta")).alias("cuenta"),
                    *[F.when(n % 30 == 0, zero).otherwise(F.col(c)).alias(c) for c in ("debe", "haber")],
                    "es_subtotal")


query("D1_orphan_subtotals", f"""
SELECT doc_id, regexp_matches(cuenta, '-0+$') AS acumulativa, debe + haber <> 0 AS con_importe,
  COUNT(*) AS subtotales, CAST(SUM(debe + haber) AS {D}) AS importe FROM aux_perdido s
WHERE es_subtotal AND NOT EXISTS (SELECT 1 FROM aux_perdido m WHERE NOT m.es_subtotal
  AND m.doc_id = s.doc_id AND m.cuenta = s.cuenta) GROUP BY ALL""")(
    lambda t: dg.orphan_subtotals(_lost_moves(t)))
view("dvr", """SELECT p.doc_id, p.poliza_id, total_debe, total_haber, COALESCE(ld, 0) AS ld, COALESCE(lh, 0) AS lh,
  COALESCE(total_debe, ld, 0) AS dd, COALESCE(total_haber, lh, 0) AS dh, COALESCE(n, 0) AS n, n AS nn, completa
  FROM polizas p LEFT JOIN pol_leidos m ON m.doc_id = p.doc_id AND m.poliza_id = p.poliza_id""")
query("D2_declared_vs_read", f"""
SELECT doc_id, COUNT(*) AS polizas, COUNT(*) FILTER (WHERE dd <> ld OR dh <> lh) AS difieren,
  COUNT(*) FILTER (WHERE (dd <> ld OR dh <> lh) AND dd > ld) AS corto,
  COUNT(*) FILTER (WHERE (dd <> ld OR dh <> lh) AND dd <= ld) AS exceso,
  CAST(SUM(dd - ld) AS {D}) AS falta_debe, CAST(COALESCE(SUM(total_debe), 0) AS {D}) AS declarado_debe,
  CAST(COALESCE(SUM(total_haber), 0) AS {D}) AS declarado_haber, CAST(SUM(ld) AS {D}) AS leido_debe,
  CAST(SUM(lh) AS {D}) AS leido_haber FROM dvr GROUP BY doc_id""")(
    lambda t: dg.declared_vs_read(t.polizas, rj.entry_totals(t.movimientos)))
query("D3_shape_of_loss", """
SELECT doc_id, CASE WHEN dd > ld THEN 'debe corto' WHEN dd < ld THEN 'debe sobra' ELSE 'debe ok' END AS lado_debe,
  CASE WHEN dh > lh THEN 'haber corto' WHEN dh < lh THEN 'haber sobra' ELSE 'haber ok' END AS lado_haber,
  COUNT(*) AS polizas FROM dvr WHERE dd <> ld OR dh <> lh GROUP BY ALL""")(
    lambda t: dg.shape_of_loss(t.polizas, rj.entry_totals(t.movimientos)))
query("D3_entry_sizes", """
g AS (SELECT doc_id, n, 'todas' AS grupo FROM dvr UNION ALL
      SELECT doc_id, n, 'fallidas' FROM dvr WHERE dd <> ld OR dh <> lh)
SELECT doc_id, grupo, list_sort(list(n))[COUNT(*) // 2 + 1] AS mediana, COUNT(*) AS polizas, MAX(n) AS maximo,
  COUNT(*) FILTER (WHERE n = 0) AS vacias FROM g GROUP BY doc_id, grupo""")(
    lambda t: dg.entry_sizes(t.polizas, rj.entry_totals(t.movimientos)))
query("D3_two_sided_moves", """
SELECT m.doc_id, COUNT(*) AS movimientos, COUNT(*) FILTER (WHERE debe <> 0 AND haber <> 0) AS con_ambos,
  COUNT(*) FILTER (WHERE debe <> 0 AND haber <> 0 AND (dd <> ld OR dh <> lh)) AS en_fallidas
FROM movimientos m JOIN dvr d ON d.doc_id = m.doc_id AND d.poliza_id = m.poliza_id GROUP BY m.doc_id""")(
    lambda t: dg.two_sided_moves(t.movimientos, t.polizas, rj.entry_totals(t.movimientos)))
query("D4_hierarchy_universe", """
c AS (SELECT n.doc_id, n.cuenta_padre, bool_or(b.cuenta IS NOT NULL) AS esta,
      bool_or(p.cuenta_padre IS NOT NULL AND p.seq IS NOT NULL) AS hijas
      FROM bal_named n LEFT JOIN balanza b ON b.doc_id = n.doc_id AND b.cuenta = n.cuenta_padre
      LEFT JOIN bal_pairs p ON p.doc_id = n.doc_id AND p.cuenta_padre = n.cuenta_padre GROUP BY ALL)
SELECT doc_id, COUNT(*) AS referidos, COUNT(*) FILTER (WHERE hijas) AS con_hijas,
  COUNT(*) FILTER (WHERE NOT esta) AS ausentes, COUNT(*) FILTER (WHERE esta AND NOT hijas) AS sin_hijas,
  COUNT(*) - COUNT(*) FILTER (WHERE hijas) = COUNT(*) FILTER (WHERE NOT hijas) AS se_explican
FROM c GROUP BY doc_id""")(lambda t: dg.hierarchy_universe(t.balanza))
query("D5_rows_with_many", """
SELECT doc_id, fila, COUNT(*) AS veces, string_agg(DISTINCT subregla, ', ' ORDER BY subregla) AS reglas
FROM zd_polizas GROUP BY doc_id, fila HAVING COUNT(*) > 1""")(
    lambda t: dg.rows_with_many(suite(t, "polizas", "discrepancies")))
query("D6_entry_sheet", """
j AS (SELECT v.*, total_debe IS NOT NULL AND total_haber IS NOT NULL AS dec,
  total_debe <> ld OR total_haber <> lh AS dif, EXISTS (SELECT 1 FROM d_journal_double_entry x
  WHERE x.doc_id = v.doc_id AND x.fila = CAST(v.poliza_id AS STRING)) AS mal FROM dvr v)
SELECT doc_id, COUNT(*) AS polizas, COUNT(*) FILTER (WHERE NOT completa) AS incompletas,
  COUNT(*) FILTER (WHERE NOT dec) AS sin_totales, COUNT(*) FILTER (WHERE dec AND nn IS NULL) AS sin_movimientos,
  COUNT(*) FILTER (WHERE dec AND dif) AS difieren, COUNT(*) FILTER (WHERE mal) AS fallan,
  COUNT(*) FILTER (WHERE mal AND dec AND dif) AS en_comun,
  COUNT(*) FILTER (WHERE mal <> (dec AND COALESCE(dif, FALSE))) = 0 AS son_las_mismas FROM j GROUP BY doc_id""")(
    lambda t: dg.entry_sheet(t.polizas, rj.entry_totals(t.movimientos),
                             suite(t, "polizas", "discrepancies").filter("regla = 'partida_doble'")))
query("D7_rules_without_cases", """
SELECT regla, COUNT(DISTINCT doc_id) AS documentos, COUNT(*) FILTER (WHERE estado = 'cuadra') AS prohibidas
FROM zr WHERE evaluados = 0 GROUP BY regla""")(lambda t: dg.rules_without_cases(everything(t, "results")))
view("d8_may", f"""SELECT * FROM (SELECT h.doc_id, h.cuenta,
  unnest(['total_cargos', 'total_abonos', 'saldo_final']) AS campo,
  unnest([total_cargos, total_abonos, saldo_final]) AS declarado,
  unnest([lc, la, CAST(saldo_inicial + (lc - la) * CASE WHEN naturaleza = 'A' THEN -1 ELSE 1 END AS {D})]) AS leido
  FROM may_heads h JOIN may_sum s ON s.doc_id = h.doc_id AND s.cuenta = h.cuenta) WHERE declarado <> leido""")
query("D8_ledger_declared_vs_read", "SELECT * FROM d8_may")(
    lambda t: dg.ledger_declared_vs_read(_heads(t), t.mayor_meses))
query("D8_bank_declared_vs_read", f"""
j AS (SELECT c.*, COALESCE(sd, 0) AS sd, COALESCE(sr, 0) AS sr, (SELECT arg_max(saldo, seq) FROM est_movs m
  WHERE m.doc_id = c.doc_id AND m.num_cuenta = c.num_cuenta AND saldo IS NOT NULL) AS ult
  FROM est_cuentas c LEFT JOIN est_sums s ON s.doc_id = c.doc_id AND s.num_cuenta = c.num_cuenta),
u AS (SELECT doc_id, unnest(['depositos', 'retiros', 'saldo_corte']) AS campo,
  unnest([depositos, retiros, saldo_corte]) AS de, unnest([sd, sr, ult]) AS le FROM j)
SELECT doc_id, campo, COUNT(*) FILTER (WHERE de <> le) AS difieren,
  COUNT(*) FILTER (WHERE de IS NULL OR le IS NULL) AS sin_cifra FROM u GROUP BY ALL""")(
    lambda t: dg.bank_declared_vs_read(t.est_cuentas, t.est_movs))
query("D9_month_quality", """
p AS (SELECT doc_id, cuenta, COUNT(*) AS n, COUNT(DISTINCT orden) AS k,
  COUNT(*) FILTER (WHERE cargos <> 0 OR abonos <> 0 OR saldo IS NOT NULL) AS imp,
  COUNT(*) FILTER (WHERE acum_cargos IS NOT NULL OR acum_abonos IS NOT NULL) AS acu FROM mayor_meses GROUP BY ALL),
h AS (SELECT doc_id, COUNT(*) AS cuentas, COUNT(saldo_final) AS con_saldo_final,
  COUNT(*) FILTER (WHERE naturaleza <> '') AS con_naturaleza FROM may_heads GROUP BY doc_id)
SELECT h.*, CAST(SUM(n) AS BIGINT) AS meses, MAX(n) AS max_por_cuenta, CAST(SUM(n - k) AS BIGINT) AS repetidos,
  CAST(SUM(imp) AS BIGINT) AS con_importe, CAST(SUM(acu) AS BIGINT) AS con_acumulado
FROM h JOIN p ON p.doc_id = h.doc_id GROUP BY ALL""")(
    lambda t: dg.month_quality(t.mayor_meses, _heads(t)))
view("d10_near", """SELECT DISTINCT doc_id, split_part(fila, ' ', 1) AS cuenta FROM f_ledger_monthly_balance
  WHERE veredicto = 'tolerancia'""")
view("d10_chain", "SELECT DISTINCT doc_id, cuenta FROM d8_may WHERE campo = 'saldo_final'")
query("D10_tolerated_vs_chain", """
SELECT doc_id, cuenta, 'solo_tolerancia' AS lado FROM (SELECT * FROM d10_near EXCEPT SELECT * FROM d10_chain)
UNION ALL SELECT doc_id, cuenta, 'solo_cadena' FROM (SELECT * FROM d10_chain EXCEPT SELECT * FROM d10_near)""")(
    lambda t: dg.tolerated_vs_chain(_heads(t), t.mayor_meses,
                                    suite(t, "mayor", "tolerated").filter("regla = 'saldo_mensual'")))
query("D11_reasons", r"""
SELECT estado, COALESCE(NULLIF(trim(regexp_replace(regexp_replace(motivo, '\d[\d,\.]*', 'N', 'g'),
  ':\s*[^;]+$', ': …')), ''), '(SIN MOTIVO)') AS motivo, COUNT(*) AS casos, COUNT(DISTINCT doc_id) AS documentos,
  CAST(SUM(evaluados) AS BIGINT) AS evaluados, CAST(SUM(aplicables) AS BIGINT) AS aplicables
FROM zr WHERE estado <> 'cuadra' GROUP BY ALL""")(
    lambda t: dg.reasons(everything(t, "results"), reason_template(F.col("motivo"))))

# ---------------------------------------------------------------------------- sinks
def _written(t, tables, pick):
    """Write the tables and hand back what a reader finds."""
    folder = f"{shared_dir(t.spark)}/out-{uuid.uuid4().hex}"
    sinks.write_tables(tables, folder)
    return t.spark.read.parquet(f"{folder}/{pick}")


query("S7_trial_sink", """
SELECT doc_id, seq, cuenta, nivel, cuenta_padre, naturaleza, nombre, saldo_ini_deudor, saldo_ini_acreedor, debe,
  haber, saldo_fin_deudor, saldo_fin_acreedor, es_acumulativa, EXISTS (SELECT 1 FROM zd_balanza d
  WHERE d.indice >= 0 AND d.doc_id = b.doc_id AND d.indice = b.seq) AS marcada FROM balanza b""")(
    lambda t: _written(t, {"balanza": sinks.trial_table(t.balanza, suite(t, "balanza", "discrepancies"))}, "balanza"))
_published: dict = {}


def checked(t, kind: str) -> dict:
    return sinks.validation_tables(suite(t, kind, "results"), suite(t, kind, "tolerated"), suite(t, kind, "discrepancies"))


_SINKS = {
    "polizas": lambda t: sinks.journal_tables(t.polizas, t.movimientos, t.cfdi, rj.entry_totals(t.movimientos), checked(t, "polizas")),
    "mayor": lambda t: sinks.ledger_tables(_heads(t), t.mayor_meses, rl.read_totals(t.mayor_meses), checked(t, "mayor")),
    "estado-cuenta": lambda t: sinks.bank_tables(t.est_meta, t.est_cuentas, t.est_movs, rb.read_totals(t.est_cuentas, t.est_movs),
                                                 checked(t, "estado-cuenta")),
}


def read_back(t, kind: str, name: str):
    """A table of a sink as its readers find it; the sink is published once per corpus."""
    key = (t.spark.sparkContext.applicationId, t.folder, kind)
    if key not in _published:
        _published[key] = f"{shared_dir(t.spark)}/out-{uuid.uuid4().hex}"
        sinks.publish(t.spark, _SINKS[kind](t), _published[key])
    return sinks.published(t.spark, _published[key], name)


def validation_sql(kind: str) -> str:
    """The validation table of a kind: what was checked, in words, with the first five tolerated cases."""
    k = _kv[kind]
    view(f"sv_near_{k}", " UNION ALL ".join(
        f"SELECT doc_id, {i} AS n_regla, fila, seq AS indice, subregla FROM f_{r} WHERE veredicto = 'tolerancia'" for i, r in enumerate(SUITES[kind], 1)))
    view(f"sv_names_{k}", f"""SELECT doc_id, n_regla, array_to_string((list(fila ORDER BY indice, fila, subregla))[1:5], ', ') AS nombres
      FROM sv_near_{k} GROUP BY doc_id, n_regla""")
    return f"""
SELECT r.doc_id, r.n_regla, regla, estado, aplicables, evaluados, exactas, COALESCE(NULLIF(concat_ws('; ',
  CASE WHEN exactas > 0 THEN {S('exactas')} || ' exacta' || CASE WHEN exactas <> 1 THEN 's' ELSE '' END END,
  CASE WHEN con_tolerancia > 0 THEN {S('con_tolerancia')} || ' dentro de tolerancia: ' || nombres END,
  CASE WHEN discrepancias > 0 THEN {S('discrepancias')} || ' con diferencia' END), ''), 'sin comprobaciones') AS detalle,
  motivo FROM zr_{k} r LEFT JOIN sv_names_{k} n ON n.doc_id = r.doc_id AND n.n_regla = r.n_regla"""


_S10 = """SELECT c.doc_id, c.seq, banco, rfc, periodo_ini, periodo_fin, c.num_cuenta, clabe, producto, moneda, saldo_inicial,
  depositos AS depositos_declarado, COALESCE(sd, 0) AS leido_depositos, retiros AS retiros_declarado,
  COALESCE(sr, 0) AS leido_retiros, saldo_corte FROM est_cuentas c LEFT JOIN est_meta m ON m.doc_id = c.doc_id
  LEFT JOIN est_sums s ON s.doc_id = c.doc_id AND s.num_cuenta = c.num_cuenta"""
view("s10_accounts", _S10)
for _name, _sink, _table, _sql in [
        ("S8_journal_sink", "polizas", "plana", O3_JOURNAL), ("S8_journal_heads", "polizas", "polizas", "SELECT * FROM o1_heads"),
        ("S8_journal_moves", "polizas", "movimientos", "SELECT * FROM movimientos"), ("S8_journal_invoices", "polizas", "cfdi", "SELECT * FROM cfdi"),
        ("S9_ledger_sink", "mayor", "plana", O3_LEDGER), ("S9_ledger_accounts", "mayor", "cuentas", "SELECT * FROM o2_heads"),
        ("S9_ledger_months", "mayor", "meses", "SELECT * FROM mayor_meses"),
        ("S10_bank_sink", "estado-cuenta", "cuentas", "SELECT * FROM s10_accounts"), ("S10_bank_moves", "estado-cuenta", "movimientos", "SELECT * FROM est_movs"),
        ("S10_bank_flat", "estado-cuenta", "plana", f"""SELECT m.*, {", ".join(sinks.BANK_HEAD)} FROM est_movs m LEFT JOIN (SELECT * FROM s10_accounts
          QUALIFY COUNT(*) OVER (PARTITION BY doc_id, num_cuenta) = 1) a ON a.doc_id = m.doc_id AND a.num_cuenta = m.num_cuenta""")]:
    query(_name, _sql)(lambda t, k=_sink, n=_table: read_back(t, k, n))
for _prefix, _sink in (("S8_journal", "polizas"), ("S9_ledger", "mayor"), ("S10_bank", "estado-cuenta")):
    query(f"{_prefix}_validation", validation_sql(_sink))(lambda t, k=_sink: read_back(t, k, "validacion"))
    query(f"{_prefix}_discrepancies", f"SELECT doc_id, n_regla, fila, subregla AS regla, esperado, obtenido FROM zd_{_kv[_sink]}")(
        lambda t, k=_sink: read_back(t, k, "discrepancias"))
query("S11_subledger_sink", "SELECT " + ", ".join(sinks.SUBLEDGER_COLUMNS) + " FROM aux_lleno")(
    lambda t: _written(t, {"auxiliar": sinks.subledger_table(_filled(t))}, "auxiliar"))
view("s12_near", """SELECT doc_id, 1 AS n_regla, fila, seq AS indice, subregla FROM f_journal_double_entry WHERE veredicto = 'tolerancia'
  UNION ALL SELECT doc_id, 2, fila, seq, subregla FROM f_journal_totals WHERE veredicto = 'tolerancia'""")
view("s12_names", """SELECT doc_id, n_regla, array_to_string((list(fila ORDER BY indice, fila, subregla))[1:5], ', ') AS nombres
  FROM s12_near GROUP BY doc_id, n_regla""")
query("S12_validation_sink", f"""
SELECT r.doc_id, r.n_regla, regla, estado, aplicables, evaluados, exactas, COALESCE(NULLIF(concat_ws('; ',
  CASE WHEN exactas > 0 THEN {S('exactas')} || ' exacta' || CASE WHEN exactas <> 1 THEN 's' ELSE '' END END,
  CASE WHEN con_tolerancia > 0 THEN {S('con_tolerancia')} || ' dentro de tolerancia: ' || nombres END,
  CASE WHEN discrepancias > 0 THEN {S('discrepancias')} || ' con diferencia' END), ''), 'sin comprobaciones') AS detalle,
  motivo FROM zr_polizas r LEFT JOIN s12_names n ON n.doc_id = r.doc_id AND n.n_regla = r.n_regla""")(
    lambda t: _written(t, {"reglas": sinks.validation_rules(suite(t, "polizas", "results"),
                                                            suite(t, "polizas", "tolerated")),
                           "discrepancias": sinks.validation_discrepancies(
                               suite(t, "polizas", "discrepancies"))}, "reglas"))
query("S12_validation_discrepancies",
      "SELECT doc_id, n_regla, fila, subregla AS regla, esperado, obtenido FROM zd")(
    lambda t: sinks.validation_discrepancies(everything(t, "discrepancies")))

# --------------------------------------------------------------------------- intake
_TABLES = {
    "polizas": lambda t: {"polizas": t.polizas, "movimientos": t.movimientos, "cfdi": t.cfdi},
    "auxiliar": lambda t: {"auxiliar": _filled(t)},
    "balanza": lambda t: {"balanza": t.balanza, "totales": t.totales},
    "estado-cuenta": lambda t: {"documento": t.est_meta, "cuentas": t.est_cuentas, "movimientos": t.est_movs},
    "mayor": lambda t: {"cuentas": _heads(t), "meses": t.mayor_meses, "balanza": t.par_balanza},
}
def intake_kinds(tables: dict) -> dict:
    return {kind: ({n: df.schema for n, df in own.items()}, next(iter(own)), lambda d, k=kind: RULES.rules(k, d)) for kind, own in tables.items()}


def _intake(t):
    """Every document of every kind arrives in two parts, in different files; some are broken, incomplete or empty.

    Documents 9000 lack a part, 9001 hold a record that cannot be read, 9002 have no row of their main table.
    """
    base = f"{shared_dir(t.spark)}/intake-{uuid.uuid4().hex}"
    tables = {k: make(t) for k, make in _TABLES.items()}
    rows = stage(reduce(lambda a, b: a.unionByName(b), [intake.as_inbox(k, own, parts=2) for k, own in tables.items()]))
    # a document whose rows all fall into one part has no other part to wait for
    rows = rows.join(rows.groupBy("tipo", "doc_id").agg(F.count_distinct("parte").alias("_n")), ["tipo", "doc_id"]).withColumn(
        "parte", F.when(F.col("_n") == 1, 0).otherwise(F.col("parte"))).withColumn("partes", F.col("_n").cast("int")).drop("_n")
    odd = [(k, 9000 + n, 0, parts, name, text, None) for k, own in tables.items() for n, parts, name, text in (
        (0, 3, next(iter(own)), "{}"), (1, 1, next(iter(own)), "{broken"), (2, 1, list(own)[-1] if len(own) > 1 else "otra", '{"doc_id": 9002}'))]
    rows = rows.unionByName(t.spark.createDataFrame(odd, intake.INBOX))
    rows.repartitionByRange(48, "parte", "tipo", "doc_id").write.parquet(f"{base}/inbox")
    kinds = intake_kinds(tables)
    late = t.spark.createDataFrame([(None, None, 0, 1, None, None, None)], intake.INBOX).withColumn("hora", F.current_timestamp() + F.expr("INTERVAL 2 HOURS"))
    for again in range(2):  # a later file without a document: what waited for a part has waited long enough
        if again:
            late.coalesce(1).write.mode("append").parquet(f"{base}/inbox")
        intake.run_intake(t.spark, f"{base}/inbox", kinds, f"{base}/out", f"{base}/checkpoint")
    return intake.job_log(t.spark, f"{base}/out")


query("I1_intake_stream", f"""
SELECT tipo, CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN fallan > 0 THEN 'con_discrepancias' ELSE 'listo' END AS estado, resumen FROM zc
UNION ALL SELECT tipo, 9001, 'error', 'un registro no se pudo leer' FROM (SELECT DISTINCT tipo FROM zc)
UNION ALL SELECT tipo, 9002, CASE WHEN tipo = 'auxiliar' THEN 'error' ELSE 'no_reconocido' END, CASE WHEN tipo = 'auxiliar' THEN 'un registro no se pudo leer' ELSE '' END
  FROM (SELECT DISTINCT tipo FROM zc)
UNION ALL SELECT tipo, 9000, 'error', 'llegaron 1 de 3 partes' FROM (SELECT DISTINCT tipo FROM zc)""")(_intake)
query("I2_retention_sweep", """
x AS (SELECT MAX(creado) - INTERVAL 15 DAY AS ahora FROM trabajos),
sal AS (SELECT id + 5 * (id % 2) AS id, tenant, creado FROM trabajos)
SELECT id, tenant, 'trabajo' AS que FROM trabajos, x WHERE creado < ahora - INTERVAL 30 MINUTE AND estado <> 'procesando'
UNION ALL SELECT s.id, s.tenant, 'salida' FROM sal s, x WHERE creado < ahora - INTERVAL 30 MINUTE
  AND NOT EXISTS (SELECT 1 FROM trabajos t WHERE t.id = s.id)
UNION ALL SELECT id, tenant, 'nunca' FROM trabajos WHERE FALSE""")(
    lambda t: intake.expired(
        t.trabajos, t.trabajos.select((F.col("id") + 5 * (F.col("id") % 2)).alias("id"), "tenant", "creado"),
        t.trabajos.select((F.col("creado") - F.expr("INTERVAL 15 DAYS")).alias("ahora"))))
query("I3_newest_jobs", """
SELECT id, tenant, estado, lugar FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant ORDER BY creado DESC, id)
  AS lugar FROM trabajos) WHERE lugar <= 50""")(
    lambda t: intake.newest(t.trabajos).select("id", "tenant", "estado", "lugar"))
query("I3_place_in_line", """
SELECT t.id, tenant, estado, COALESCE(pos, 0) AS posicion FROM trabajos t LEFT JOIN (SELECT id,
  RANK() OVER (ORDER BY creado) AS pos FROM trabajos WHERE estado = 'en_cola') q ON q.id = t.id""")(
    lambda t: intake.place_in_line(t.trabajos))
query("I3_job_of_tenant", "SELECT id, tenant, estado FROM trabajos WHERE id = 17 AND tenant = 't0'")(
    lambda t: intake.job_of_tenant(t.trabajos, 17, "t0").select("id", "tenant", "estado"))


# ------------------------------------------------------------------------- extension
def _folio_rule(d) -> Rule:
    """A user's own rule: the folio of an entry is seven times its number."""
    number, folio = F.col("poliza_id").cast(D), F.col("folio").cast(D) / 7
    return Rule("folio_de_poliza", d["polizas"].select(
        "doc_id", "seq", F.col("poliza_id").cast("string").alias("fila"), F.lit("folio").alias("subregla"), number.alias("esperado"),
        folio.cast(D).alias("obtenido"), compare(number, folio.cast(D)).alias("veredicto")))


def _extended(t):
    return RULES.with_rule("polizas", _folio_rule), _TABLES["polizas"](t)


query("U1_registered_rules", """SELECT doc_id, n_regla, regla, estado, aplicables, evaluados, exactas FROM zr_polizas
UNION ALL SELECT doc_id, 5, 'folio_de_poliza', 'cuadra', COUNT(*), COUNT(*), COUNT(*) FROM polizas GROUP BY doc_id""")(
    lambda t: (lambda r, d: r.results("polizas", d))(*_extended(t)).select("doc_id", "n_regla", "regla", "estado", "aplicables", "evaluados", "exactas"))
query("U1_registered_contract", "SELECT doc_id, regla FROM zr_polizas WHERE FALSE")(
    lambda t: (lambda r, d: r.violations("polizas", d))(*_extended(t)).select("doc_id", "regla"))
