"""Named queries of the validation rules, with independent checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.operators import rules_journal as rj
from cotejo.operators.verdict import rule_discrepancies, rule_results
from cotejo.plans.registry import query, view
from cotejo.session import stage

D = "DECIMAL(38,2)"
DISC = ["doc_id", "regla", "subregla", "indice", "fila", "esperado", "obtenido"]


def verdict_sql(a: str, b: str, when: str = "TRUE") -> str:
    return (f"CASE WHEN NOT ({when}) OR {a} IS NULL OR {b} IS NULL THEN NULL "
            f"WHEN {a} = {b} THEN 'exacto' WHEN abs({a} - {b}) <= 0.01 THEN 'tolerancia' "
            "ELSE 'falla' END")


def result_sql(rule: str, frame: str, motivo: str, motivo0: str = "NULL", *, counts: str = "",
               universe: str = "COUNT(*)", recalc: str = "FALSE", extra: str = "",
               never_fails: bool = False) -> str:
    """The counting of a case table, written for the checking engine."""
    gap = ("CASE WHEN evaluados < aplicables THEN CAST(aplicables - evaluados AS STRING) || ' de '"
           " || CAST(aplicables AS STRING) || ' casos no se pudieron comprobar' END")
    state = "'no_verificable'" if never_fails else "'falla'"
    disc = "CAST(0 AS BIGINT)" if never_fails else "n_mal"
    return f"""
SELECT g.doc_id AS doc_id, '{rule}' AS regla,
  CASE WHEN evaluados = 0 THEN 'no_verificable' WHEN n_mal > 0 THEN {state} ELSE 'cuadra' END AS estado,
  aplicables, evaluados, exactas, exactas - recal AS exactas_impresas,
  recal AS exactas_recalculadas, con_tolerancia, {disc} AS discrepancias,
  CASE WHEN evaluados = 0 THEN COALESCE(NULLIF({motivo0}, ''), {gap},
       'el documento no trajo ningun caso de esta regla')
       ELSE COALESCE(NULLIF({motivo}, ''), {gap}, '') END AS motivo
FROM (SELECT doc_id, CAST({universe} AS BIGINT) AS aplicables, COUNT(veredicto) AS evaluados,
  COUNT(*) FILTER (WHERE veredicto = 'exacto') AS exactas,
  COUNT(*) FILTER (WHERE veredicto = 'exacto' AND {recalc}) AS recal,
  COUNT(*) FILTER (WHERE veredicto = 'tolerancia') AS con_tolerancia,
  COUNT(*) FILTER (WHERE veredicto = 'falla') AS n_mal {', ' + counts if counts else ''}
  FROM {frame} GROUP BY doc_id) g {extra}"""


def disc_sql(rule: str, frame: str) -> str:
    return (f"SELECT doc_id, '{rule}' AS regla, subregla, CAST(seq AS BIGINT) AS indice, fila, "
            f"CAST(esperado AS {D}) AS esperado, CAST(obtenido AS {D}) AS obtenido "
            f"FROM {frame} WHERE veredicto = 'falla'")


def S(n: str) -> str:
    return f"CAST({n} AS STRING)"


def register_rule(code: str, name: str, view_name: str, frame_sql: str, build, motivo="NULL",
                  motivo0="NULL", **kw) -> None:
    """Two queries per rule: its results and its discrepancies."""
    view(f"f_{view_name}", frame_sql)
    view(f"r_{view_name}", result_sql(name, f"f_{view_name}", motivo, motivo0, **kw))
    view(f"d_{view_name}", disc_sql(name, f"f_{view_name}"))
    query(f"{code}_{view_name}", f"SELECT * FROM r_{view_name}")(
        lambda t: rule_results(build(t)))
    query(f"{code}_{view_name}_discrepancies", f"SELECT * FROM d_{view_name}")(
        lambda t: rule_discrepancies(build(t)))


# ------------------------------------------------------------------------- journal
view("pol_leidos", f"""SELECT doc_id, poliza_id, CAST(SUM(debe) AS {D}) AS ld,
  CAST(SUM(haber) AS {D}) AS lh, COUNT(*) AS n FROM movimientos GROUP BY doc_id, poliza_id""")

_inc = ("CASE WHEN n_inc > 0 THEN CAST(n_inc AS STRING) || ' de ' || CAST(aplicables AS STRING)"
        " || ' polizas no cerraron dentro de lo leido' END")
_vac = ("CASE WHEN n_vac > 0 THEN CAST(n_vac AS STRING) || ' de ' || CAST(aplicables AS STRING)"
        " || ' polizas no trajeron ningun movimiento' END")

register_rule(
    "V9", "partida_doble", "journal_double_entry",
    f"""SELECT p.doc_id, p.seq, CAST(p.poliza_id AS STRING) AS fila, 'partida_doble' AS subregla,
      ld AS esperado, lh AS obtenido, completa, n,
      {verdict_sql('ld', 'lh', 'completa')} AS veredicto
      FROM polizas p LEFT JOIN pol_leidos m ON m.doc_id = p.doc_id AND m.poliza_id = p.poliza_id""",
    lambda t: rj.double_entry(t.polizas, rj.entry_totals(t.movimientos)),
    motivo=f"concat_ws('; ', {_inc}, {_vac})",
    motivo0=f"CASE WHEN n_inc = aplicables THEN 'ninguna poliza cerro dentro de lo leido' "
            f"ELSE concat_ws('; ', {_inc}, {_vac}) END",
    counts="COUNT(*) FILTER (WHERE NOT completa) AS n_inc, "
           "COUNT(*) FILTER (WHERE completa AND n IS NULL) AS n_vac")

register_rule(
    "V10", "totales", "journal_totals",
    f"""SELECT p.doc_id, p.seq, CAST(p.poliza_id AS STRING) AS fila, 'totales_debe' AS subregla,
      ld AS esperado, total_debe AS obtenido, completa AND total_debe IS NOT NULL AS con,
      {verdict_sql('ld', 'total_debe', 'completa')} AS veredicto
      FROM polizas p LEFT JOIN pol_leidos m ON m.doc_id = p.doc_id AND m.poliza_id = p.poliza_id
      UNION ALL
      SELECT p.doc_id, p.seq, CAST(p.poliza_id AS STRING), 'totales_haber',
      lh, total_haber, completa AND total_debe IS NOT NULL,
      {verdict_sql('lh', 'total_haber', 'completa')}
      FROM polizas p LEFT JOIN pol_leidos m ON m.doc_id = p.doc_id AND m.poliza_id = p.poliza_id""",
    lambda t: rj.declared_totals(t.polizas, rj.entry_totals(t.movimientos)),
    motivo="CASE WHEN evaluados < aplicables THEN CAST((aplicables - evaluados) // 2 AS STRING) "
           "|| ' de ' || CAST(aplicables // 2 AS STRING) || "
           "' polizas no declaran totales o no cerraron dentro de lo leido' END",
    motivo0="CASE WHEN n_con = 0 THEN 'ninguna poliza declara totales dentro de lo leido' "
            "ELSE 'ninguna poliza con totales trajo movimientos' END",
    counts="COUNT(*) FILTER (WHERE con) AS n_con")

register_rule(
    "V11", "cfdi", "journal_invoices_attached",
    f"""SELECT c.doc_id, -1 AS seq, CASE WHEN uuid <> '' THEN uuid ELSE documento END AS fila,
      'cfdi' AS subregla, CAST(NULL AS {D}) AS esperado, CAST(NULL AS {D}) AS obtenido,
      CASE WHEN EXISTS (SELECT 1 FROM polizas p WHERE p.doc_id = c.doc_id
           AND p.poliza_id = c.poliza_id) THEN 'exacto' ELSE 'falla' END AS veredicto
      FROM cfdi c""",
    lambda t: rj.invoices_attached(t.cfdi, t.polizas))

register_rule(
    "V12", "cfdi_cruzado", "journal_invoices_crossed",
    f"""SELECT c.doc_id, -1 AS seq, CAST(c.poliza_id AS STRING) AS fila,
      'cfdi_cruzado' AS subregla, CAST(NULL AS {D}) AS esperado, CAST(NULL AS {D}) AS obtenido,
      uuid, CASE WHEN documento = '' OR COALESCE(descripcion, '') = '' THEN NULL
           WHEN strpos(descripcion, documento) > 0 THEN 'exacto' ELSE 'falla' END AS veredicto
      FROM cfdi c LEFT JOIN polizas p ON p.doc_id = c.doc_id AND p.poliza_id = c.poliza_id""",
    lambda t: rj.invoices_crossed(t.cfdi, t.polizas),
    motivo="CASE WHEN evaluados < aplicables THEN CAST(aplicables - evaluados AS STRING) || ' de '"
           " || CAST(aplicables AS STRING) || ' CFDI sin numero de documento con el que cruzar'"
           " || CASE WHEN n_sin > 0 THEN '; ' || CAST(n_sin AS STRING) || ' de ellos no traen folio"
           " fiscal, o sea son polizas manuales sin comprobante' ELSE '' END END",
    motivo0="'ni el CFDI ni la poliza traen un numero de documento con el que cruzarlos'",
    counts="COUNT(*) FILTER (WHERE uuid = '') AS n_sin")

query("A11_journal_read_totals",
      "SELECT doc_id, poliza_id, ld AS leido_debe, lh AS leido_haber, n AS n_movs FROM pol_leidos")(
    lambda t: rj.entry_totals(t.movimientos))

query("M7_journal_verified", """
v AS (SELECT p.doc_id, COUNT(*) AS polizas, COUNT(n) AS con_movs,
      COUNT(*) FILTER (WHERE ld = lh) AS iguales
      FROM polizas p LEFT JOIN pol_leidos m ON m.doc_id = p.doc_id AND m.poliza_id = p.poliza_id
      GROUP BY p.doc_id)
SELECT *, polizas >= 2 AND con_movs > 0 AND iguales * 10 >= con_movs * 9 AS verificado FROM v""")(
    lambda t: rj.journal_verified(t.polizas, rj.entry_totals(t.movimientos)))


# ----------------------------------------------------------------------- subledger
from cotejo.operators import rules_subledger as rs  # noqa: E402

view("aux_m", "SELECT * FROM auxiliar WHERE NOT es_subtotal")


def account_views(prefix: str, source: str) -> str:
    """A7 and A9 with plain windows, over the table ``source``."""
    view(f"{prefix}_chain", f"""SELECT *, ROW_NUMBER() OVER w AS rn, LAG(saldo) OVER w AS lag_s
      FROM {source} WHERE NOT es_subtotal WINDOW w AS (PARTITION BY doc_id, cuenta ORDER BY seq)""")
    view(f"{prefix}_votes", f"""SELECT doc_id, cuenta, COUNT(*) AS movs,
      COUNT(*) FILTER (WHERE ok AND abs(ant + debe - haber - saldo) <= 0.01) AS vd,
      COUNT(*) FILTER (WHERE ok AND abs(ant - debe + haber - saldo) <= 0.01) AS va,
      CAST(SUM(debe) AS {D}) AS suma_debe, CAST(SUM(haber) AS {D}) AS suma_haber,
      MAX(CASE WHEN rn = 1 THEN saldo_inicial_cuenta END) AS inicial,
      bool_or(saldo_origen = 'recalculado') AS con_recalculo
      FROM (SELECT *, ant IS NOT NULL AND saldo IS NOT NULL AND debe <> haber AS ok FROM
        (SELECT *, CASE WHEN rn = 1 THEN saldo_inicial_cuenta ELSE lag_s END AS ant
         FROM {prefix}_chain)) GROUP BY doc_id, cuenta""")
    view(f"{prefix}_subs", f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (
      PARTITION BY doc_id, cuenta ORDER BY seq) AS rn FROM {source} WHERE es_subtotal) WHERE rn = 1""")
    view(f"{prefix}_tally", f"""SELECT v.doc_id, v.cuenta, movs, inicial, suma_debe, suma_haber,
      con_recalculo, s.debe AS sub_debe, s.haber AS sub_haber, s.saldo AS sub_saldo,
      vd + CASE WHEN suma_debe <> suma_haber AND
        abs(inicial + suma_debe - suma_haber - s.saldo) <= 0.01 THEN 1 ELSE 0 END AS votos_d,
      va + CASE WHEN suma_debe <> suma_haber AND
        abs(inicial - suma_debe + suma_haber - s.saldo) <= 0.01 THEN 1 ELSE 0 END AS votos_a
      FROM {prefix}_votes v LEFT JOIN {prefix}_subs s ON s.doc_id = v.doc_id AND s.cuenta = v.cuenta""")
    view(f"{prefix}_acc", f"""SELECT doc_id, cuenta, movs, CAST(votos_d AS BIGINT) AS votos_d,
      CAST(votos_a AS BIGINT) AS votos_a, naturaleza, inicial, suma_debe, suma_haber,
      con_recalculo, sub_debe, sub_haber, sub_saldo,
      COALESCE(sub_debe = suma_debe AND sub_haber = suma_haber AND COALESCE(inicial +
        (suma_debe - suma_haber) * CASE WHEN naturaleza = 'A' THEN -1 ELSE 1 END = sub_saldo, TRUE),
        FALSE) AS anclada
      FROM (SELECT *, CASE WHEN votos_d = votos_a THEN '' WHEN votos_d > votos_a THEN 'D'
            ELSE 'A' END AS naturaleza FROM {prefix}_tally)""")
    return f"{prefix}_acc"


account_views("ax", "auxiliar")
query("A7_A9_subledger_accounts", "SELECT * FROM ax_acc")(lambda t: rs.accounts(t.auxiliar))

# A10 written as a plain per-account window.
view("ax_run", f"""SELECT m.*, naturaleza, inicial, anclada,
  SUM((debe - haber) * CASE WHEN naturaleza = 'A' THEN -1 ELSE 1 END) OVER w AS r
  FROM aux_m m JOIN ax_acc a ON a.doc_id = m.doc_id AND a.cuenta = m.cuenta
  WINDOW w AS (PARTITION BY m.doc_id, m.cuenta ORDER BY m.seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
view("ax_fill", f"""SELECT *, CASE WHEN saldo IS NULL AND anclada AND naturaleza <> ''
  THEN CAST(COALESCE(last_value(saldo - r IGNORE NULLS) OVER (PARTITION BY doc_id, cuenta
     ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), inicial) + r AS {D}) END AS nuevo
  FROM ax_run""")
_AUX = ("doc_id, seq, cuenta, nombre_cuenta, saldo_inicial_cuenta, folio, fecha, tipo_movimiento, "
        "documento, tercero, concepto, debe, haber, {s} AS saldo, es_subtotal, pagina, top, "
        "{o} AS saldo_origen")
view("aux_lleno", "SELECT " + _AUX.format(
    s="COALESCE(saldo, nuevo)",
    o="CASE WHEN nuevo IS NOT NULL THEN 'recalculado' ELSE saldo_origen END") + " FROM ax_fill"
    " UNION ALL SELECT " + _AUX.format(s="saldo", o="saldo_origen") +
    " FROM auxiliar WHERE es_subtotal")
account_views("af", "aux_lleno")


def _filled(t):
    return stage(rs.refill(t.auxiliar, stage(rs.accounts(t.auxiliar))))


query("A10_subledger_refill",
      "SELECT doc_id, seq, cuenta, saldo, saldo_origen FROM aux_lleno")(
    lambda t: _filled(t).select("doc_id", "seq", "cuenta", "saldo", "saldo_origen"))


def names_sql(source: str, col: str, where: str, order: str | None = None) -> str:
    """First five names per document, and how many there are."""
    return (f"SELECT doc_id, COUNT(*) AS n_nom, array_to_string((list({col} ORDER BY {order or col}))"
            f"[1:5], ', ') AS nombres FROM {source} WHERE {where} GROUP BY doc_id")


view("af_sin", names_sql("af_acc", "cuenta", "naturaleza = ''"))
view("af_chained", """SELECT m.*, a.naturaleza, CASE WHEN LAG(m.cuenta) OVER w = m.cuenta
  THEN LAG(m.saldo) OVER w ELSE saldo_inicial_cuenta END AS ant
  FROM aux_lleno m JOIN af_acc a ON a.doc_id = m.doc_id AND a.cuenta = m.cuenta
  WHERE NOT m.es_subtotal WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.seq)""")
_N = "CAST(aplicables AS STRING)"
register_rule(
    "V6", "saldo_corrido", "subledger_running_balance",
    f"""SELECT doc_id, seq, cuenta || ' ' || fecha AS fila, 'saldo_corrido' AS subregla,
      CAST(exp AS {D}) AS esperado, saldo AS obtenido, naturaleza, saldo_origen,
      {verdict_sql('exp', 'saldo', "naturaleza <> ''")} AS veredicto
      FROM (SELECT *, ant + (debe - haber) * CASE WHEN naturaleza = 'A' THEN -1 ELSE 1 END AS exp
            FROM af_chained)""",
    lambda t: (lambda full: rs.running_balance(full, rs.accounts(full)))(_filled(t)),
    counts="COUNT(*) FILTER (WHERE naturaleza = '') AS n_ind, "
           "COUNT(*) FILTER (WHERE naturaleza <> '' AND obtenido IS NULL) AS n_ileg",
    recalc="saldo_origen = 'recalculado'",
    extra="LEFT JOIN af_sin x ON x.doc_id = g.doc_id",
    motivo=f"""concat_ws('; ', CASE WHEN n_ileg > 0 THEN {S('n_ileg')} || ' de ' || {_N} ||
      ' movimientos no traen saldo legible en la capa de texto' END,
      CASE WHEN n_ind > 0 THEN {S('n_ind')} || ' de ' || {_N} || ' pertenecen a ' || {S('n_nom')} ||
      ' cuenta(s) cuyo saldo no revela de que lado corre: ' || nombres END,
      CASE WHEN aplicables - evaluados - n_ileg - n_ind > 0 THEN
      {S('aplicables - evaluados - n_ileg - n_ind')} || ' de ' || {_N} ||
      ' abren cadena y no tienen contra que encadenarse' END)""")

view("ax_sums", f"""SELECT doc_id, cuenta, CAST(SUM(debe) AS {D}) AS sd, CAST(SUM(haber) AS {D}) AS sh
  FROM aux_m GROUP BY doc_id, cuenta""")
register_rule(
    "V7", "subtotales", "subledger_subtotals",
    " UNION ALL ".join(
        f"""SELECT a.doc_id, a.seq, a.cuenta AS fila, 'subtotal_{s}' AS subregla, {c} AS esperado,
        {s} AS obtenido, {verdict_sql(c, s)} AS veredicto FROM auxiliar a LEFT JOIN ax_sums x
        ON x.doc_id = a.doc_id AND x.cuenta = a.cuenta WHERE a.es_subtotal"""
        for s, c in (("debe", "sd"), ("haber", "sh"))),
    lambda t: rs.subtotals(t.auxiliar))

register_rule(
    "V8", "ancla_recalculo", "subledger_refill_anchor",
    f"""SELECT doc_id, -1 AS seq, cuenta AS fila, 'ancla_recalculo' AS subregla,
      COALESCE(sub_debe, 0) AS esperado, suma_debe AS obtenido,
      CASE WHEN anclada THEN 'exacto' ELSE 'falla' END AS veredicto
      FROM af_acc WHERE con_recalculo""",
    lambda t: rs.refill_anchor(rs.accounts(_filled(t))))

view("ax_chained", """SELECT *, CASE WHEN LAG(cuenta) OVER w = cuenta THEN LAG(saldo) OVER w
  ELSE saldo_inicial_cuenta END AS ant FROM aux_m WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
query("A15_suspicious_pages", """
SELECT doc_id, pagina, CASE WHEN bool_or(COALESCE(abs(ant + debe - haber - saldo) > 0.01, FALSE))
  THEN 'el saldo corrido se rompe sin explicacion' ELSE 'dato ilegible en la capa de texto' END AS motivo
FROM ax_chained WHERE pagina <> 0 AND (saldo IS NULL OR abs(ant + debe - haber - saldo) > 0.01)
GROUP BY doc_id, pagina""")(lambda t: rs.suspicious_pages(t.auxiliar))
query("A15_suspicious_pages_by_nature", """
SELECT c.doc_id, pagina, CASE WHEN bool_or(COALESCE(abs(ant + s * (debe - haber) - saldo) > 0.01, FALSE))
  THEN 'el saldo corrido se rompe sin explicacion' ELSE 'dato ilegible en la capa de texto' END AS motivo
FROM ax_chained c JOIN (SELECT doc_id, cuenta, CASE WHEN naturaleza = 'A' THEN -1 ELSE 1 END AS s
  FROM ax_acc) a ON a.doc_id = c.doc_id AND a.cuenta = c.cuenta
WHERE pagina <> 0 AND (saldo IS NULL OR abs(ant + s * (debe - haber) - saldo) > 0.01)
GROUP BY c.doc_id, pagina""")(lambda t: rs.suspicious_pages(t.auxiliar, rs.accounts(t.auxiliar)))
query("M6_subledger_verified", """
v AS (SELECT doc_id, COUNT(*) AS movimientos,
  COUNT(*) FILTER (WHERE saldo IS NOT NULL AND ant IS NOT NULL) AS comprobadas,
  COUNT(*) FILTER (WHERE abs(ant + debe - haber - saldo) <= 0.01) AS buenas
  FROM ax_chained GROUP BY doc_id)
SELECT *, movimientos >= 5 AND comprobadas >= 5 AND buenas * 10 >= comprobadas * 9 AS verificado
FROM v""")(lambda t: rs.subledger_verified(t.auxiliar))
query("V24_balance_origins", """
SELECT doc_id, COUNT(*) FILTER (WHERE saldo_origen = 'impreso') AS impreso,
  COUNT(*) FILTER (WHERE saldo_origen = 'recalculado') AS recalculado,
  COUNT(*) FILTER (WHERE saldo_origen = 'sin_saldo') AS sin_saldo
FROM aux_lleno WHERE NOT es_subtotal GROUP BY doc_id""")(lambda t: rs.balance_origins(_filled(t)))

# -------------------------------------------------------------------- trial balance
from cotejo.operators import rules_trial as rt  # noqa: E402
from cotejo.functions.accounts import infer_schemes  # noqa: E402

register_rule(
    "V1", "renglon", "trial_row_identity",
    f"""SELECT doc_id, seq, cuenta AS fila, 'renglon' AS subregla, e AS esperado, o AS obtenido,
      {verdict_sql('e', 'o')} AS veredicto FROM (SELECT *,
      CAST(saldo_ini_deudor - saldo_ini_acreedor + debe - haber AS {D}) AS e,
      CAST(saldo_fin_deudor - saldo_fin_acreedor AS {D}) AS o FROM balanza)""",
    lambda t: rt.row_identity(t.balanza))
view("bal_kids", f"""SELECT doc_id, cuenta_padre, nivel, CAST(SUM(debe) AS {D}) AS kd,
  CAST(SUM(haber) AS {D}) AS kh FROM balanza WHERE cuenta_padre <> '' GROUP BY ALL""")
view("bal_named", "SELECT DISTINCT doc_id, cuenta_padre FROM bal_kids")
view("bal_pairs", """SELECT n.doc_id, n.cuenta_padre, b.seq, b.debe, b.haber,
  CASE WHEN b.seq IS NOT NULL THEN kd END AS kd, CASE WHEN b.seq IS NOT NULL THEN kh END AS kh
  FROM bal_named n LEFT JOIN (SELECT p.*, k.kd, k.kh FROM balanza p JOIN bal_kids k
    ON k.doc_id = p.doc_id AND k.cuenta_padre = p.cuenta AND k.nivel = p.nivel + 1) b
  ON b.doc_id = n.doc_id AND b.cuenta = n.cuenta_padre""")
view("bal_lost", """SELECT * FROM bal_named n WHERE NOT EXISTS (SELECT 1 FROM balanza b
  WHERE b.doc_id = n.doc_id AND b.cuenta = n.cuenta_padre)""")
view("bal_lost_names", names_sql("bal_lost", "cuenta_padre", "TRUE"))
register_rule(
    "V2", "jerarquia", "trial_hierarchy",
    " UNION ALL ".join(
        f"""SELECT doc_id, seq, cuenta_padre AS fila, 'jerarquia_{s}' AS subregla, {k} AS esperado,
        {s} AS obtenido, {verdict_sql(k, s)} AS veredicto FROM bal_pairs"""
        for s, k in (("debe", "kd"), ("haber", "kh"))),
    lambda t: rt.hierarchy(t.balanza),
    extra="LEFT JOIN bal_lost_names x ON x.doc_id = g.doc_id",
    motivo=f"CASE WHEN n_nom > 0 THEN {S('n_nom')} || ' cuenta(s) padre que alguna fila declara "
           "no aparecen en el documento: ' || nombres END")
view("bal_base", f"""SELECT doc_id, CAST(SUM(debe) AS {D}) AS sd, CAST(SUM(haber) AS {D}) AS sh
  FROM balanza WHERE nivel = 1 GROUP BY doc_id""")
view("bal_leaves", f"""SELECT doc_id, CAST(SUM(debe) AS {D}) AS sd, CAST(SUM(haber) AS {D}) AS sh
  FROM balanza WHERE NOT es_acumulativa GROUP BY doc_id""")
for _suffix, _base, _kind in (("", "bal_base", "nivel_1"), ("_leaves", "bal_leaves", "no_acumulativas")):
    register_rule(
        "V3", "totales", "trial_totals" + _suffix,
        " UNION ALL ".join(
            f"""SELECT b.doc_id, -1 AS seq, 'Totales' AS fila, 'totales_{s}' AS subregla,
            {c} AS esperado, {s} AS obtenido, {verdict_sql(c, s)} AS veredicto
            FROM {_base} b LEFT JOIN totales t ON t.doc_id = b.doc_id"""
            for s, c in (("debe", "sd"), ("haber", "sh"))),
        lambda t, k=_kind: rt.printed_totals(t.balanza, t.totales, k))
    register_rule(
        "V4", "partida_doble", "trial_double_entry" + _suffix,
        f"""SELECT b.doc_id, -1 AS seq, 'Totales' AS fila, 'partida_doble' AS subregla,
          sd AS esperado, sh AS obtenido, ex, {verdict_sql('sd', 'sh', 'ex')} AS veredicto
          FROM {_base} b LEFT JOIN (SELECT doc_id, abs(debe - haber) <= 0.01 AS ex FROM totales) t
          ON t.doc_id = b.doc_id""",
        lambda t, k=_kind: rt.double_entry(t.balanza, t.totales, k),
        motivo0="CASE WHEN n_ex = 0 THEN 'el documento no la declara: su fila de totales no cuadra "
                "debe contra haber' ELSE 'sin filas contra las que sumar' END",
        counts="COUNT(*) FILTER (WHERE ex) AS n_ex")
query("V5_trial_rule_parameters", """
SELECT d.doc_id, COALESCE(abs(debe - haber) <= 0.01, TRUE) AS exige_partida_doble
FROM (SELECT DISTINCT doc_id FROM balanza) d LEFT JOIN totales t ON t.doc_id = d.doc_id""")(
    lambda t: rt.double_entry_required(t.totales, t.balanza))
query("V24_nature_origins", """
SELECT doc_id, COUNT(*) FILTER (WHERE naturaleza_origen = 'explicita') AS explicita,
  COUNT(*) FILTER (WHERE naturaleza_origen = 'derivada') AS derivada,
  COUNT(*) FILTER (WHERE naturaleza_origen = 'heredada') AS heredada,
  COUNT(*) FILTER (WHERE naturaleza_origen = 'sin_determinar') AS sin_determinar
FROM balanza GROUP BY doc_id""")(lambda t: rt.nature_origins(t.balanza))

# A1/A2: the marker is read off each catalogue with scalar subqueries.
view("cat_doc", """SELECT doc_id, bool_or(strpos(cuenta, '-') > 0) AS dash,
  bool_and(regexp_full_match(cuenta, '[0-9]+')) AS dig, MIN(length(cuenta)) AS lo,
  MAX(length(cuenta)) AS hi, COUNT(DISTINCT right(cuenta, 3)) AS k,
  MIN(TRY_CAST(right(cuenta, 3) AS INT)) AS mn, MAX(TRY_CAST(right(cuenta, 3) AS INT)) AS mx
  FROM catalogo WHERE cuenta <> '' GROUP BY doc_id""")
view("cat_mark", """SELECT *, COALESCE(NOT dash AND dig AND lo = hi AND hi > 3 AND k BETWEEN 2 AND 9
  AND mn = 1 AND mx = k, FALSE) AS m FROM cat_doc""")
view("cat_level", """SELECT c.doc_id, CAST(right(cuenta, 3) AS INT) AS nv,
  MAX(greatest(1, length(rtrim(left(cuenta, length(cuenta) - 3), '0')))) AS w
  FROM catalogo c JOIN cat_mark k ON k.doc_id = c.doc_id AND k.m GROUP BY c.doc_id, nv""")
view("cat_width", """SELECT a.doc_id, a.nv, MAX(b.w + a.nv - b.nv) AS ancho FROM cat_level a
  JOIN cat_level b ON b.doc_id = a.doc_id AND b.nv <= a.nv GROUP BY a.doc_id, a.nv""")
query("A1_account_schemes", """
SELECT k.doc_id, CASE WHEN dash THEN '-' ELSE '' END AS separador,
  COALESCE((SELECT string_agg(CAST(ancho AS STRING), ',' ORDER BY nv) FROM cat_width w
            WHERE w.doc_id = k.doc_id), '') AS anchos,
  CASE WHEN m THEN hi - 3 END AS marca_ini, CASE WHEN m THEN hi END AS marca_fin,
  CASE WHEN NOT dash AND dig AND lo = hi THEN hi ELSE 0 END AS largo FROM cat_mark k""")(
    lambda t: infer_schemes(t.catalogo).select(
        "doc_id", "separador",
        F.array_join(F.col("anchos").cast("array<string>"), ",").alias("anchos"),
        F.col("marca_ini").cast("bigint").alias("marca_ini"),
        F.col("marca_fin").cast("bigint").alias("marca_fin"), F.col("largo").cast("bigint").alias("largo")))
view("cat_parts", """SELECT c.doc_id, c.seq, c.cuenta, k.m, k.hi, string_split(cuenta, '-') AS p,
  string_split(regexp_replace(cuenta, '(-0+)+$', ''), '-') AS s,
  TRY_CAST(right(cuenta, 3) AS INT) AS nv, w.ancho
  FROM catalogo c JOIN cat_mark k ON k.doc_id = c.doc_id LEFT JOIN cat_width w
  ON w.doc_id = c.doc_id AND k.m AND w.nv = TRY_CAST(right(cuenta, 3) AS INT) - 1""")
query("A2_levels_and_parents", """
SELECT doc_id, seq, cuenta, CAST(CASE WHEN m THEN greatest(nv, 1) ELSE len(s) END AS BIGINT) AS nivel,
  CASE WHEN m THEN CASE WHEN nv <= 1 THEN '' ELSE
         rpad(left(left(cuenta, hi - 3), ancho), CAST(hi - 3 AS INT), '0') || lpad(CAST(nv - 1 AS STRING), 3, '0') END
       WHEN len(s) <= 1 THEN '' WHEN len(s) = len(p) THEN array_to_string(p[1:len(s) - 1], '-')
       ELSE array_to_string(p[1:len(s) - 1], '-') || '-' ||
            regexp_replace(array_to_string(p[len(s):], '-'), '[^-]', '0', 'g') END AS cuenta_padre
FROM cat_parts""")(
    lambda t: rt.levels_and_parents(t.catalogo).select(
        "doc_id", "seq", "cuenta", F.col("nivel").cast("bigint").alias("nivel"), "cuenta_padre"))


def nature_views(prefix: str, d: str, h: str) -> str:
    view(f"{prefix}_own", f"""SELECT doc_id, cuenta, cuenta AS c3, regexp_extract(cuenta, '^[0-9]+-[0-9]+') AS c2,
      left(cuenta, 3) AS c1,
      CASE WHEN naturaleza IN ('D', 'A') THEN naturaleza WHEN debe = haber THEN ''
        WHEN abs(saldo_inicial + {d} - {h} - saldo_final) <= 0.01 THEN 'D'
        WHEN abs(saldo_inicial - {d} + {h} - saldo_final) <= 0.01 THEN 'A' ELSE '' END AS own,
      naturaleza IN ('D', 'A') AS ex FROM crudas""")
    view(f"{prefix}_nat", f"""SELECT o.doc_id, o.cuenta,
      CASE WHEN o.own <> '' THEN o.own ELSE COALESCE(NULLIF(p2.own, ''), NULLIF(p1.own, ''), '') END AS nat,
      CASE WHEN o.ex THEN 'explicita' WHEN o.own <> '' THEN 'derivada'
        WHEN COALESCE(NULLIF(p2.own, ''), NULLIF(p1.own, '')) IS NOT NULL THEN 'heredada'
        ELSE 'sin_determinar' END AS origen
      FROM {prefix}_own o
      LEFT JOIN {prefix}_own p2 ON p2.doc_id = o.doc_id AND o.c2 <> '' AND p2.cuenta = o.c2 AND o.c2 <> o.cuenta
      LEFT JOIN {prefix}_own p1 ON p1.doc_id = o.doc_id AND p1.cuenta = o.c1 AND o.c1 <> o.cuenta""")
    return f"{prefix}_nat"


nature_views("nr", "debe", "haber")
nature_views("ns", "haber", "debe")
query("A5_A6_trial_natures", "SELECT * FROM nr_nat")(lambda t: rt.natures(t.crudas))
query("M10_rows_flipped_by_swap", """
SELECT a.doc_id, COUNT(*) FILTER (WHERE a.nat <> b.nat) AS filas_afectadas
FROM nr_nat a JOIN ns_nat b ON b.doc_id = a.doc_id AND b.cuenta = a.cuenta GROUP BY a.doc_id""")(
    lambda t: rt.flipped_by_swap(t.crudas))
query("A3_A4_trial_rows", f"""
SELECT c.doc_id, c.seq, c.cuenta, CAST(len(string_split(c.cuenta, '-')) AS BIGINT) AS nivel,
  CASE WHEN c.cuenta LIKE '%-%' THEN regexp_replace(c.cuenta, '-[0-9]+$', '') ELSE '' END AS cuenta_padre,
  n.nat AS naturaleza, c.nombre,
  CASE WHEN nat = 'A' THEN 0 ELSE saldo_inicial END AS saldo_ini_deudor,
  CASE WHEN nat = 'A' THEN saldo_inicial ELSE 0 END AS saldo_ini_acreedor, debe, haber,
  CASE WHEN nat = 'A' THEN 0 ELSE saldo_final END AS saldo_fin_deudor,
  CASE WHEN nat = 'A' THEN saldo_final ELSE 0 END AS saldo_fin_acreedor,
  EXISTS (SELECT 1 FROM crudas k WHERE k.doc_id = c.doc_id AND k.cuenta <> c.cuenta
          AND regexp_replace(k.cuenta, '-[0-9]+$', '') = c.cuenta) AS es_acumulativa,
  n.origen AS naturaleza_origen
FROM crudas c JOIN nr_nat n ON n.doc_id = c.doc_id AND n.cuenta = c.cuenta""")(
    lambda t: rt.resolve(t.crudas).withColumn("nivel", F.col("nivel").cast("bigint")))
_SIGNED_OK = ("debe = haber OR abs(saldo_inicial + {d} - {h} - saldo_final) <= 0.01 "
              "OR abs(saldo_inicial - {d} + {h} - saldo_final) <= 0.01")
for _n, _d, _h in (("M5_trial_verified", "debe", "haber"), ("M5_trial_verified_swapped", "haber", "debe")):
    query(_n, f"""
    v AS (SELECT doc_id, COUNT(*) AS filas, COUNT(*) FILTER (WHERE {_SIGNED_OK.format(d=_d, h=_h)}) AS buenas,
      FALSE AS mes_malo FROM crudas GROUP BY doc_id)
    SELECT *, filas >= 5 AND buenas * 10 >= filas * 9 AS verificado FROM v""")(
        lambda t, s=_d == "haber": rt.trial_verified(t.crudas, swapped=s))
query("M5_trial_verified_split", """
v AS (SELECT doc_id, COUNT(*) AS filas, COUNT(*) FILTER (WHERE abs(saldo_ini_deudor -
  saldo_ini_acreedor + debe - haber - saldo_fin_deudor + saldo_fin_acreedor) <= 0.01) AS buenas,
  FALSE AS mes_malo FROM balanza GROUP BY doc_id)
SELECT *, filas >= 5 AND buenas * 10 >= filas * 9 AS verificado FROM v""")(
    lambda t: rt.trial_verified(t.balanza))
query("M9_trial_orientation", """
SELECT doc_id, NOT (COUNT(*) >= 5 AND COUNT(*) FILTER (WHERE abs(saldo_ini_deudor -
  saldo_ini_acreedor + haber - debe - saldo_fin_deudor + saldo_fin_acreedor) <= 0.01) * 10
  >= COUNT(*) * 9) AS orientada FROM balanza GROUP BY doc_id""")(lambda t: rt.oriented(t.balanza))

# ---------------------------------------------------------------------- bank statement
from cotejo.operators import rules_bank as rb  # noqa: E402

register_rule(
    "V13", "resumen", "bank_summary_identity",
    f"""SELECT doc_id, -1 AS seq, trim('resumen ' || num_cuenta) AS fila, 'resumen' AS subregla,
      CAST(saldo_inicial + depositos - retiros AS {D}) AS esperado, saldo_corte AS obtenido,
      {verdict_sql('(saldo_inicial + depositos - retiros)', 'saldo_corte')} AS veredicto
      FROM est_cuentas""",
    lambda t: rb.summary_identity(t.est_cuentas),
    motivo=f"CASE WHEN evaluados < aplicables THEN {S('aplicables - evaluados')} || ' de ' || {_N} || "
           "' cuenta(s) no traen el resumen completo y quedaron sin comprobar' END")
view("est_sums", f"""SELECT doc_id, num_cuenta, CAST(SUM(deposito) AS {D}) AS sd,
  CAST(SUM(retiro) AS {D}) AS sr FROM est_movs GROUP BY doc_id, num_cuenta""")
register_rule(
    "V14", "resumen_movimientos", "bank_summary_against_moves",
    " UNION ALL ".join(
        f"""SELECT c.doc_id, -1 AS seq, trim('resumen ' || c.num_cuenta) AS fila,
        'resumen_{f}' AS subregla, COALESCE({s}, 0) AS esperado, {f} AS obtenido,
        {verdict_sql(f'COALESCE({s}, 0)', f, 'depositos IS NOT NULL AND retiros IS NOT NULL')} AS veredicto
        FROM est_cuentas c LEFT JOIN est_sums m ON m.doc_id = c.doc_id AND m.num_cuenta = c.num_cuenta"""
        for f, s in (("depositos", "sd"), ("retiros", "sr"))),
    lambda t: rb.summary_against_moves(t.est_cuentas, t.est_movs),
    motivo=f"CASE WHEN evaluados < aplicables THEN {S('(aplicables - evaluados) // 2')} || ' de ' || "
           f"{S('aplicables // 2')} || ' cuenta(s) no declaran depositos y retiros propios' END")
view("est_open", """SELECT doc_id, num_cuenta, CASE WHEN COUNT(*) = 1 THEN MAX(saldo_inicial) END AS ini
  FROM est_cuentas GROUP BY doc_id, num_cuenta""")
register_rule(
    "V15", "saldo_corrido", "bank_running_balance",
    f"""SELECT doc_id, seq, 'dia ' || dia AS fila, 'saldo_corrido' AS subregla,
      CAST(ant + deposito - retiro AS {D}) AS esperado, saldo AS obtenido,
      {verdict_sql('(ant + deposito - retiro)', 'saldo')} AS veredicto
      FROM (SELECT m.*, CASE WHEN ROW_NUMBER() OVER w = 1 THEN ini ELSE LAG(saldo) OVER w END AS ant
        FROM est_movs m LEFT JOIN est_open o ON o.doc_id = m.doc_id AND o.num_cuenta = m.num_cuenta
        WINDOW w AS (PARTITION BY m.doc_id, m.num_cuenta ORDER BY m.seq))""",
    lambda t: rb.running_balance(t.est_cuentas, t.est_movs),
    counts="COUNT(*) FILTER (WHERE obtenido IS NULL) AS n_ileg",
    motivo=f"""concat_ws('; ', CASE WHEN n_ileg > 0 THEN {S('n_ileg')} || ' de ' || {_N} ||
      ' movimientos no traen saldo con el que encadenar' END,
      CASE WHEN aplicables - evaluados - n_ileg > 0 THEN {S('aplicables - evaluados - n_ileg')}
      || ' de ' || {_N} || ' abren cadena y no tienen contra que encadenarse' END)""")
view("est_tot", f"""SELECT doc_id, CASE WHEN COUNT(*) = COUNT(saldo_inicial) THEN CAST(SUM(saldo_inicial) AS {D}) END AS si,
  CASE WHEN COUNT(*) = COUNT(saldo_corte) THEN CAST(SUM(saldo_corte) AS {D}) END AS sc
  FROM est_cuentas GROUP BY doc_id""")
register_rule(
    "V16", "total_declarado", "bank_declared_total",
    " UNION ALL ".join(
        f"""SELECT m.doc_id, -1 AS seq, 'TOTAL' AS fila, 'total_{c}' AS subregla, {s} AS esperado,
        total_{c} AS obtenido, {verdict_sql(s, f'total_{c}')} AS veredicto
        FROM est_meta m LEFT JOIN est_tot t ON t.doc_id = m.doc_id"""
        for c, s in (("saldo_inicial", "si"), ("saldo_corte", "sc"))),
    lambda t: rb.declared_total(t.est_cuentas, t.est_meta),
    counts="COUNT(obtenido) AS n_dec",
    motivo="CASE WHEN evaluados < 2 THEN 'el documento solo imprime uno de los dos totales "
           "(saldo inicial y saldo al corte)' END",
    motivo0="CASE WHEN n_dec = 0 THEN 'el documento no imprime una fila TOTAL con la que cruzar la suma "
            "de los saldos por cuenta' ELSE 'el documento imprime una fila TOTAL pero alguna cuenta no "
            "trae el saldo con el que sumarla' END")
query("A13_bank_read_totals", """
SELECT COALESCE(c.doc_id, m.doc_id) AS doc_id, COALESCE(c.num_cuenta, m.num_cuenta) AS num_cuenta,
  COALESCE(sd, 0) AS leido_depositos, COALESCE(sr, 0) AS leido_retiros
FROM (SELECT DISTINCT doc_id, num_cuenta FROM est_cuentas) c FULL JOIN est_sums m
  ON m.doc_id = c.doc_id AND m.num_cuenta = c.num_cuenta""")(
    lambda t: rb.read_totals(t.est_cuentas, t.est_movs))
query("A14_bank_moves_of_account",
      "SELECT doc_id, seq, deposito, retiro, saldo FROM est_movs WHERE num_cuenta = '100008'")(
    lambda t: rb.moves_of_account(t.est_movs, "100008").select(
        "doc_id", "seq", "deposito", "retiro", "saldo"))

# ---------------------------------------------------------------------- general ledger
from cotejo.operators import rules_ledger as rl  # noqa: E402

view("may_votes", """SELECT doc_id, cuenta,
  COUNT(*) FILTER (WHERE ok AND abs(ant + cargos - abonos - saldo) <= 0.01) AS vd,
  COUNT(*) FILTER (WHERE ok AND abs(ant - cargos + abonos - saldo) <= 0.01) AS va
  FROM (SELECT *, ant IS NOT NULL AND saldo IS NOT NULL AND cargos <> abonos AS ok FROM
    (SELECT m.*, CASE WHEN ROW_NUMBER() OVER w = 1 THEN saldo_inicial ELSE LAG(saldo) OVER w END AS ant
     FROM mayor_meses m JOIN mayor_base b ON b.doc_id = m.doc_id AND b.cuenta = m.cuenta
     WINDOW w AS (PARTITION BY m.doc_id, m.cuenta ORDER BY m.orden, m.seq))) GROUP BY doc_id, cuenta""")
view("may_nat", """SELECT b.doc_id, b.cuenta, COALESCE(vd, 0) AS votos_d, COALESCE(va, 0) AS votos_a,
  CASE WHEN saldo_inicial IS NULL OR COALESCE(vd, 0) = COALESCE(va, 0) THEN ''
       WHEN vd > va THEN 'D' ELSE 'A' END AS naturaleza
  FROM mayor_base b LEFT JOIN may_votes v ON v.doc_id = b.doc_id AND v.cuenta = b.cuenta""")
view("may_heads", """SELECT b.*, m.saldo AS saldo_final, m.acum_cargos AS total_cargos,
  m.acum_abonos AS total_abonos, naturaleza FROM mayor_base b
  JOIN may_nat n ON n.doc_id = b.doc_id AND n.cuenta = b.cuenta
  LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, cuenta ORDER BY orden DESC, seq) AS rn
    FROM mayor_meses) m ON m.doc_id = b.doc_id AND m.cuenta = b.cuenta AND rn = 1""")


_closed: dict = {}


def _heads(t):
    """The closed accounts: a stage table, since every ledger rule and sink reads them."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _closed:
        _closed[key] = stage(rl.close_accounts(t.mayor_base, t.mayor_meses))
    return _closed[key]


query("A8_ledger_natures", "SELECT * FROM may_nat")(lambda t: rl.natures(t.mayor_base, t.mayor_meses))
query("R18_ledger_account_close", "SELECT * FROM may_heads")(_heads)
query("A12_ledger_read_totals", f"""SELECT doc_id, cuenta, CAST(SUM(cargos) AS {D}) AS leido_cargos,
  CAST(SUM(abonos) AS {D}) AS leido_abonos FROM mayor_meses GROUP BY doc_id, cuenta""")(
    lambda t: rl.read_totals(t.mayor_meses))
view("may_lost", names_sql("may_heads", "cuenta", "naturaleza = ''"))
_may_text = (f"CASE WHEN n_nom > 0 THEN {S('n_nom')} || ' cuenta(s) sin naturaleza determinable "
             "(sus meses no la revelan): ' || nombres END")
register_rule(
    "V17", "saldo_mensual", "ledger_monthly_balance",
    f"""SELECT doc_id, seq, cuenta || ' ' || periodo AS fila, 'saldo_mensual' AS subregla,
      CAST(e AS {D}) AS esperado, saldo AS obtenido, {verdict_sql('e', 'saldo')} AS veredicto FROM
      (SELECT *, ant + (cargos - abonos) * CASE WHEN naturaleza = 'A' THEN -1 ELSE 1 END AS e FROM
       (SELECT m.*, h.naturaleza, CASE WHEN LAG(m.cuenta) OVER w = m.cuenta THEN LAG(m.saldo) OVER w
        ELSE h.saldo_inicial END AS ant FROM mayor_meses m JOIN may_heads h
        ON h.doc_id = m.doc_id AND h.cuenta = m.cuenta
        WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.seq)))""",
    lambda t: rl.monthly_balance(_heads(t), t.mayor_meses),
    extra="LEFT JOIN may_lost x ON x.doc_id = g.doc_id", motivo=_may_text, motivo0=_may_text)
register_rule(
    "V18", "acumulados", "ledger_accumulated",
    " UNION ALL ".join(
        f"""SELECT doc_id, seq, cuenta || ' ' || periodo AS fila, 'acum_{c}' AS subregla,
        CAST(e AS {D}) AS esperado, acum_{c} AS obtenido, {verdict_sql('e', f'acum_{c}')} AS veredicto
        FROM (SELECT *, COALESCE(last_value(acum_{c} IGNORE NULLS) OVER (PARTITION BY doc_id, cuenta
          ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {c} AS e
          FROM mayor_meses)""" for c in ("cargos", "abonos")),
    lambda t: rl.accumulated(t.mayor_meses),
    motivo=f"CASE WHEN evaluados < aplicables THEN {S('aplicables - evaluados')} || ' de ' || {_N} || "
           "' acumulados no vienen legibles en el documento' END")
view("f_ledger_against_trial_names", names_sql("f_ledger_against_trial", "fila", "veredicto = 'falla'", "seq"))
register_rule(
    "V19", "cruce_balanza", "ledger_against_trial",
    f"""SELECT h.doc_id, h.seq, h.cuenta AS fila, 'cruce_balanza' AS subregla,
      saldo_final AS esperado, otro AS obtenido,
      CASE WHEN saldo_final = otro THEN 'exacto' WHEN saldo_final <> otro THEN 'falla' END AS veredicto
      FROM may_heads h LEFT JOIN (SELECT doc_id, replace(cuenta, '-', '') AS k,
        saldo_fin_deudor - saldo_fin_acreedor AS otro FROM par_balanza) b
      ON b.doc_id = h.doc_id AND b.k = h.cuenta""",
    lambda t: rl.against_trial(_heads(t), t.par_balanza),
    never_fails=True, extra="LEFT JOIN f_ledger_against_trial_names x ON x.doc_id = g.doc_id",
    motivo=f"""CASE WHEN n_mal > 0 THEN {S('exactas')} || ' de ' || {S('evaluados')} || ' coinciden; ' ||
      {S('n_mal')} || ' difieren: ' || nombres || '. Sin regla confirmada para decidir si es esperado'
      WHEN evaluados < aplicables THEN {S('aplicables - evaluados')} || ' de ' || {_N} ||
      ' cuentas del mayor no aparecen en la balanza recibida' END""",
    motivo0="'ninguna cuenta del mayor aparece en la balanza recibida'")
query("R19_ledger_without_amounts", """
SELECT doc_id, COUNT(*) AS meses, 'se detectaron ' || CAST(COUNT(*) AS STRING) || ' renglones de mes y '
  || 'ninguno trae cargos, abonos ni saldo; el documento no parece un libro mayor' AS motivo
FROM may_zero GROUP BY doc_id HAVING bool_and(COALESCE(cargos, 0) = 0 AND COALESCE(abonos, 0) = 0
  AND COALESCE(saldo, 0) = 0 AND COALESCE(acum_cargos, 0) = 0 AND COALESCE(acum_abonos, 0) = 0)""")(
    lambda t: rl.without_amounts(t.may_zero))
