"""Named queries of the chain from words to verdict of trial balances, and of the formats learned from it.

The checking SQL starts from the typed rows that were printed and the mapping found by enumeration.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from cotejo.functions.accounts import infer_schemes, number_shape
from cotejo.operators import layout as ly
from cotejo.operators import mapping as mp
from cotejo.operators import rules_trial as rt
from cotejo.operators import templates as tp
from cotejo.operators import trial_chain as ch
from cotejo.operators.suites import suite_discrepancies
from cotejo.operators.verdict import TOLERANCE, coverage
from cotejo.plans.queries_layout import stored
from cotejo.plans.queries_mapping import FORMS, REQUIRED, TRIAL_MOST, _vals, fits, trial_candidates, trial_cells, trial_layout, trial_mappings
from cotejo.plans.queries_rules import D
from cotejo.plans.queries_text import norm_sql
from cotejo.plans.registry import VIEWS, query, view
from cotejo.plans.relations import M, TRIAL_PRINTS
from cotejo.session import shared_dir

c = F.col


def tenant(doc):
    return F.concat(F.lit("t"), (doc % 4).cast("string"))


# ------------------------------------------------------------------------------- Spark side
@stored("trial_readings")
def readings(t):
    """Document, tenant and the fingerprint of its layout: every document with a table, read or not."""
    shapes = number_shape(trial_cells(t).filter("idx = 0").select("doc_id", F.trim("texto").alias("cuenta")))
    return ly.fingerprint(trial_layout(t), shapes).select("doc_id", tenant(c("doc_id")).alias("tenant_id"), "huella")


@stored("trial_read")
def read(t):
    """Raw rows, typed rows and totals by the mappings that the search found."""
    return ch.read_trials(trial_cells(t), trial_mappings(t).select("doc_id", "asigna"))


@stored("trial_results")
def results(t):
    _, balanza, totales = read(t)
    return ch.verdicts(balanza, totales)


@stored("trial_built")
def built(t):
    """The template every read document would leave."""
    raw, balanza, totales = read(t)
    found = trial_mappings(t).filter("mapeo IS NOT NULL")
    flips = rt.flipped_by_swap(raw)
    r = readings(t).join(found.select("doc_id", "forma", c("asigna").alias("mapeo"), "verificado_por", c("orientada").alias("orientacion_verificada")), "doc_id") \
        .join(flips.select("doc_id", c("filas_afectadas").alias("_n")), "doc_id", "left") \
        .withColumns({"tipo": F.lit("balanza"), "estrategia": F.lit("pdf_text"),
                      "filas_afectadas": F.when(c("orientacion_verificada"), 0).otherwise(F.coalesce("_n", F.lit(0)))})
    rules = rt.double_entry_required(totales, balanza).select(
        "doc_id", F.lit(TOLERANCE).alias("tolerancia"), F.lit("nivel_1").alias("subconjunto_totales"), "exige_partida_doble")
    return tp.build(r, infer_schemes(balanza), rules, coverage(results(t)))


@stored("trial_templates")
def store(t):
    """Two batches of the stored table: the formats whose orientation the arithmetic decides, then what is still new."""
    folder = f"{shared_dir(t.spark)}/templates-{uuid.uuid4().hex}"
    tp.append(t.spark, folder, tp.fresh(tp.empty(t.spark), built(t).filter("orientacion_verificada")))
    tp.append(t.spark, folder, tp.fresh(tp.stored(t.spark, folder), built(t)))
    return tp.stored(t.spark, folder)


def asked(t):
    """Confirmations for every format that one tenant saw, learned or not."""
    return readings(t).filter("tenant_id = 't1'").select(*tp.KEY).distinct().select(*tp.KEY, F.lit("ana").alias("por"), F.lit("2025-01-01").alias("cuando"))


def search(t):
    def run(docs):
        cands = trial_candidates(t).join(docs, "doc_id", "left_semi")
        return mp.oriented(mp.first_verified(cands, FORMS, fits(t), TRIAL_MOST), fits(t))
    return run


@stored("trial_chosen")
def chosen(t):
    return ch.choose_mappings(readings(t), store(t), search(t))


@stored("trial_read_again")
def read_again(t):
    return ch.read_trials(trial_cells(t), chosen(t).select("doc_id", "asigna"))


@stored("trial_results_again")
def results_again(t):
    _, balanza, totales = read_again(t)
    return ch.verdicts(balanza, totales)


def flat(rows):
    """A template with its maps and structs as plain columns."""
    return rows.select(
        *[k for k in ("doc_id", *tp.KEY, "tipo", "estrategia", "forma", "verificado_por", "orientacion_verificada", "filas_afectadas") if k in rows.columns],
        F.array_join(F.transform(F.array_sort(F.map_entries("mapeo")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("mapeo"),
        "esquema.separador", F.size("esquema.anchos").cast("long").alias("anchos"), c("esquema.largo").cast("long").alias("largo"),
        "reglas.tolerancia", "reglas.subconjunto_totales", "reglas.exige_partida_doble",
        "cobertura.cuadran", "cobertura.fallan", "cobertura.no_verificables", "pendiente", "confirmada_por", "confirmada_en",
        c("version").cast("long").alias("version"), "separador_continuacion")


# ------------------------------------------------------------------------------ checking side
view("e_map", "SELECT m.* FROM m3 m JOIN m8 k ON k.doc_id = m.doc_id AND k.forma = m.forma AND k.mapeo = m.mapeo")
view("e_vals", f"SELECT doc_id, seq, cuenta AS cta, nombre AS nom, CASE doc_id % 6 {_vals} END AS v FROM pt_base")
_at = ", ".join(f"v[m.{r} + 1] AS {r}" for r in ("saldo_inicial", "saldo_final", "debe", "haber", *ch.SPLIT))


def over_rows(p: str, name: str) -> str:
    """The checking views of the trial-balance rules once more, over the rows that were read."""
    if name in ("balanza", "totales") or f"{p}_{name}" in VIEWS:
        return f"{p}_{name}"
    names = {n for n in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", VIEWS[name]) if n in VIEWS or n in ("balanza", "totales")}
    new = {n: over_rows(p, n) for n in names}
    return view(f"{p}_{name}", re.sub(r"\b(FROM|JOIN)(\s+)([a-z_0-9]+)", lambda m: m[1] + m[2] + new.get(m[3], m[3]), VIEWS[name]))


def reading_views(p: str) -> None:
    """Typed rows and rule results by the mappings of ``{p}_map``."""
    view(f"{p}_raw", f"""SELECT r.doc_id, r.seq, r.cta AS cuenta, r.nom AS nombre, m.saldo_ini_deudor IS NOT NULL AS dividida,
      regexp_replace(r.cta, '-[0-9]+$', '') AS cuenta_padre, {_at} FROM e_vals r JOIN {p}_map m ON m.doc_id = r.doc_id""")
    for q, d, h in ((f"{p}_nr", "debe", "haber"), (f"{p}_ns", "haber", "debe")):
        view(f"{q}_own", f"""SELECT doc_id, cuenta, cuenta_padre, CASE WHEN debe = haber THEN ''
          WHEN abs(COALESCE(saldo_inicial, 0) + {d} - {h} - COALESCE(saldo_final, 0)) <= 0.01 THEN 'D'
          WHEN abs(COALESCE(saldo_inicial, 0) - {d} + {h} - COALESCE(saldo_final, 0)) <= 0.01 THEN 'A' ELSE '' END AS own FROM {p}_raw""")
        view(q, f"""SELECT o.doc_id, o.cuenta, COALESCE(NULLIF(o.own, ''), p.own, '') AS nat,
          CASE WHEN o.own <> '' THEN 'derivada' WHEN COALESCE(p.own, '') <> '' THEN 'heredada' ELSE 'sin_determinar' END AS origen
          FROM {q}_own o LEFT JOIN {q}_own p ON p.doc_id = o.doc_id AND p.cuenta = o.cuenta_padre AND o.own = ''""")
    view(f"{p}_balanza", f"""SELECT r.doc_id, r.seq, r.cuenta, CAST(len(string_split(r.cuenta, '-')) AS BIGINT) AS nivel, r.cuenta_padre, nat AS naturaleza, nombre,
      CAST(CASE WHEN dividida THEN saldo_ini_deudor WHEN nat = 'A' THEN 0 ELSE saldo_inicial END AS {M}) AS saldo_ini_deudor,
      CAST(CASE WHEN dividida THEN saldo_ini_acreedor WHEN nat = 'A' THEN saldo_inicial ELSE 0 END AS {M}) AS saldo_ini_acreedor, debe, haber,
      CAST(CASE WHEN dividida THEN saldo_fin_deudor WHEN nat = 'A' THEN 0 ELSE saldo_final END AS {M}) AS saldo_fin_deudor,
      CAST(CASE WHEN dividida THEN saldo_fin_acreedor WHEN nat = 'A' THEN saldo_final ELSE 0 END AS {M}) AS saldo_fin_acreedor,
      EXISTS (SELECT 1 FROM {p}_raw k WHERE k.doc_id = r.doc_id AND k.cuenta_padre = r.cuenta) AS es_acumulativa, origen AS naturaleza_origen
      FROM {p}_raw r JOIN {p}_nr n ON n.doc_id = r.doc_id AND n.cuenta = r.cuenta""")
    view(f"{p}_bal_base", f"""SELECT d.doc_id, sd, sh FROM (SELECT DISTINCT doc_id FROM {p}_balanza) d LEFT JOIN (SELECT doc_id, CAST(SUM(debe) AS {D}) AS sd,
      CAST(SUM(haber) AS {D}) AS sh FROM {p}_balanza WHERE nivel = 1 GROUP BY doc_id) b ON b.doc_id = d.doc_id""")
    view(f"{p}_totales", "SELECT doc_id, debe, haber FROM pt_base WHERE FALSE")  # these prints close without a totals line
    over_rows(p, "zr_balanza")
    over_rows(p, "zd_balanza")
    view(f"{p}_cover", f"""SELECT doc_id, COUNT(*) AS reglas, COUNT(*) FILTER (WHERE estado = 'cuadra') AS cuadran, COUNT(*) FILTER (WHERE estado = 'falla') AS fallan,
      COUNT(*) FILTER (WHERE estado = 'no_verificable') AS no_verificables, CAST(SUM(aplicables) AS BIGINT) AS aplicables,
      CAST(SUM(evaluados) AS BIGINT) AS evaluados FROM {p}_zr_balanza GROUP BY doc_id""")


reading_views("e")

_NUMBERS = ", ".join(f"({f}, {sum(source not in ('cuenta', 'nombre') for _, source in columns)})" for f, columns in enumerate(TRIAL_PRINTS))
view("e_words", f"SELECT doc_id, string_agg(DISTINCT tk, '|' ORDER BY tk) AS tk FROM (SELECT doc_id, unnest(string_split({norm_sql('header')}, ' ')) AS tk FROM mcols) WHERE tk <> '' GROUP BY doc_id")
view("e_keys", f"""SELECT doc_id, 't' || CAST(doc_id % 4 AS STRING) AS tenant_id, left(sha256(tk || '#' || CAST(n AS STRING) || '#sep'), 16) AS huella
  FROM e_words JOIN (VALUES {_NUMBERS}) v(f, n) ON doc_id % 6 = f""")
view("e_flips", "SELECT a.doc_id, COUNT(*) FILTER (WHERE a.nat <> b.nat) AS n FROM e_nr a JOIN e_ns b ON b.doc_id = a.doc_id AND b.cuenta = a.cuenta GROUP BY a.doc_id")
view("e_built", """SELECT k.doc_id, tenant_id, huella, 'balanza' AS tipo, 'pdf_text' AS estrategia, m.forma,
  CASE WHEN s.verificado THEN 'vocabulario' ELSE 'aritmetica' END AS verificado_por, NOT s.verificado AS orientacion_verificada,
  CASE WHEN s.verificado THEN n ELSE 0 END AS filas_afectadas, array_to_string(list_sort(string_split(m.mapeo, ',')), ',') AS mapeo, m.debe AS _debe, m.haber AS _haber,
  '-' AS separador, CAST(0 AS BIGINT) AS anchos, CAST(0 AS BIGINT) AS largo, '0.01' AS tolerancia, 'nivel_1' AS subconjunto_totales, TRUE AS exige_partida_doble,
  cuadran, fallan, no_verificables, s.verificado AS pendiente, '' AS confirmada_por, '' AS confirmada_en, CAST(1 AS BIGINT) AS version, '' AS separador_continuacion
  FROM e_keys k JOIN e_map m ON m.doc_id = k.doc_id JOIN m5_swap s ON s.doc_id = m.doc_id AND s.forma = m.forma AND s.mapeo = m.mapeo
  JOIN e_cover v ON v.doc_id = k.doc_id JOIN e_flips f ON f.doc_id = k.doc_id""")
# Orientation is a matter of the print, hence of the key: both batches together keep the first document of each key.
view("e_store", "SELECT * EXCLUDE (doc_id) FROM e_built WHERE fallan = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY tenant_id, huella ORDER BY doc_id) = 1")
# What is read in the end: the template of the key where there is one, else what the search of the document found.
view("e_source", "SELECT tenant_id, huella, MIN(doc_id) AS fuente FROM e_built WHERE fallan = 0 GROUP BY ALL")
view("g_map", """SELECT m.* REPLACE (k.doc_id AS doc_id) FROM e_keys k LEFT JOIN e_source s ON s.tenant_id = k.tenant_id AND s.huella = k.huella
  JOIN e_map m ON m.doc_id = COALESCE(s.fuente, k.doc_id)""")
reading_views("g")
query("E2E_trial_rows", """SELECT doc_id, cuenta, nivel, cuenta_padre, naturaleza, nombre, saldo_ini_deudor, saldo_ini_acreedor, debe, haber, saldo_fin_deudor,
  saldo_fin_acreedor, es_acumulativa, naturaleza_origen FROM g_balanza""")(
    lambda t: read_again(t)[1].drop("seq").withColumn("nivel", c("nivel").cast("bigint")))
# What a rule says when it had nothing to check, in a document whose rows are all below level one and that prints no totals.
query("E2E_trial_results", """SELECT r.* EXCLUDE (tipo) REPLACE (CASE WHEN regla = 'totales' THEN 'fila de totales no detectada en el PDF'
  WHEN regla = 'partida_doble' THEN 'sin filas contra las que sumar' WHEN regla = 'jerarquia' AND evaluados = 0
  THEN 'sin jerarquia: los ' || CAST(n AS STRING) || ' renglones quedaron en nivel 1' ELSE motivo END AS motivo)
FROM g_zr_balanza r JOIN (SELECT doc_id, COUNT(*) AS n FROM g_balanza GROUP BY doc_id) k ON k.doc_id = r.doc_id""")(results_again)
query("E2E_trial_discrepancies", "SELECT * EXCLUDE (tipo, indice) FROM g_zd_balanza")(
    lambda t: suite_discrepancies(rt.trial_rules(*read_again(t)[1:])).drop("indice"))
query("T1_build_templates", "SELECT * EXCLUDE (_debe, _haber) FROM e_built")(lambda t: flat(built(t)))
query("T2_learn_templates", "SELECT * EXCLUDE (_debe, _haber) FROM e_store")(lambda t: flat(store(t)))
query("T3_lookup_templates", """SELECT l.doc_id, l.tenant_id, l.huella, p.huella IS NOT NULL AS reutilizada, pendiente AS t_pendiente
FROM e_keys l LEFT JOIN e_store p ON p.tenant_id = l.tenant_id AND p.huella = l.huella""")(lambda t: tp.lookup(readings(t), store(t)))
query("T4_templates_of_tenant", "SELECT * EXCLUDE (_debe, _haber) FROM e_store WHERE tenant_id = 't1' ORDER BY huella")(
    lambda t: flat(tp.of_tenant(store(t), "t1")))
view("e_asked", "SELECT DISTINCT tenant_id, huella, 'ana' AS por, '2025-01-01' AS cuando FROM e_keys WHERE tenant_id = 't1'")
query("T5_confirm_templates", """SELECT p.* EXCLUDE (_debe, _haber) REPLACE (pendiente AND por IS NULL AS pendiente, COALESCE(por, confirmada_por) AS confirmada_por,
  COALESCE(cuando, confirmada_en) AS confirmada_en, version + CASE WHEN por IS NULL THEN 0 ELSE 1 END AS version)
FROM e_store p LEFT JOIN e_asked a ON a.tenant_id = p.tenant_id AND a.huella = p.huella""")(lambda t: flat(tp.confirm(store(t), asked(t))[0]))
query("T5_unknown_confirmations", """SELECT * FROM e_asked a WHERE NOT EXISTS (SELECT 1 FROM e_store p WHERE p.tenant_id = a.tenant_id AND p.huella = a.huella)""")(
    lambda t: tp.confirm(store(t), asked(t))[1])
query("T6_pending_questions", """SELECT tenant_id, huella, 'orientacion debe/haber' AS campo, _debe AS propone_debe, _haber AS propone_haber,
  verificado_por AS se_apoya_en, 'invertirla cambia la naturaleza de ' || CAST(filas_afectadas AS STRING) || ' filas' AS consecuencia
FROM e_store WHERE pendiente""")(lambda t: tp.pending_questions(store(t)))
query("T7_apply_templates", """SELECT l.doc_id, l.tenant_id, l.huella, COALESCE(p.forma, m.forma) AS forma, COALESCE(p._debe, m.debe) AS debe, COALESCE(p._haber, m.haber) AS haber,
  p.huella IS NOT NULL AS reutilizada FROM e_keys l LEFT JOIN e_store p ON p.tenant_id = l.tenant_id AND p.huella = l.huella
LEFT JOIN e_map m ON m.doc_id = l.doc_id WHERE p.huella IS NOT NULL OR l.doc_id IN (SELECT doc_id FROM m8)""")(
    lambda t: chosen(t).select("doc_id", *tp.KEY, "forma", F.try_element_at("asigna", F.lit("debe")).alias("debe"),
                               F.try_element_at("asigna", F.lit("haber")).alias("haber"), "reutilizada"))
query("E2E_trial_outcomes", """SELECT d.doc_id, CASE WHEN v.reglas IS NULL THEN 'rechazado' WHEN v.fallan > 0 THEN 'con_discrepancias' ELSE 'cuadra' END AS estado,
  CASE WHEN v.reglas IS NOT NULL THEN '' WHEN m.motivo <> '' THEN m.motivo ELSE 'el layout no parece una balanza; faltan las columnas: saldo_inicial, haber, saldo_final' END AS motivo,
  s.huella IS NOT NULL AS reutilizada, COALESCE(v.reglas, 0) AS reglas, COALESCE(v.cuadran, 0) AS cuadran, COALESCE(v.fallan, 0) AS fallan,
  COALESCE(v.no_verificables, 0) AS no_verificables, COALESCE(v.aplicables, 0) AS aplicables, COALESCE(v.evaluados, 0) AS evaluados
FROM e_keys d LEFT JOIN g_cover v ON v.doc_id = d.doc_id LEFT JOIN m8 m ON m.doc_id = d.doc_id
LEFT JOIN e_store s ON s.tenant_id = d.tenant_id AND s.huella = d.huella""")(
    lambda t: ch.outcomes(readings(t), chosen(t), mp.missing_roles(trial_layout(t), trial_candidates(t), REQUIRED), results_again(t)))
