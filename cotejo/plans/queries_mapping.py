"""Named queries of the column mapping, on trial balances and subledgers printed with their headers.

The checking SQL starts from the printed columns and the typed rows, so it shares nothing with layout, search or reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cotejo.operators import mapping as mp
from cotejo.operators.registry import VOCABULARY, forms_of, read_vocabulary
from cotejo.plans.queries_layout import read_tables, stored
from cotejo.plans.queries_text import norm_sql
from cotejo.plans.registry import query, view
from cotejo.plans.relations import M, SUBLEDGER_FIELDS, SUBLEDGER_PRINTS, TRIAL_FORMS, TRIAL_PRINTS
from cotejo.session import shared_dir


c = F.col
FORMS = {form: [(role, req) for role, _, req in fields] for form, fields in TRIAL_FORMS.items()}
REQUIRED = [(form, i, role) for form, fields in TRIAL_FORMS.items() for i, (role, _, req) in enumerate(fields) if req]
SUBLEDGER = {"auxiliar": [(role, req) for role, _, req, _ in SUBLEDGER_FIELDS]}
SAMPLE, TRIAL_MOST, SUBLEDGER_MOST = 2, 40, 60


# ---------------------------------------------------------------------------- trial balances
@stored("trial_tables")
def trial_tables(t):
    return read_tables(t.pt_words)


def trial_layout(t):
    return trial_tables(t)[1]


def trial_cells(t):
    return trial_tables(t)[2]


@stored("trial_candidates")
def trial_candidates(t):
    return mp.role_candidates(trial_layout(t), t.vocab_balanza)


@stored("trial_sample")
def trial_sample(t):
    return mp.sampled_lines(trial_cells(t), SAMPLE)


def trial_proposals(t):
    return mp.proposals(trial_candidates(t), FORMS, TRIAL_MOST)


def fits(t):
    def verify(proposed, swapped=False):
        return mp.trial_fits(proposed, trial_sample(t), swapped=swapped)
    return verify


@stored("trial_mappings")
def trial_mappings(t):
    """M8 + M9: the mapping of every trial document, or why it has none."""
    return mp.oriented(mp.first_verified(trial_candidates(t), FORMS, fits(t), TRIAL_MOST), fits(t))


def printed_columns(prints, kind: str, docs: str) -> str:
    rows = ", ".join(f"({f}, {i}, '{label}')" for f, columns in enumerate(prints) for i, (label, _) in enumerate(columns))
    return f"SELECT doc_id, i AS idx, header FROM {docs} d JOIN (VALUES {rows}) v(f, i, header) ON {kind} = f"


view("mcols", printed_columns(TRIAL_PRINTS, "doc_id % 6", "(SELECT DISTINCT doc_id FROM pt_base)"))
view("mcand", f"""SELECT doc_id, idx, forma, orden, campo, obligatorio, MAX(CASE WHEN n = sinonimo THEN 3 ELSE 2 END) AS puntaje FROM (SELECT *, {norm_sql('header')} AS n FROM mcols) m
  JOIN vocab_balanza v ON strpos(' ' || n || ' ', ' ' || sinonimo || ' ') > 0 GROUP BY ALL""")
query("M1_role_candidates", "SELECT doc_id, idx, forma, campo, CAST(puntaje AS BIGINT) AS puntaje FROM mcand")(
    lambda t: trial_candidates(t).select("doc_id", c("idx").cast("bigint").alias("idx"), "forma", "campo", c("puntaje").cast("bigint").alias("puntaje")))


def all_assignments(form: str, n: int, roles, cand: str, docs: str) -> str:
    """Every assignment of one form, with a column per role."""
    joins, points, columns, printed = [], [], [], []
    for i, (role, req) in enumerate(roles):
        options = f"(SELECT doc_id, idx, puntaje FROM {cand} WHERE forma = '{form}' AND campo = '{role}'" + (
            "" if req else f" UNION ALL SELECT DISTINCT doc_id, NULL, 0 FROM {docs}") + f") r{i}"
        other = "".join(f" AND (r{i}.idx IS NULL OR r{k}.idx IS NULL OR r{i}.idx <> r{k}.idx)" for k in range(i))
        joins.append(options if i == 0 else f"JOIN {options} ON r{i}.doc_id = r0.doc_id{other}")
        points.append(f"r{i}.puntaje")
        columns.append(f"r{i}.idx AS {role}")
        printed.append(f"'{role}=' || CAST(r{i}.idx AS STRING)")
    return (f"SELECT r0.doc_id, {n} AS orden_forma, '{form}' AS forma, concat_ws(',', {', '.join(printed)}) AS mapeo, "
            f"{' + '.join(points)} AS puntos, {', '.join(columns)} FROM {' '.join(joins)}")


for _n, (_form, _roles) in enumerate(FORMS.items()):
    view(f"m3_{_n}", all_assignments(_form, _n, _roles, "mcand", "mcols"))
view("m3", "SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, forma ORDER BY puntos DESC, mapeo) AS rango FROM "
           "(SELECT * FROM m3_0 UNION ALL BY NAME SELECT * FROM m3_1)")
_SHOWN = "doc_id, forma, mapeo, CAST(puntos AS BIGINT) AS puntos, CAST(rango AS BIGINT) AS rango"
query("M3_proposals", f"SELECT {_SHOWN} FROM m3 WHERE rango <= {TRIAL_MOST}")(
    lambda t: trial_proposals(t).select("doc_id", "forma", "mapeo", "puntos", "rango"))
query("M11_best_by_vocabulary", f"SELECT {_SHOWN} FROM m3 QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY orden_forma, rango) = 1")(
    lambda t: mp.best_by_vocabulary(trial_proposals(t)).select("doc_id", "forma", "mapeo", "puntos", "rango"))
query("M4_missing_roles", """
n AS (SELECT DISTINCT forma, orden, campo FROM vocab_balanza WHERE obligatorio = 1),
g AS (SELECT d.doc_id, n.forma, COUNT(*) FILTER (WHERE m.doc_id IS NULL) AS n, COALESCE(string_agg(n.campo, ', ' ORDER BY orden) FILTER (WHERE m.doc_id IS NULL), '') AS faltan
  FROM (SELECT DISTINCT doc_id FROM mcols) d CROSS JOIN n LEFT JOIN (SELECT DISTINCT doc_id, forma, campo FROM mcand) m ON m.doc_id = d.doc_id AND m.forma = n.forma AND m.campo = n.campo GROUP BY ALL)
SELECT doc_id, n, forma, faltan FROM g QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n, forma) = 1""")(
    lambda t: mp.missing_roles(trial_layout(t), trial_candidates(t), REQUIRED))

# What the sampled rows hold in each printed column: amounts by place, null where a column is text.
_vals = " ".join("WHEN {} THEN [{}]".format(f, ", ".join(
    f"CAST(NULL AS {M})" if source in ("cuenta", "nombre") else f"CAST({source} AS {M})" for _, source in columns)) for f, columns in enumerate(TRIAL_PRINTS))
view("m5_rows", f"""SELECT doc_id, CASE doc_id % 6 {_vals} END AS v FROM pt_base
  JOIN (SELECT doc_id, page FROM pt_pages QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY page) <= {SAMPLE}) p USING (doc_id, page)""")


def verified_sql(source: str, debit: str = "debe", credit: str = "haber") -> str:
    """M5 over typed rows: ``source`` holds one column number per role."""
    def at(role: str) -> str:
        return f"v[{role} + 1]"

    move = f"({at(debit)} - {at(credit)})"
    split = f"{at('saldo_ini_deudor')} - COALESCE({at('saldo_ini_acreedor')}, 0) + {move} - {at('saldo_fin_deudor')} + COALESCE({at('saldo_fin_acreedor')}, 0)"
    start, end = f"COALESCE({at('saldo_inicial')}, 0)", f"COALESCE({at('saldo_final')}, 0)"
    ok = (f"CASE WHEN {at('saldo_ini_deudor')} IS NOT NULL THEN abs({split}) <= 0.01 ELSE abs({start} + {move} - {end}) <= 0.01 "
          f"OR abs({start} - {move} - {end}) <= 0.01 OR {move} = 0 END")
    return f"""SELECT *, filas >= 5 AND NOT mes_malo AND buenas * 10 >= filas * 9 AS verificado FROM (
      SELECT m.doc_id, m.orden_forma, m.forma, m.mapeo, m.puntos, m.rango, COUNT(*) FILTER (WHERE m.cuenta = 0) AS filas,
        COUNT(*) FILTER (WHERE m.cuenta = 0 AND COALESCE({ok}, FALSE)) AS buenas,
        COALESCE(bool_or(COALESCE(abs({at('saldo_mes')} - {move}) > 0.01, FALSE)) FILTER (WHERE m.cuenta = 0), FALSE) AS mes_malo
      FROM {source} m JOIN m5_rows r ON r.doc_id = m.doc_id GROUP BY ALL)"""


view("m5", verified_sql("m3"))
view("m5_swap", verified_sql("m3", "haber", "debe"))
query("M5_proposal_fits", f"SELECT doc_id, forma, mapeo, filas, buenas, mes_malo, verificado FROM m5 WHERE rango <= {TRIAL_MOST}")(
    lambda t: fits(t)(trial_proposals(t)).select("doc_id", "forma", "mapeo", "filas", "buenas", "mes_malo", "verificado"))
# No document here has more than forty proposals of a form, so one order holds for all rounds.
view("m8", """SELECT p.doc_id, COALESCE(MIN(n) FILTER (WHERE verificado), COUNT(*)) AS probados, arg_min(forma, n) FILTER (WHERE verificado) AS forma,
  arg_min(mapeo, n) FILTER (WHERE verificado) AS mapeo, CAST(arg_min(puntos, n) FILTER (WHERE verificado) AS BIGINT) AS puntos, CASE WHEN bool_or(verificado) THEN '' ELSE 'ninguno de los ' ||
  CAST(COUNT(*) AS STRING) || ' mapeos propuestos hace cuadrar la aritmetica del documento' END AS motivo
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY orden_forma, rango) AS n FROM m5) p GROUP BY p.doc_id""")
query("M8_first_verified", "SELECT * FROM m8")(
    lambda t: trial_mappings(t).select("doc_id", "probados", "forma", "mapeo", "puntos", "motivo"))
query("M9_orientation", """SELECT m.doc_id, m.mapeo, NOT s.verificado AS orientada, CASE WHEN s.verificado THEN 'vocabulario' ELSE 'aritmetica' END AS verificado_por
FROM m8 m JOIN m5_swap s ON s.doc_id = m.doc_id AND s.forma = m.forma AND s.mapeo = m.mapeo""")(
    lambda t: trial_mappings(t).filter("mapeo IS NOT NULL").select("doc_id", "mapeo", "orientada", "verificado_por"))


# -------------------------------------------------------------------------------- subledgers
@stored("subledger_tables")
def subledger_tables(t):
    return read_tables(t.ps_words)


@stored("subledger_candidates")
def subledger_candidates(t):
    _, layout, cells = subledger_tables(t)
    return mp.shape_candidates(layout, mp.observed_shape(cells), t.vocab_auxiliar, "auxiliar")


_FIELDS = ", ".join(f"('{role}', '{shape}')" for role, _, _, shape in SUBLEDGER_FIELDS)
_SHAPES = {"folio": "entero", "fecha": "fecha", "documento": "texto", "concepto": "texto", "debe": "monto", "haber": "monto", "saldo": "monto"}
_SHAPED = ", ".join(f"({f}, {i}, '{_SHAPES[source]}')" for f, columns in enumerate(SUBLEDGER_PRINTS) for i, (_, source) in enumerate(columns))
view("s_cols", printed_columns(SUBLEDGER_PRINTS, "doc_id % 3", "(SELECT DISTINCT doc_id FROM ps_base)"))
view("s_named", f"""SELECT doc_id, idx, campo, MAX(CASE WHEN n = sinonimo THEN 3 ELSE 2 END) AS puntaje FROM (SELECT *, {norm_sql('header')} AS n FROM s_cols) m
  JOIN vocab_auxiliar v ON strpos(' ' || n || ' ', ' ' || sinonimo || ' ') > 0 GROUP BY ALL""")
view("s_cand", f"""SELECT 'auxiliar' AS forma, * FROM s_named UNION ALL SELECT 'auxiliar', k.doc_id, k.idx, v.campo, 1 FROM s_cols k
  JOIN (VALUES {_SHAPED}) s(f, idx, forma) ON s.f = k.doc_id % 3 AND s.idx = k.idx JOIN (VALUES {_FIELDS}) v(campo, forma) ON v.forma = s.forma AND v.forma <> 'texto'
  WHERE NOT EXISTS (SELECT 1 FROM s_named n WHERE n.doc_id = k.doc_id AND n.idx = k.idx AND n.campo = v.campo)""")
view("s_m3", all_assignments("auxiliar", 0, SUBLEDGER["auxiliar"], "s_cand", "s_cols"))
query("M2_M3_shape_candidates", "SELECT doc_id, idx, campo, CAST(puntaje AS BIGINT) AS puntaje FROM s_cand")(
    lambda t: subledger_candidates(t).select("doc_id", c("idx").cast("bigint").alias("idx"), "campo", c("puntaje").cast("bigint").alias("puntaje")))
query("M3_subledger_proposals", f"""SELECT doc_id, mapeo, CAST(puntos AS BIGINT) AS puntos, rango FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY puntos DESC, mapeo) AS rango FROM s_m3)
WHERE rango <= {SUBLEDGER_MOST}""")(
    lambda t: mp.proposals(subledger_candidates(t), SUBLEDGER, SUBLEDGER_MOST).select("doc_id", "mapeo", "puntos", "rango"))


# ----------------------------------------------------------- U3: a format added as rows
_NEW = [("importe", i, role, int(req), syn) for i, (role, req, syn) in enumerate(
    [("cuenta", True, "cuenta"), ("nombre", True, "nombre"), ("saldo", True, "importe"), ("debe", True, "debe"), ("otro", False, "otro")])]


@stored("extended_vocabulary")
def extended_vocabulary(t):
    """The library's trial-balance vocabulary and a user's form, each its own table, read at run time."""
    base = f"{shared_dir(t.spark)}/vocabulary-{uuid.uuid4().hex}"
    t.vocab_balanza.select("forma", c("orden").cast("int"), "campo", c("obligatorio").cast("int"), "sinonimo").write.parquet(f"{base}/own")
    t.spark.createDataFrame(_NEW, VOCABULARY).write.parquet(f"{base}/user")
    return read_vocabulary(t.spark, f"{base}/own", f"{base}/user")


def _with_new_form(t):
    words = extended_vocabulary(t)
    return mp.best_by_vocabulary(mp.proposals(mp.role_candidates(trial_layout(t), words), forms_of(words), TRIAL_MOST))


query("U3_added_format", """SELECT doc_id, forma, mapeo FROM m3 QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY orden_forma, rango) = 1
UNION ALL SELECT DISTINCT doc_id, 'importe', 'cuenta=0,nombre=1,saldo=2,debe=3,otro=4' FROM pt_base WHERE doc_id % 6 = 5""")(
    lambda t: _with_new_form(t).select("doc_id", "forma", "mapeo"))
