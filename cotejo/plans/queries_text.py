"""Named queries of scalar functions, token cleaning and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cotejo.functions import accounts as ac
from cotejo.functions import text as tx
from cotejo.operators.rules_trial import with_scheme
from cotejo.operators import diagnostics as dg
from cotejo.operators import tokens as tk
from cotejo.operators.skew import by_page
from cotejo.operators.templates import valid_fingerprint, valid_tenant
from cotejo.operators.verdict import compare
from cotejo.plans.queries_rules import D, S
from cotejo.plans.registry import query, view
from cotejo.session import shared_dir
from cotejo.sources import scans

c = F.col

# ------------------------------------------------------------------- money and cells
query("F1_parse_money", f"""
SELECT k, CAST(CASE WHEN forma IN (0, 2, 3) THEN v WHEN forma IN (1, 4, 5, 8) THEN -v WHEN forma = 6 THEN 0
  WHEN forma = 9 THEN CAST(texto AS {D}) END AS {D}) AS monto FROM montos""")(
    lambda t: t.montos.select("k", tx.parse_money(c("texto")).cast(D).alias("monto")))
query("F1_amounts_losing_scale", """
SELECT CAST(0 AS BIGINT) AS con_mas_decimales, COUNT(*) FILTER (WHERE forma <> 7) AS legibles FROM montos""")(
    lambda t: t.montos.select(tx.parse_money(c("texto")).alias("m")).agg(
        F.count_if(tx.loses_scale(c("m"))).alias("con_mas_decimales"), F.count("m").alias("legibles")))
query("F2_is_amount", r"""
SELECT k, COALESCE(regexp_matches(s, '\d') AND NOT regexp_matches(s, '^\d{3,}(-\d+)*$')
  AND NOT regexp_matches(s, '^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$') AND regexp_matches(s, '^[\d.,\-$()%/:]+$'), FALSE) AS monto,
  COALESCE(regexp_matches(s, '\d') AND NOT regexp_matches(s, '^\d{3,}(-\d+)*$')
  AND NOT regexp_matches(s, '^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$') AND regexp_matches(s, '^[\d.,\-$()%/:]+$')
  AND NOT regexp_matches(s, '^\d{1,6}(\.\d{1,6})+$'), FALSE) AS en_cuenta FROM (SELECT k, trim(texto) AS s FROM celdas_txt)""")(
    lambda t: t.celdas_txt.select("k", tx.is_amount(c("texto")).alias("monto"),
                                  tx.is_amount(c("texto"), True).alias("en_cuenta")))
query("F2_is_amount_words", r"""
SELECT doc_id, page, COUNT(*) FILTER (WHERE regexp_matches(text, '\d') AND NOT regexp_matches(text, '^\d{3,}(-\d+)*$')
  AND regexp_matches(text, '^[\d.,\-$()%/:]+$')) AS montos, COUNT(*) AS palabras FROM words GROUP BY ALL""")(
    lambda t: t.words.groupBy("doc_id", "page").agg(
        F.count_if(tx.is_amount(c("text"))).alias("montos"), F.count(F.lit(1)).alias("palabras")))
query("F3_printed_amounts", r"""
SELECT k, regexp_matches(s, '^\$?-?[\d,]*\.\d{2}$') AS auxiliar, regexp_matches(s, '^\$?-?[\d,]*\.\d{2}$') AS polizas,
  regexp_matches(s, '^-?[\d,]*\.\d{2}$') AS mayor, regexp_matches(s, '^\$?-?[\d,]*\.\d{2}-?$') AS estado_cuenta
FROM (SELECT k, trim(texto) AS s FROM celdas_txt)""")(
    lambda t: t.celdas_txt.select("k", *[tx.is_printed_amount(c("texto"), k).alias(k)
                                         for k in tx.AMOUNT_DIALECTS]))
query("F4_is_account", r"""
SELECT doc_id, COUNT(*) FILTER (WHERE regexp_full_match(cuenta, '\d{3,}(-\d{1,6})*')) AS cuentas FROM catalogo GROUP BY doc_id""")(
    lambda t: t.catalogo.groupBy("doc_id").agg(F.count_if(ac.is_account(c("cuenta"))).alias("cuentas")))
_NORM = (r"trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '\p{{M}}+', '', 'g'), "
         r"'[^\p{{L}}\p{{N}}_]+', ' ', 'g'))")


def norm_sql(x: str) -> str:
    return _NORM.format(x)


query("F5_normalize", f"SELECT doc_id, md5({norm_sql('text')}) AS huella FROM documents")(
    lambda t: t.documents.select("doc_id", F.md5(tx.normalize(c("text"))).alias("huella")))
query("F6_tight_key", f"SELECT doc_id, md5(replace({norm_sql('text')}, ' ', '')) AS huella FROM documents")(
    lambda t: t.documents.select("doc_id", F.md5(tx.tight_key(c("text"))).alias("huella")))
query("F7_cell_shape", r"""
SELECT k, CASE WHEN regexp_full_match(s, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') THEN 'fecha'
  WHEN regexp_full_match(s, '\$?-?[\d,]*\.\d{2}') THEN 'monto' WHEN regexp_full_match(s, '\d{1,8}') THEN 'entero'
  ELSE 'texto' END AS forma FROM (SELECT k, trim(texto) AS s FROM celdas_txt)""")(
    lambda t: t.celdas_txt.select("k", tx.cell_shape(c("texto")).alias("forma")))
query("F8_months", """
SELECT doc_id, seq, CAST(orden AS BIGINT) AS numero, lpad(CAST(orden AS STRING), 2, '0') AS codigo,
  CAST(0 AS BIGINT) AS otro FROM mayor_meses""")(
    lambda t: t.mayor_meses.select(
        "doc_id", "seq", tx.month_number(F.concat(F.lit("("), F.upper("periodo"), F.lit("."))).cast("bigint").alias("numero"),
        tx.month_code(F.substring("periodo", 1, 3)).alias("codigo"),
        tx.month_number(c("cuenta")).cast("bigint").alias("otro")))
query("F9_statement_dates", """
b AS (SELECT *, CASE WHEN anio <> '' THEN anio ELSE CAST(a AS STRING) END AS yr,
  lpad(CAST(d AS STRING), 2, '0') || '/' || lpad(CAST(m AS STRING), 2, '0') || '/' AS dm FROM fechas)
SELECT k, CASE WHEN forma < 5 THEN CAST(d AS STRING) END AS dia, CASE forma
  WHEN 0 THEN CASE WHEN k % 3 <> 0 THEN dm || CAST(a AS STRING) ELSE '' END WHEN 1 THEN dm || left(yr, 2) || right(CAST(a AS STRING), 2)
  WHEN 2 THEN dm || CAST(a AS STRING) WHEN 3 THEN dm || yr WHEN 4 THEN dm || yr END AS fecha FROM b""")(
    lambda t: t.fechas.select("k", tx.statement_date(c("texto"), c("ini"), c("fin"), c("anio")).alias("f"))
    .select("k", "f.dia", "f.fecha"))
query("F10_identifiers", r"""
SELECT k, regexp_full_match(texto, '\d{18}') AS clabe, regexp_full_match(texto, '[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}') AS rfc,
  regexp_matches(upper(texto), '^[0-9A-F]{8}-[0-9A-F]{4}-') AS uuid,
  regexp_full_match(texto, '\d[\d-]{6,}\d') AND NOT regexp_full_match(texto, '\d{18}') AS cuenta FROM celdas_txt""")(
    lambda t: t.celdas_txt.select("k", tx.is_clabe(c("texto")).alias("clabe"), tx.is_rfc(c("texto")).alias("rfc"),
                                  tx.is_uuid_head(c("texto")).alias("uuid"),
                                  tx.is_bank_account(c("texto")).alias("cuenta")))
query("F11_reread_class", r"""
SELECT doc_id, page, COUNT(*) FILTER (WHERE regexp_full_match(trim(texto), '-?\d{1,3}(,\d{3})*\.\d{2}')) AS recuperado,
  COUNT(*) FILTER (WHERE regexp_full_match(trim(texto), '-?[\d,]+\.\d{1,3}')
    AND NOT regexp_full_match(trim(texto), '-?\d{1,3}(,\d{3})*\.\d{2}')) AS truncado FROM tsv GROUP BY ALL""")(
    lambda t: t.tsv.withColumn("cl", tx.reread_class(c("texto"))).groupBy("doc_id", "page").agg(
        F.count_if(c("cl") == "recuperado").alias("recuperado"), F.count_if(c("cl") == "truncado").alias("truncado")))
query("F12_canonical_account", r"""
SELECT doc_id, seq, rpad(left(regexp_replace(cuenta, '\D', '', 'g'), 18), 18, '0') AS clave FROM catalogo""")(
    lambda t: t.catalogo.select("doc_id", "seq", ac.canonical(c("cuenta")).alias("clave")))
query("F13_canonical_without_marker", r"""
SELECT c.doc_id, seq, rpad(left(regexp_replace(CASE WHEN m THEN left(cuenta, length(cuenta) - 3) ELSE cuenta END,
  '\D', '', 'g'), 18), 18, '0') AS clave FROM catalogo c JOIN cat_mark k ON k.doc_id = c.doc_id""")(
    lambda t: with_scheme(t.catalogo).select(
        "doc_id", "seq", ac.canonical_without_marker(c("cuenta"), c("marca_ini"), c("marca_fin")).alias("clave")))
query("F14_compare", """
SELECT k, CASE WHEN d = 0 THEN 'exacto' WHEN d <= 0.01 THEN 'tolerancia' ELSE 'falla' END AS veredicto
FROM (SELECT k, abs(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN -0.01 ELSE 0.02 END) AS d FROM montos)""")(
    lambda t: t.montos.select("k", compare(c("v"), (c("v") + F.when(c("k") % 3 == 0, F.lit("0.00").cast(D))
                                                    .when(c("k") % 3 == 1, F.lit("-0.01").cast(D))
                                                    .otherwise(F.lit("0.02").cast(D)))).alias("veredicto")))
query("F15_signed_balance", f"""SELECT doc_id, seq, CAST(saldo_ini_deudor - saldo_ini_acreedor AS {D}) AS inicial,
  CAST(saldo_fin_deudor - saldo_fin_acreedor AS {D}) AS final FROM balanza""")(
    lambda t: t.balanza.select("doc_id", "seq",
                               ac.signed(c("saldo_ini_deudor"), c("saldo_ini_acreedor")).cast(D).alias("inicial"),
                               ac.signed(c("saldo_fin_deudor"), c("saldo_fin_acreedor")).cast(D).alias("final")))
query("F16_nature_of_row", """
SELECT doc_id, seq, CASE WHEN debe = haber THEN '' WHEN abs(saldo_inicial + debe - haber - saldo_final) <= 0.01 THEN 'D'
  WHEN abs(saldo_inicial - debe + haber - saldo_final) <= 0.01 THEN 'A' ELSE '' END AS nat FROM crudas""")(
    lambda t: t.crudas.select("doc_id", "seq", ac.nature_of_row(
        c("saldo_inicial"), c("saldo_final"), c("debe"), c("haber")).alias("nat")))
view("filas_txt", """SELECT p_partkey AS k, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Acum.' WHEN 1 THEN ' DETALLE deta'
  WHEN 2 THEN ' Total general' WHEN 3 THEN ' sumas: 3' ELSE '' END AS texto FROM part""")


def _rows_text(t):
    return t.part.select(c("p_partkey").alias("k"), F.concat(
        "p_name", F.when(c("p_partkey") % 5 == 0, " Acum.").when(c("p_partkey") % 5 == 1, " DETALLE deta")
        .when(c("p_partkey") % 5 == 2, " Total general").when(c("p_partkey") % 5 == 3, " sumas: 3")
        .otherwise("")).alias("texto"))


query("F17_row_marks", """
SELECT k, CASE k % 5 WHEN 0 THEN 'acumulativa' WHEN 1 THEN 'detalle' ELSE '' END AS marca,
  CASE WHEN k % 5 IN (0, 1) THEN p_name ELSE texto END AS nombre
FROM filas_txt JOIN part ON p_partkey = k""")(
    lambda t: _rows_text(t).select("k", tx.row_mark(F.split("texto", " ")).alias("marca"),
                                   tx.without_marks(c("texto")).alias("nombre")))
query("F18_totals_rows", "SELECT k, k % 5 IN (2, 3) AS totales FROM filas_txt")(
    lambda t: _rows_text(t).select("k", tx.is_totals_row(F.array(F.lit("101"), c("texto"))).alias("totales")))
query("F19_block_labels", """
SELECT k, CASE k % 5 WHEN 0 THEN lower(p_name) || ' acum' WHEN 1 THEN lower(p_name) || ' detalle' WHEN 2 THEN
  lower(p_name) || ' total' WHEN 3 THEN lower(p_name) || ' sumas' ELSE lower(p_name) END AS etiqueta,
  p_name LIKE 'small %' OR p_name = 'small' AS abre FROM filas_txt JOIN part ON p_partkey = k""")(
    lambda t: _rows_text(t).select("k", tx.block_label(F.split("texto", " ")).alias("etiqueta")).select(
        "k", "etiqueta", tx.starts_with_label(c("etiqueta"), ["small"]).alias("abre")))
view("rot_n", f"SELECT k, etiqueta, {norm_sql('etiqueta')} AS n FROM rotulos")
query("F20_vocabulary_scores", """
SELECT k, etiqueta, campo, CAST(MAX(CASE WHEN n = sinonimo THEN 3 ELSE 2 END) AS BIGINT) AS puntaje
FROM rot_n JOIN vocab_auxiliar ON ' ' || n || ' ' LIKE '% ' || sinonimo || ' %' GROUP BY ALL""")(
    lambda t: tx.vocabulary_scores(t.rotulos, t.vocab_auxiliar).withColumn("puntaje", c("puntaje").cast("bigint")))
query("F21_field_by_priority", """
SELECT k, etiqueta, arg_min(campo, prioridad) AS campo FROM rot_n JOIN vocab_tabla
  ON strpos(n, sinonimo) > 0 OR strpos(replace(n, ' ', ''), replace(sinonimo, ' ', '')) > 0 GROUP BY ALL""")(
    lambda t: tx.field_by_priority(t.rotulos, t.vocab_tabla))
query("F22_balance_field", """
SELECT k, etiqueta, arg_max(campo, length(sinonimo)) AS campo FROM rot_n JOIN vocab_saldos
  ON replace(n, ' ', '') LIKE '%' || sinonimo GROUP BY ALL""")(
    lambda t: tx.balance_field(t.rotulos, t.vocab_saldos))

_kept = ", ".join(f"'{w}'" for w in tx.KEPT_WORDS)


def mask_sql(x: str, values: bool) -> str:
    s = f"trim({x})"
    keep = (rf"WHEN btrim(lower({s}), '.:,()') IN ({_kept}) OR regexp_full_match({s}, '\d{{3}}(-\d{{1,6}})*') THEN {x} ".replace("btrim", "trim")
            if values else "")
    ps = lambda p, n: f"'{p}' || upper(left(sha256('sal|' || upper({s})), {n}))"
    return rf"""CASE WHEN {s} = '' THEN {x} {keep}
      WHEN regexp_full_match({s}, '(?i)[A-ZÑ&]{{3,4}}\d{{6}}[A-Z0-9]{{3}}') THEN {ps('RFC', 9)}
      WHEN regexp_full_match({s}, '(?i)[0-9A-F]{{8}}-[0-9A-F]{{4}}-[0-9A-F]{{4}}-[0-9A-F]{{4}}-?[0-9A-F]{{0,12}}') THEN {ps('UUID-', 12)}
      WHEN regexp_full_match({s}, '\d{{16,20}}') THEN {ps('CLB', 14)}
      WHEN regexp_full_match({s}, '[\d.,\-$()%/:]+') THEN regexp_replace({x}, '[0-9]', '9', 'g')
      ELSE regexp_replace(regexp_replace(regexp_replace({x}, '[0-9]', '9', 'g'), '[A-ZÁÉÍÓÚÜÑ]', 'X', 'g'),
           '[a-záéíóúüñ]', 'x', 'g') END"""


view("doc_tokens", r"SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS tok FROM documents")
view("celda_masks", f"SELECT k, texto, {mask_sql('texto', True)} AS m FROM celdas_txt")


def _doc_tokens(t):
    return t.documents.select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("tok"))


query("F23_mask_cells", f"SELECT k, texto AS nada, m AS valores, {mask_sql('texto', False)} AS todo FROM celda_masks")(
    lambda t: t.celdas_txt.select("k", tx.mask(c("texto"), "none").alias("nada"),
                                  tx.mask(c("texto"), "values").alias("valores"),
                                  tx.mask(c("texto"), "all").alias("todo")))
for _mode, _v in (("values", True), ("all", False)):
    query(f"F23_mask_documents_{_mode}", f"""
    SELECT doc_id, COUNT(*) AS tokens, COUNT(*) FILTER (WHERE m = tok) AS intactos, COUNT(DISTINCT m) AS distintos,
      MIN(md5(m)) AS menor, MAX(md5(m)) AS mayor FROM (SELECT doc_id, tok, {mask_sql('tok', _v)} AS m FROM doc_tokens) GROUP BY doc_id""")(
        lambda t, m=_mode: _doc_tokens(t).withColumn("m", tx.mask(c("tok"), m)).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("tokens"), F.count_if(c("m") == c("tok")).alias("intactos"),
            F.count_distinct("m").alias("distintos"), F.min(F.md5("m")).alias("menor"),
            F.max(F.md5("m")).alias("mayor")))
query("F23_mask_conversations", f"""
SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: {mask_sql('w', True)}), ' ') AS m
FROM conversations""")(
    lambda t: t.conversations.select("conv_id", "turn", F.array_join(
        F.transform(F.split("text", " "), lambda w: tx.mask(w, "values")), " ").alias("m")))
query("F24_pseudonyms", """
SELECT c_custkey, 'CLI' || upper(left(sha256('sal|' || upper(c_name)), 8)) AS seudonimo FROM customer""")(
    lambda t: t.customer.select("c_custkey", tx.pseudonym(c("c_name"), "CLI", 8, "sal").alias("seudonimo")))
query("D13_mask_leaks", r"""
SELECT k, m FROM celda_masks WHERE regexp_matches(trim(m), '[0-8]') AND NOT regexp_full_match(trim(m), '\d{3}(-\d{1,6})*')
  AND NOT (m LIKE 'RFC%' OR m LIKE 'UUID-%' OR m LIKE 'CLB%')""")(
    lambda t: tx.audit_leaks(t.celdas_txt.select("k", "texto"), "texto"))
query("D13_unmasked_documents", r"""
SELECT doc_id, COUNT(*) AS fugas FROM doc_tokens WHERE regexp_matches(trim(tok), '[0-8]')
  AND NOT regexp_full_match(trim(tok), '\d{3}(-\d{1,6})*') AND NOT regexp_matches(trim(tok), '^(RFC|UUID-|CLB)') GROUP BY doc_id""")(
    lambda t: _doc_tokens(t).filter(tx.leaks(c("tok"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("fugas")))
query("F25_reason_templates", r"""
SELECT regexp_replace(trim(regexp_replace(regexp_replace(motivo, '\d[\d,\.]*', 'N', 'g'), ':\s*[^;]+$', ': …')), 'x^', '') AS plantilla,
  COUNT(*) AS veces FROM zr GROUP BY ALL""")(
    lambda t: _all_results(t).groupBy(tx.reason_template(c("motivo")).alias("plantilla")).agg(
        F.count(F.lit(1)).alias("veces")))


def _all_results(t):
    from cotejo.plans.queries_products import everything
    return everything(t, "results")


query("F26_number_shape", r"""
SELECT doc_id, CASE WHEN COUNT(*) FILTER (WHERE ok) = 0 THEN '?' WHEN bool_or(ok AND strpos(cuenta, '-') > 0) THEN 'sep'
  WHEN COUNT(DISTINCT length(cuenta)) FILTER (WHERE ok) = 1 THEN 'fijo:' || CAST(MIN(length(cuenta)) FILTER (WHERE ok) AS STRING)
  ELSE 'variable' END AS forma FROM (SELECT *, regexp_full_match(cuenta, '\d[\d-]{2,}') AS ok FROM catalogo) GROUP BY doc_id""")(
    lambda t: ac.number_shape(t.catalogo))
query("F27_key_validation", r"""
SELECT k, regexp_full_match(texto, '[A-Za-z0-9][A-Za-z0-9_-]{0,63}') AS tenant, regexp_full_match(texto, '[A-Za-z0-9_-]{1,64}') AS huella
FROM celdas_txt""")(
    lambda t: t.celdas_txt.select("k", valid_tenant(c("texto")).alias("tenant"),
                                  valid_fingerprint(c("texto")).alias("huella")))
query("F28_short_text", r"""
SELECT doc_id, CASE WHEN length(s) <= 38 THEN s ELSE rtrim(left(s, 37)) || '…' END AS corto
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)""")(
    lambda t: t.documents.select("doc_id", tx.short_text(c("text")).alias("corto")))

# Lines of documents: one row per printed line of the whole text.
view("doc_lines", r"SELECT doc_id, unnest(string_split(text, chr(10))) AS texto, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents")
view("doc_pages", "SELECT doc_id, CAST((n - 1) // 10 AS BIGINT) AS page, texto FROM doc_lines")


def _doc_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "texto")).select(
        "doc_id", F.floor(c("n") / 10).cast("bigint").alias("page"), "texto")


_LABELS = [("the ", False), ("Le ", True), ("Die", True), ("license", False), ("://", False)]
query("D12_label_pages", """
SELECT DISTINCT doc_id, etiqueta, page FROM doc_pages JOIN (VALUES ('the ', FALSE), ('Le ', TRUE), ('Die', TRUE),
  ('license', FALSE), ('://', FALSE)) v(etiqueta, arranca)
  ON CASE WHEN arranca THEN starts_with(texto, etiqueta) ELSE strpos(texto, etiqueta) > 0 END""")(
    lambda t: dg.label_pages(_doc_lines(t), t.spark.createDataFrame(_LABELS, "etiqueta string, arranca boolean")))
view("mes_lines", f"""SELECT doc_id, seq, CASE WHEN seq % 7 = 0 THEN '(' || upper(periodo) WHEN seq % 5 = 0 THEN periodo || ':'
  WHEN seq % 11 = 0 THEN 'x' || periodo ELSE periodo END || ' saldo' AS texto FROM mayor_meses""")


def _month_lines(t):
    p, s = c("periodo"), c("seq")
    return t.mayor_meses.select("doc_id", F.concat(
        F.when(s % 7 == 0, F.concat(F.lit("("), F.upper(p))).when(s % 5 == 0, F.concat(p, F.lit(":")))
        .when(s % 11 == 0, F.concat(F.lit("x"), p)).otherwise(p), F.lit(" saldo")).alias("texto"))


def month_tokens(lines):
    """First tokens that normalise to a month, clean or with attached punctuation."""
    tok = F.split("texto", " ")[0]
    rows = lines.withColumn("token", tok).filter(tx.month_number(c("token")) > 0)
    return rows.groupBy("doc_id", F.lower("token").isin(*tx.MONTHS).alias("limpio"), "token").agg(
        F.count(F.lit(1)).alias("veces"))


query("D14_month_tokens", """
SELECT doc_id, NOT regexp_matches(tok, '[(:]') AS limpio, tok AS token, COUNT(*) AS veces
FROM (SELECT doc_id, split_part(texto, ' ', 1) AS tok FROM mes_lines) WHERE tok NOT LIKE 'x%' GROUP BY ALL""")(
    lambda t: month_tokens(_month_lines(t)))

# ------------------------------------------------------------------- token cleaning
_KEY = "doc_id, page, text, round_even(x0 * 10, 0) AS kx, round_even(top * 10, 0) AS kt"
_SUM = "COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos, CAST(round(SUM(x0), 3) AS DOUBLE) AS x0, MIN(text) AS menor, MAX(text) AS mayor"


def page_digest(df):
    """Per page: how many words, which ones and where. Keeps the compared output small."""
    return df.groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.round(F.sum("x0"), 3).alias("x0"),
        F.min("text").alias("menor"), F.max("text").alias("mayor"))


query("K1_deduplicate", f"""
SELECT doc_id, page, {_SUM} FROM (SELECT {_KEY}, pos, x0, ROW_NUMBER() OVER (PARTITION BY doc_id, page, text,
  round_even(x0 * 10, 0), round_even(top * 10, 0) ORDER BY pos) AS rn FROM words_dup) WHERE rn = 1 GROUP BY doc_id, page""")(
    lambda t: page_digest(tk.deduplicate(t.words_dup)))
query("K2_repetition", f"""
SELECT doc_id, page, MAX(n) AS factor FROM (SELECT {_KEY}, COUNT(*) AS n FROM words_dup GROUP BY ALL) GROUP BY ALL""")(
    lambda t: tk.repetition(t.words_dup))
view("k3_w", r"""SELECT *, length(COALESCE(NULLIF(regexp_extract(text, '^\d{1,2}-[A-Za-zÁÉÍÓÚÑ]{3}-(\d{2}|\d{4})$', 1), ''),
  NULLIF(regexp_extract(text, '^\d{1,2}-[A-Za-zÁÉÍÓÚÑ]{3}-(\d{2}|\d{4})\D', 1), ''))) AS w FROM words_glued""")
view("k3_p", "SELECT doc_id, page, MIN(w) AS w FROM k3_w GROUP BY doc_id, page HAVING MIN(w) = MAX(w)")
view("k3_s", r"""SELECT k.* EXCLUDE (w), CASE p.w WHEN 2 THEN regexp_extract(text, '^(\d{1,2}-[A-Za-zÁÉÍÓÚÑ]{3}-\d{2})\S.*$', 1)
  WHEN 4 THEN regexp_extract(text, '^(\d{1,2}-[A-Za-zÁÉÍÓÚÑ]{3}-\d{4})\S.*$', 1) ELSE '' END AS f
  FROM k3_w k LEFT JOIN k3_p p ON p.doc_id = k.doc_id AND p.page = k.page""")
query("K3_split_glued_dates", """
SELECT doc_id, page, pos, CAST(0 AS BIGINT) AS parte, CASE WHEN f <> '' THEN f ELSE text END AS text, x0,
  CASE WHEN f <> '' THEN x0 + (x1 - x0) * length(f) / length(text) ELSE x1 END AS x1 FROM k3_s
UNION ALL SELECT doc_id, page, pos, 1, substr(text, length(f) + 1), x0 + (x1 - x0) * length(f) / length(text), x1
FROM k3_s WHERE f <> ''""")(
    lambda t: tk.split_glued_dates(t.words_glued).select(
        "doc_id", "page", "pos", c("parte").cast("bigint").alias("parte"), "text", "x0", "x1"))
# Signs printed as their own token before some amounts, before some texts, and last.
view("signos", """SELECT doc_id, page, CAST(floor(top) AS BIGINT) AS line, pos * 2 AS pos, text, x0 FROM words
  UNION ALL SELECT doc_id, page, CAST(floor(top) AS BIGINT), pos * 2 - 1, CASE WHEN pos % 3 = 0 THEN '-$' ELSE '$' END, x0 - 5
  FROM words WHERE pos % 4 = 1 UNION ALL SELECT doc_id, page, CAST(floor(top) AS BIGINT), pos * 2 + 1, '-', x1 + 5 FROM words WHERE pos % 8 = 6""")


def _signs(t):
    w = t.words.withColumn("line", F.floor("top").cast("bigint"))
    a = w.select("doc_id", "page", "line", (c("pos") * 2).alias("pos"), "text", "x0")
    b = w.filter("pos % 4 = 1").select("doc_id", "page", "line", (c("pos") * 2 - 1).alias("pos"),
                                       F.when(c("pos") % 3 == 0, "-$").otherwise("$").alias("text"), (c("x0") - 5).alias("x0"))
    d = w.filter("pos % 8 = 6").select("doc_id", "page", "line", (c("pos") * 2 + 1).alias("pos"), F.lit("-").alias("text"), (c("x1") + 5).alias("x0"))
    return a.union(b).union(d)


query("K4_join_signs", r"""
s AS (SELECT *, regexp_matches(text, '^-?\$$|^-$') AS sg, COUNT(*) FILTER (WHERE NOT regexp_matches(text, '^-?\$$|^-$')) OVER (
  PARTITION BY doc_id, page, line ORDER BY x0 DESC, pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM signos),
j AS (SELECT doc_id, page, line, g, COALESCE(string_agg(text, '' ORDER BY x0, pos) FILTER (WHERE sg), '') AS pre, MAX(pos) FILTER (WHERE NOT sg) AS pos,
  MAX(text) FILTER (WHERE NOT sg) AS tx, MAX(x0) FILTER (WHERE NOT sg) AS x0 FROM s WHERE g > 0 GROUP BY ALL)
SELECT doc_id, page, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos, CAST(round(SUM(x0), 3) AS DOUBLE) AS x0, MIN(te) AS menor, MAX(te) AS mayor FROM
(SELECT *, CASE WHEN regexp_full_match(tx, '\$?-?[\d,]*\.\d{2}-?') THEN pre || tx ELSE tx END AS te FROM j) GROUP BY ALL""")(
    lambda t: page_digest(tk.join_signs(_signs(t))))
view("k5", """SELECT *, 1 + COUNT(*) FILTER (WHERE b) OVER (PARTITION BY doc_id, page ORDER BY pos) AS run FROM (SELECT *,
  COALESCE(x0 < LAG(x1) OVER (PARTITION BY doc_id, page ORDER BY pos) - 0.5, FALSE) AS b FROM chars)""")
query("K5_glyph_runs", "SELECT doc_id, page, run, COUNT(*) AS n, MIN(pos) AS desde, MAX(pos) AS hasta FROM k5 GROUP BY ALL")(
    lambda t: tk.glyph_runs(t.chars).groupBy("doc_id", "page", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("desde"), F.max("pos").alias("hasta")))
query("K6_glyph_words", r"""
w AS (SELECT *, regexp_full_match(ch, '[\s\p{Z}]') AS sp FROM k5),
n AS (SELECT *, COALESCE(LAG(sp) OVER v, TRUE) OR x0 - LAG(x1) OVER v > 1.2 AS nu FROM w WINDOW v AS (PARTITION BY doc_id, page, run ORDER BY pos)),
g AS (SELECT *, COUNT(*) FILTER (WHERE nu) OVER (PARTITION BY doc_id, page, run ORDER BY pos) AS gr FROM n),
p AS (SELECT doc_id, page, run, gr, string_agg(ch, '' ORDER BY pos) AS text, MIN(pos) AS pos, arg_min(x0, pos) AS x0 FROM g WHERE NOT sp GROUP BY ALL)
SELECT doc_id, page, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos, CAST(round(SUM(x0), 3) AS DOUBLE) AS x0, MIN(md5(text)) AS menor, MAX(md5(text)) AS mayor FROM p GROUP BY ALL""")(
    lambda t: page_digest(tk.glyph_words(t.chars).withColumn("text", F.md5("text"))))
query("K7_split_amounts", r"""
u AS (SELECT k, format('{:,.2f}', CAST(v AS DOUBLE)) AS a FROM montos)
SELECT k, CAST(0 AS BIGINT) AS parte, CASE k % 4 WHEN 0 THEN 'SERDAN' WHEN 2 THEN a || 'X' ELSE a END AS text FROM u
UNION ALL SELECT k, 1, CASE k % 4 WHEN 0 THEN '-' || a ELSE '-1,234.50' END FROM u WHERE k % 4 < 2""")(
    lambda t: tk.split_amounts(t.montos.withColumn("a", F.format_number("v", 2)).select(
        "k", F.when(c("k") % 4 == 0, F.concat(F.lit("SERDAN-"), "a")).when(c("k") % 4 == 1, F.concat("a", F.lit("-1,234.50")))
        .when(c("k") % 4 == 2, F.concat("a", F.lit("X"))).otherwise(c("a")).alias("text")))
    .select("k", c("parte").cast("bigint").alias("parte"), "text"))
query("K8_cid_fraction", "SELECT doc_id, AVG(CASE WHEN strpos(text, '(cid:') > 0 THEN 1.0 ELSE 0.0 END) AS fraccion FROM words_cid GROUP BY doc_id")(
    lambda t: tk.cid_fraction(t.words_cid))
query("K9_contaminated", """
SELECT doc_id, page, pos, text FROM words_cid WHERE text IN ('SERDAN-228,200.69', '1,185.22-227,015.47')""")(
    lambda t: tk.contaminated(t.words_cid).select("doc_id", "page", "pos", "text"))
view("k10", """SELECT *, COALESCE(LEAD(x0) OVER (PARTITION BY doc_id, page, round_even(top, 0) ORDER BY x0, pos) < x1 - 0.5, FALSE) AS tr FROM words_cid""")
query("K10_overlapping", "SELECT doc_id, page, COUNT(*) FILTER (WHERE tr) AS traslapadas FROM k10 GROUP BY ALL")(
    lambda t: tk.overlapping(t.words_cid))
view("k11", r"""SELECT doc_id, COUNT(*) FILTER (WHERE text IN ('SERDAN-228,200.69', '1,185.22-227,015.47')) AS tokens_contaminados,
  COUNT(*) FILTER (WHERE tr) AS palabras_traslapadas, COUNT(*) AS palabras,
  COUNT(*) FILTER (WHERE tr) / COUNT(*) AS fraccion_traslape, COUNT(*) FILTER (WHERE text LIKE '(cid:%') / COUNT(*) AS fraccion_cid,
  COUNT(*) FILTER (WHERE pos % 8 = 0) AS primeras
  FROM k10 GROUP BY doc_id""")
query("K11_U2_signals", "SELECT * FROM k11")(
    lambda t: tk.signals(t.words_cid, None, {"primeras": F.count_if(c("pos") % 8 == 0)}))
query("K12_strategy", """
SELECT doc_id, CASE WHEN fraccion_cid >= 0.5 THEN 'ocr' WHEN tokens_contaminados > 0 OR fraccion_traslape > 0.02 THEN 'pdf_chars' ELSE 'pdf_text' END AS estrategia,
  CASE WHEN fraccion_cid >= 0.5 THEN printf('%.1f', fraccion_cid * 100) || '% de la muestra viene en CID sin mapa ToUnicode: el PDF no trae la tabla que traduce glifos a letras, asi que se relee por OCR'
  WHEN tokens_contaminados > 0 THEN CAST(tokens_contaminados AS STRING) || ' token(s) contaminado(s): una sola palabra mezcla glifos de dos corridas distintas'
  WHEN fraccion_traslape > 0.02 THEN printf('%.3f', fraccion_traslape) || ' de las palabras se traslapan: hay texto encimado'
  ELSE 'texto nativo limpio en la muestra' END AS motivo FROM k11""")(
    lambda t: tk.decide(tk.signals(t.words_cid)))
query("K13_cid_pages", "SELECT doc_id, page, COUNT(*) AS tokens FROM words_cid WHERE strpos(text, '(cid:') > 0 GROUP BY ALL")(
    lambda t: tk.cid_pages(t.words_cid))
# Balance cells that the first reading left empty: every 11th printed balance.
view("huecos", "SELECT doc_id, page, pos AS cell, top, 420.0 AS x_min, 457.0 AS x_max FROM words WHERE pos % 8 = 6 AND pos % 11 = 0")
view("k14", r"""SELECT doc_id, page, cell, text AS leido, CASE WHEN regexp_full_match(text, '-?\d{1,3}(,\d{3})*\.\d{2}') THEN 'recuperado' ELSE 'truncado' END AS clase
  FROM (SELECT h.doc_id, h.page, h.cell, r.text, ROW_NUMBER() OVER (PARTITION BY h.doc_id, h.page, h.cell ORDER BY r.pos) AS rn
  FROM huecos h JOIN reread r ON r.doc_id = h.doc_id AND r.page = h.page AND abs(r.top - h.top) <= 4 AND r.x1 >= 402 AND r.x1 <= 475
  AND regexp_full_match(r.text, '-?[\d,]+\.\d{1,3}')) WHERE rn = 1""")


def _gaps(t):
    return t.words.filter("pos % 8 = 6 AND pos % 11 = 0").select(
        "doc_id", "page", c("pos").alias("cell"), "top", F.lit(420.0).alias("x_min"), F.lit(457.0).alias("x_max"))


query("K14_reread_cells", "SELECT * FROM k14")(lambda t: tk.reread_cells(_gaps(t), t.reread))
query("K15_reread_cid", """
SELECT doc_id, page, pos FROM words_cid w WHERE text LIKE '(cid:%' AND EXISTS (SELECT 1 FROM reread r WHERE r.doc_id = w.doc_id
  AND r.page = w.page AND abs(r.top - w.top) <= 4 AND r.x1 >= w.x0 AND w.x1 >= r.x0)""")(
    lambda t: tk.reread_cid(t.words_cid, t.reread).select("doc_id", "page", "pos"))
query("K16_reread_summary", f"""
s AS (SELECT h.doc_id, COUNT(DISTINCT h.page) AS paginas, COUNT(*) AS ilegibles, COUNT(*) FILTER (WHERE clase = 'recuperado') AS recuperados,
  COUNT(*) FILTER (WHERE clase = 'truncado') AS truncados FROM huecos h LEFT JOIN k14 k ON k.doc_id = h.doc_id AND k.page = h.page AND k.cell = h.cell GROUP BY h.doc_id)
SELECT *, {S('paginas')} || ' pagina(s) reintentadas por OCR; ' || {S('recuperados')} || ' de ' || {S('ilegibles')} || ' datos recuperados'
  || CASE WHEN truncados > 0 THEN '; ' || {S('truncados')} || ' celdas venian truncadas en la propia pagina y no se aceptaron' ELSE '' END AS motivo FROM s""")(
    lambda t: tk.reread_summary(_gaps(t), tk.reread_cells(_gaps(t), t.reread)))

# ----------------------------------------------------------------------------- scans
def _words_scan(t):
    path = f"{shared_dir(t.spark)}/words-{uuid.uuid4().hex}"
    t.words.write.parquet(path)
    return scans.scan_words(t.spark, path)


query("S1_scan_words", "SELECT doc_id, page, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos, CAST(round(SUM(x0), 3) AS DOUBLE) AS x0, MIN(text) AS menor, MAX(text) AS mayor FROM words GROUP BY ALL")(
    lambda t: page_digest(_words_scan(t)))


def _tsv_scan(t):
    """The second reading as OCR files, with short and non-numeric rows among them."""
    path = f"{shared_dir(t.spark)}/tsv-{uuid.uuid4().hex}"
    z = F.lit("0")
    lines = t.tsv.select(
        "doc_id", "page", F.lit("5").alias("level"), c("page").cast("string").alias("page_num"), z.alias("block_num"),
        z.alias("par_num"), z.alias("line_num"), z.alias("word_num"),
        F.when(c("pos") % 41 == 0, "n/a").otherwise(c("izquierda").cast("string")).alias("left"),
        *[c(a).cast("string").alias(b) for a, b in (("arriba", "top"), ("ancho", "width"), ("alto", "height"), ("confianza", "conf"))],
        F.when(c("pos") % 43 == 0, F.lit(None)).otherwise(c("texto")).alias("text"))
    # A folder a document; its pages are dealt out by span, so files and tasks grow with the rows and not with the pages.
    lines.repartition("doc_id", by_page()).drop("page").write.partitionBy("doc_id").option("sep", "\t").option("header", True).option(
        "quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return scans.scan_tsv(t.spark, path)


query("S2_scan_tsv", """
SELECT doc_id, page, COUNT(*) AS n, CAST(round(SUM(x0), 3) AS DOUBLE) AS x0, CAST(round(SUM(bottom), 3) AS DOUBLE) AS bottom, MIN(text) AS menor, MAX(text) AS mayor
FROM reread WHERE pos % 41 <> 0 AND pos % 43 <> 0 GROUP BY ALL""")(
    lambda t: _tsv_scan(t).groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x0"), 3).alias("x0"), F.round(F.sum("bottom"), 3).alias("bottom"),
        F.min("text").alias("menor"), F.max("text").alias("mayor")))
query("S3_requested_pages", """
SELECT w.doc_id, w.page, CAST(CASE w.page WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS pedido, COUNT(*) AS n FROM words w WHERE page IN (3, 1) GROUP BY ALL""")(
    lambda t: scans.requested_pages(t.words, t.words.select("doc_id").distinct().select(
        "doc_id", F.posexplode(F.array(*[F.lit(p).cast("bigint") for p in (3, 1, 99999)])).alias("pedido", "page")))
    .groupBy("doc_id", "page", c("pedido").cast("bigint").alias("pedido")).agg(F.count(F.lit(1)).alias("n")))
query("S4_first_pages", """
SELECT doc_id, page, COUNT(*) AS n FROM words w WHERE (SELECT COUNT(DISTINCT page) FROM words o WHERE o.doc_id = w.doc_id AND o.page < w.page) < 2 GROUP BY ALL""")(
    lambda t: tk.first_pages(t.words, 2).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")))
view("s5_docs", "SELECT doc_id, CAST(MAX(page) AS INT) AS total FROM words GROUP BY doc_id")
query("S5_expand_pages", """
SELECT doc_id, CAST(total AS BIGINT) AS total, array_to_string(list_sort(list_distinct(list_filter(CASE doc_id % 3 WHEN 0 THEN [1, 3, 4, 5, total]
  WHEN 1 THEN [1, least(2, total), total] ELSE [total - 1, 2, 2, 99999] END, lambda p: p >= 1 AND p <= total))), ',') AS paginas FROM s5_docs""")(
    lambda t: t.words.groupBy("doc_id").agg(F.max("page").cast("int").alias("total")).select(
        "doc_id", c("total").cast("bigint").alias("total"), F.array_join(scans.expand_pages(
            F.when(c("doc_id") % 3 == 0, "1, 3-5,-1").when(c("doc_id") % 3 == 1, "").otherwise("-2,2,2,99999"), c("total")).cast("array<string>"), ",").alias("paginas")))
_TC = ["cuenta", "nivel", "cuenta_padre", "naturaleza", "nombre", "saldo_ini_deudor", "saldo_ini_acreedor", "debe", "haber", "saldo_fin_deudor", "saldo_fin_acreedor"]


def _csv_scan(t):
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    t.balanza.select(*_TC).write.option("header", True).option("emptyValue", "").csv(path)
    return scans.scan_trial_csv(t.spark, path)


query("S6_scan_trial_csv", "SELECT cuenta, CAST(nivel AS BIGINT) AS nivel, COALESCE(cuenta_padre, '') AS cuenta_padre, " + ", ".join(_TC[4:]) + " FROM balanza")(
    lambda t: _csv_scan(t).select("cuenta", c("nivel").cast("bigint").alias("nivel"), F.coalesce("cuenta_padre", F.lit("")).alias("cuenta_padre"), *_TC[4:]))
