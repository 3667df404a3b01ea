"""Accounting relations shaped from the star-schema tables.

Every relation is one SELECT that both Spark and an ANSI engine can run, so a query
and its check start from the same rows.  Faults are injected by modulus.  The two
relations that carry a running balance over unbounded groups (``aux_moves``,
``est_base``) are built on Spark with ``ordered_scan`` instead of a window.

``seq`` is the reading order: a BIGINT that grows along the document.  It needs no
global numbering, so building a relation never sorts a document in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.scan import ordered_scan
from cotejo.session import stage

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Order key of the event relations: half (1 bit) | user (26 bits) | event (36 bits).
EVENT_SPAN = 68719476736
USER_SPAN = 67108864

M = "DECIMAL(18,2)"


def _dmy(ts: str) -> str:
    return (f"(lpad(CAST(day({ts}) AS STRING), 2, '0') || '/' || "
            f"lpad(CAST(month({ts}) AS STRING), 2, '0') || '/' || CAST(year({ts}) AS STRING))")


def _pad(expr: str, n: int) -> str:
    """Left-pad with zeros without ever cutting a longer number."""
    t = f"CAST({expr} AS STRING)"
    return f"(CASE WHEN length({t}) < {n} THEN lpad({t}, {n}, '0') ELSE {t} END)"


def _money_text(amount: str) -> str:
    """1234567.80 -> '1,234,567.80' for amounts below a thousand million."""
    s = f"CAST(CAST({amount} AS {M}) AS STRING)"
    n = f"length({s})"
    return (f"(CASE WHEN {n} > 9 THEN substr({s}, 1, {n} - 9) || ',' || substr({s}, {n} - 8, 3)"
            f" || ',' || substr({s}, {n} - 5, 6) WHEN {n} > 6 THEN substr({s}, 1, {n} - 6)"
            f" || ',' || substr({s}, {n} - 5, 6) ELSE {s} END)")


# name -> SELECT. {each_month} is the only engine-specific piece.
RELATIONS: dict[str, str] = {}

# ---------------------------------------------------------------- journal (P)
RELATIONS["pol_debits"] = f"""
SELECT l_orderkey AS poliza_id,
       CAST(SUM(CAST(l_extendedprice AS {M})) AS {M}) AS suma
FROM lineitem GROUP BY l_orderkey"""

RELATIONS["pol_heads"] = f"""
SELECT o_custkey % 16 AS doc_id, o_orderkey AS poliza_id,
       CAST(floor(o_orderkey / 640) AS BIGINT) + 1 AS pagina,
       o_orderstatus AS estatus, {_dmy('o_orderdate')} AS fecha, d.suma AS suma,
       CAST(COALESCE(d.suma, 0) + CASE WHEN o_orderkey % 47 = 0 THEN 5.00
            WHEN o_orderkey % 43 = 0 THEN 0.01 ELSE 0.00 END AS {M}) AS abono
FROM orders LEFT JOIN pol_debits d ON d.poliza_id = o_orderkey"""

RELATIONS["polizas"] = f"""
SELECT doc_id, poliza_id AS seq, poliza_id,
       CASE estatus WHEN 'F' THEN 'Ingreso' WHEN 'O' THEN 'Egreso' ELSE 'Diario' END AS tipo,
       '' AS naturaleza, fecha,
       'FACT. FOLIO: ' || CAST(poliza_id * 7 AS STRING) AS descripcion,
       CAST(poliza_id * 7 AS STRING) AS folio,
       CASE WHEN poliza_id % 59 = 0 THEN NULL ELSE CAST(COALESCE(suma, 0)
            + CASE WHEN poliza_id % 41 = 0 THEN 1.00 ELSE 0.00 END AS {M}) END AS total_debe,
       CASE WHEN poliza_id % 59 = 0 THEN NULL ELSE abono END AS total_haber,
       poliza_id % 53 <> 0 AS completa
FROM pol_heads"""

RELATIONS["movimientos"] = f"""
SELECT o_custkey % 16 AS doc_id, l_orderkey AS poliza_id, CAST(l_linenumber AS BIGINT) AS orden,
       CAST(101 + l_suppkey % 9 AS STRING) || '-' || {_pad('l_partkey % 100', 2)} AS cuenta,
       'CARGO' AS nombre_cuenta, CAST(l_extendedprice AS {M}) AS debe,
       CAST(0.00 AS {M}) AS haber, CAST(floor(l_orderkey / 640) AS BIGINT) + 1 AS pagina
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT doc_id, poliza_id, CAST(99 AS BIGINT) AS orden, '201-01' AS cuenta,
       'ABONO' AS nombre_cuenta, CAST(0.00 AS {M}) AS debe, abono AS haber, pagina
FROM pol_heads WHERE suma IS NOT NULL"""

RELATIONS["cfdi"] = f"""
SELECT o_custkey % 16 AS doc_id, o_orderkey AS seq,
       CASE WHEN o_orderkey % 67 = 0 THEN -o_orderkey ELSE o_orderkey END AS poliza_id,
       {_dmy('o_orderdate')} AS fecha,
       CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey * 7
            + CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS STRING) END AS documento,
       CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE
            '0000AAAA-00BB-' || {_pad('o_orderkey', 8)} END AS uuid,
       'AAA010101AAA' AS rfc, 'I' AS tipo
FROM orders WHERE o_orderkey % 3 <> 0"""

# -------------------------------------------------------------- subledger (E)
RELATIONS["aux_base"] = f"""
SELECT user_id % 8 AS doc_id, user_id, event_id, event_id % 2 AS mitad,
       ((event_id % 2) * {USER_SPAN} + user_id) * {EVENT_SPAN} + event_id AS seq,
       CAST(100000 + user_id AS STRING) AS cuenta, event_type, {_dmy('ts')} AS fecha,
       CAST(floor(event_id / 400) AS BIGINT) + 1 AS pagina,
       CASE WHEN user_id % 11 = 0 OR event_type IN ('click', 'view', 'purchase')
            THEN CAST(value AS {M}) ELSE CAST(0.00 AS {M}) END AS debe,
       CASE WHEN user_id % 11 = 0 OR event_type IN ('error', 'signup')
            THEN CAST(value AS {M}) ELSE CAST(0.00 AS {M}) END AS haber,
       CASE WHEN user_id % 3 = 0 THEN -1 ELSE 1 END AS signo
FROM events"""

RELATIONS["aux_moves"] = f"""
SELECT *, CAST(1000.00 + SUM(signo * (debe - haber)) OVER (
           PARTITION BY user_id, mitad ORDER BY event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {M}) AS cierto
FROM aux_base"""

RELATIONS["auxiliar"] = f"""
SELECT doc_id, seq, cuenta, 'CUENTA ' || cuenta AS nombre_cuenta,
       CAST(1000.00 AS {M}) AS saldo_inicial_cuenta, CAST(event_id AS STRING) AS folio, fecha,
       event_type AS tipo_movimiento, 'F-' || CAST(event_id AS STRING) AS documento,
       '' AS tercero, event_type AS concepto, debe, haber,
       CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0
            THEN CAST(cierto + 1.00 AS {M}) ELSE cierto END AS saldo,
       FALSE AS es_subtotal, pagina, CAST(event_id % 400 AS DOUBLE) AS top,
       CASE WHEN event_id % 89 = 0 THEN 'sin_saldo' ELSE 'impreso' END AS saldo_origen
FROM aux_moves
UNION ALL
SELECT user_id % 8 AS doc_id,
       ({USER_SPAN} + user_id) * {EVENT_SPAN} + {EVENT_SPAN - 1} AS seq,
       cuenta, 'CUENTA ' || cuenta AS nombre_cuenta, CAST(1000.00 AS {M}) AS saldo_inicial_cuenta,
       '' AS folio, '' AS fecha, '' AS tipo_movimiento, '' AS documento, '' AS tercero,
       '' AS concepto,
       CAST(SUM(debe) + MAX(CASE WHEN user_id % 13 = 0 THEN 1.00 ELSE 0.00 END) AS {M}) AS debe,
       CAST(SUM(haber) AS {M}) AS haber,
       CAST(1000.00 + SUM(signo * (debe - haber)) AS {M}) AS saldo,
       TRUE AS es_subtotal, MAX(pagina) AS pagina, CAST(400 AS DOUBLE) AS top,
       'impreso' AS saldo_origen
FROM aux_base WHERE user_id % 17 <> 0 GROUP BY user_id, cuenta"""

# ------------------------------------------------------------------ trial balance (B)
RELATIONS["bal_leaf"] = f"""
SELECT c_custkey AS custkey, n_nationkey AS nationkey, n_regionkey AS regionkey,
       CAST(c_acctbal AS {M}) AS inicial,
       CAST(COALESCE(cargos, 0) AS {M}) AS debe, CAST(COALESCE(abonos, 0) AS {M}) AS haber
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey,
       SUM(CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(o_totalprice AS {M}) END) AS cargos,
       SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS {M}) END) AS abonos
   FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"""

RELATIONS["bal_nation"] = f"""
SELECT nationkey, regionkey, CAST(SUM(inicial) AS {M}) AS inicial, CAST(SUM(debe) AS {M}) AS debe,
       CAST(SUM(haber) + CASE WHEN nationkey = 17 THEN 5.00 ELSE 0.00 END AS {M}) AS haber
FROM bal_leaf WHERE nationkey <> 13 GROUP BY nationkey, regionkey"""

_RRR = "CAST(100 + regionkey AS STRING)"
_NN = _pad("nationkey + 1", 2)
_CC = _pad("custkey + 1", 6)

RELATIONS["bal_rows"] = f"""
SELECT {_RRR} || '-' || {_NN} || '-' || {_CC} AS cuenta, 3 AS nivel,
       {_RRR} || '-' || {_NN} AS cuenta_padre,
       ((100 + regionkey) * 100 + nationkey + 1) * 1000000000000 + custkey + 1 AS seq,
       custkey AS clave, regionkey, inicial, debe, haber,
       CAST(inicial + debe - haber + CASE WHEN custkey % 71 = 0 THEN 100.00 ELSE 0.00 END
            AS {M}) AS final
FROM bal_leaf
UNION ALL
SELECT {_RRR} || '-' || {_NN} AS cuenta, 2 AS nivel, {_RRR} AS cuenta_padre,
       ((100 + regionkey) * 100 + nationkey + 1) * 1000000000000 AS seq,
       CAST(nationkey AS BIGINT) AS clave, regionkey, inicial,
       CAST(debe + CASE WHEN nationkey = 7 THEN 0.01 ELSE 0.00 END AS {M}) AS debe, haber,
       CAST(inicial + debe - haber + CASE WHEN nationkey = 7 THEN 0.01 ELSE 0.00 END
            AS {M}) AS final
FROM bal_nation
UNION ALL
SELECT {_RRR} AS cuenta, 1 AS nivel, '' AS cuenta_padre,
       (100 + regionkey) * 100 * 1000000000000 AS seq, CAST(regionkey AS BIGINT) AS clave,
       regionkey, CAST(SUM(inicial) AS {M}) AS inicial,
       CAST(SUM(debe + CASE WHEN nationkey = 7 THEN 0.01 ELSE 0.00 END) AS {M}) AS debe,
       CAST(SUM(haber) AS {M}) AS haber,
       CAST(SUM(inicial + debe - haber + CASE WHEN nationkey = 7 THEN 0.01 ELSE 0.00 END)
            AS {M}) AS final
FROM bal_nation GROUP BY regionkey"""

RELATIONS["balanza"] = f"""
SELECT CAST(0 AS BIGINT) AS doc_id, seq, cuenta, nivel, cuenta_padre,
       CASE WHEN debe = haber THEN '' ELSE 'D' END AS naturaleza,
       'CUENTA ' || cuenta AS nombre,
       inicial AS saldo_ini_deudor, CAST(0.00 AS {M}) AS saldo_ini_acreedor, debe, haber,
       final AS saldo_fin_deudor, CAST(0.00 AS {M}) AS saldo_fin_acreedor,
       nivel < 3 AS es_acumulativa,
       CASE WHEN debe = haber THEN 'sin_determinar' ELSE 'derivada' END AS naturaleza_origen
FROM bal_rows"""

RELATIONS["totales"] = f"""
SELECT CAST(0 AS BIGINT) AS doc_id, CAST(SUM(debe) AS {M}) AS debe,
       CAST(SUM(haber) AS {M}) AS haber
FROM bal_rows WHERE nivel = 1"""

# The same rows as read from a single signed balance column, before nature is known.
RELATIONS["crudas"] = f"""
SELECT CAST(regionkey % 2 AS BIGINT) AS doc_id, seq, cuenta, 'CUENTA ' || cuenta AS nombre,
       CASE WHEN clave % 10 = 3 THEN 'A' WHEN clave % 10 = 4 THEN 'D' ELSE '' END AS naturaleza,
       '' AS marca,
       CASE WHEN regionkey % 2 = 1 THEN -inicial ELSE inicial END AS saldo_inicial,
       CASE WHEN clave % 6 = 5 THEN CAST(0.00 AS {M}) ELSE debe END AS debe,
       CASE WHEN clave % 6 = 5 THEN CAST(0.00 AS {M}) ELSE haber END AS haber,
       CAST(CASE WHEN regionkey % 2 = 1 THEN -1 ELSE 1 END
            * (CASE WHEN clave % 6 = 5 THEN inicial ELSE final END) AS {M}) AS saldo_final
FROM bal_rows"""

# A fixed-length catalogue whose last three digits declare the level.
RELATIONS["catalogo"] = """
SELECT CAST(0 AS BIGINT) AS doc_id, seq, cuenta FROM bal_rows
UNION ALL
SELECT CAST(1 AS BIGINT) AS doc_id, seq,
       rpad(replace(cuenta, '-', ''), 18, '0') || '00' || CAST(nivel AS STRING) AS cuenta
FROM bal_rows
UNION ALL
SELECT CAST(2 AS BIGINT) AS doc_id, seq, replace(cuenta, '-', '') AS cuenta FROM bal_rows
UNION ALL
SELECT CAST(3 AS BIGINT) AS doc_id, seq,
       CASE nivel WHEN 3 THEN cuenta WHEN 2 THEN cuenta || '-000000'
            ELSE cuenta || '-00-000000' END AS cuenta
FROM bal_rows
UNION ALL
SELECT CAST(4 AS BIGINT) AS doc_id, seq, rpad(replace(cuenta, '-', ''), 15, '0') AS cuenta
FROM bal_rows"""

# ------------------------------------------------------------- general ledger (M)
RELATIONS["may_grid"] = """
SELECT custkey, anio, {each_month} AS mes
FROM (SELECT DISTINCT o_custkey AS custkey, CAST(year(o_orderdate) AS BIGINT) AS anio FROM orders) k"""

RELATIONS["may_sums"] = f"""
SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS BIGINT) AS anio, month(o_orderdate) AS mes,
       SUM(CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(o_totalprice AS {M}) ELSE 0 END) AS cargos,
       SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS {M}) ELSE 0 END) AS abonos
FROM orders GROUP BY o_custkey, year(o_orderdate), month(o_orderdate)"""

RELATIONS["may_flow"] = f"""
SELECT g.custkey AS custkey, g.anio AS anio, CAST(g.mes AS INT) AS mes,
       CAST(COALESCE(cargos, 0) AS {M}) AS cargos, CAST(COALESCE(abonos, 0) AS {M}) AS abonos
FROM may_grid g LEFT JOIN may_sums s ON s.custkey = g.custkey AND s.anio = g.anio AND s.mes = g.mes"""

# Twelve rows per account: the window is bounded by construction.
RELATIONS["may_chain"] = f"""
SELECT custkey, anio, mes, cargos, abonos,
       CAST(SUM(cargos) OVER (PARTITION BY custkey, anio ORDER BY mes) AS {M}) AS ac,
       CAST(SUM(abonos) OVER (PARTITION BY custkey, anio ORDER BY mes) AS {M}) AS aa
FROM may_flow"""

_MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto",
           "Septiembre", "Octubre", "Noviembre", "Diciembre")
_MONTH_NAME = "CASE mes " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(_MONTHS, 1)) + " END"

RELATIONS["mayor_meses"] = f"""
SELECT (anio - 1992) * 16 + custkey % 16 AS doc_id, custkey * 16 + mes AS seq,
       CAST(1000000 + custkey AS STRING) AS cuenta, mes AS orden, {_MONTH_NAME} AS periodo,
       cargos, abonos,
       CASE WHEN (custkey + mes) % 31 = 0 THEN NULL ELSE CAST(500.00
            + CASE WHEN custkey % 4 = 0 THEN aa - ac ELSE ac - aa END
            + CASE WHEN (custkey + mes) % 101 = 0 THEN 1.00
                   WHEN (custkey + mes) % 103 = 0 THEN 0.01 ELSE 0.00 END AS {M}) END AS saldo,
       CASE WHEN (custkey + mes) % 37 = 0 THEN NULL ELSE ac END AS acum_cargos,
       CASE WHEN (custkey + mes) % 37 = 0 THEN NULL ELSE aa END AS acum_abonos,
       CAST(floor(custkey / 64) AS BIGINT) + 1 AS pagina
FROM may_chain"""

RELATIONS["mayor_base"] = f"""
SELECT DISTINCT (CAST(year(o_orderdate) AS BIGINT) - 1992) * 16 + o_custkey % 16 AS doc_id, o_custkey * 16 AS seq,
       CAST(1000000 + o_custkey AS STRING) AS cuenta,
       'CUENTA ' || CAST(o_custkey AS STRING) AS nombre_cuenta,
       CASE WHEN o_custkey % 113 = 0 THEN NULL ELSE CAST(500.00 AS {M}) END AS saldo_inicial,
       CAST(floor(o_custkey / 64) AS BIGINT) + 1 AS pagina_inicio
FROM orders"""

# The same months where odd documents were read without a single amount.
RELATIONS["may_zero"] = f"""
SELECT doc_id, seq, cuenta, orden, periodo,
       CASE WHEN doc_id % 2 = 1 THEN CAST(0.00 AS {M}) ELSE cargos END AS cargos,
       CASE WHEN doc_id % 2 = 1 THEN CAST(0.00 AS {M}) ELSE abonos END AS abonos,
       CASE WHEN doc_id % 2 = 1 THEN NULL ELSE saldo END AS saldo,
       CASE WHEN doc_id % 2 = 1 THEN NULL ELSE acum_cargos END AS acum_cargos,
       CASE WHEN doc_id % 2 = 1 THEN NULL ELSE acum_abonos END AS acum_abonos
FROM mayor_meses"""

# Trial balances paired with the ledgers: the same account key written with a dash.
RELATIONS["par_balanza"] = f"""
SELECT doc_id, MIN(seq) AS seq, substr(cuenta, 1, 3) || '-' || substr(cuenta, 4) AS cuenta,
       CAST(COALESCE(MAX(CASE WHEN orden = 12 THEN saldo END), 0) + CASE
            WHEN MIN(seq) % 32 = 17 THEN 1.00 ELSE 0.00 END AS {M}) AS saldo_fin_deudor,
       CAST(0.00 AS {M}) AS saldo_fin_acreedor
FROM mayor_meses WHERE seq % 5 <> 0 OR orden < 12 GROUP BY doc_id, cuenta"""

# ---------------------------------------------------------------- bank statement (C)
RELATIONS["est_flow"] = f"""
SELECT user_id % 8 AS doc_id, user_id, event_id, user_id * {EVENT_SPAN} + event_id AS seq,
       CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(100000 + user_id AS STRING) END AS num_cuenta,
       CAST(day(ts) AS STRING) AS dia, {_dmy('ts')} AS fecha,
       CASE WHEN event_id % 83 = 0 THEN 'SALDO ANTERIOR' ELSE event_type END AS descripcion,
       'REF' || CAST(event_id AS STRING) AS referencia,
       CASE WHEN event_id % 83 <> 0 AND event_type IN ('purchase', 'signup')
            THEN CAST(value AS {M}) ELSE CAST(0.00 AS {M}) END AS deposito,
       CASE WHEN event_id % 83 <> 0 AND event_type NOT IN ('purchase', 'signup')
            THEN CAST(value AS {M}) ELSE CAST(0.00 AS {M}) END AS retiro,
       CAST(floor(event_id / 400) AS BIGINT) + 1 AS pagina
FROM events"""

RELATIONS["est_day_end"] = """
SELECT user_id, fecha, MAX(event_id) AS ultimo FROM est_flow GROUP BY user_id, fecha"""

RELATIONS["est_base"] = f"""
SELECT *, CAST(2000.00 + SUM(deposito - retiro) OVER (
           PARTITION BY user_id ORDER BY event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {M}) AS cierto
FROM est_flow"""

RELATIONS["est_movs"] = f"""
SELECT b.doc_id, b.seq, b.num_cuenta, b.dia, b.fecha, b.descripcion, b.referencia,
       b.deposito, b.retiro,
       CASE WHEN b.user_id % 5 = 0 AND b.event_id <> e.ultimo THEN NULL
            WHEN b.event_id % 149 = 0 THEN CAST(b.cierto + 0.01 AS {M})
            ELSE b.cierto END AS saldo, b.pagina
FROM est_base b JOIN est_day_end e ON e.user_id = b.user_id AND e.fecha = b.fecha"""

RELATIONS["est_cuentas"] = f"""
SELECT user_id % 8 AS doc_id, user_id AS seq, num_cuenta,
       '01218000' || {_pad('user_id', 10)} AS clabe,
       'CUENTA ENLACE ' || CAST(user_id AS STRING) AS producto, 'MXN' AS moneda,
       CAST(2000.00 AS {M}) AS saldo_inicial,
       CASE WHEN user_id % 23 = 0 THEN NULL ELSE CAST(SUM(deposito) AS {M}) END AS depositos,
       CAST(SUM(retiro) AS {M}) AS retiros,
       CAST(2000.00 + SUM(deposito - retiro)
            + CASE WHEN user_id % 29 = 0 THEN 1.00 ELSE 0.00 END AS {M}) AS saldo_corte
FROM est_flow GROUP BY user_id, num_cuenta"""

RELATIONS["est_meta"] = f"""
SELECT doc_id, 'BANCA ' || CAST(doc_id AS STRING) AS banco, 'AAA010101AAA' AS rfc,
       '01 ENE 2024' AS periodo_ini, '31 ENE 2024' AS periodo_fin, '2024' AS anio,
       CASE WHEN doc_id = 6 THEN NULL ELSE CAST(SUM(saldo_inicial) AS {M}) END
            AS total_saldo_inicial,
       CASE WHEN doc_id >= 5 THEN NULL ELSE CAST(SUM(saldo_corte)
            + CASE WHEN doc_id = 3 THEN 0.01 WHEN doc_id = 4 THEN 7.00 ELSE 0.00 END AS {M}) END
            AS total_saldo_corte
FROM est_cuentas GROUP BY doc_id"""

# ------------------------------------------------------------------- words (W)
# A printed page holds the lines of eight consecutive orders of its document.
RELATIONS["w_slots"] = f"""
SELECT l_orderkey % 32 AS doc_id, CAST(floor(l_orderkey / 256) AS BIGINT) + 1 AS page,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(l_extendedprice AS {M}) AS precio,
       row_number() OVER (PARTITION BY l_orderkey % 32, floor(l_orderkey / 256)
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                     l_quantity, l_shipdate) AS r
FROM lineitem"""

# Every 9th row's name goes on in a line of its own, so it takes two slots.
RELATIONS["w_rows"] = f"""
SELECT *, r + CAST(floor((r - 1) / 9) AS BIGINT) AS linea, r % 9 = 0 AS envuelve,
       CAST(101 + l_suppkey % 9 AS STRING) || '-' || {_pad('l_partkey % 100', 2)} AS cuenta,
       CASE l_partkey % 5 WHEN 0 THEN 'Caja' WHEN 1 THEN 'Bancos' WHEN 2 THEN 'Clientes'
            WHEN 3 THEN 'Proveedores' ELSE 'Inventario' END AS nombre1,
       CASE l_suppkey % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'norte' ELSE 'sur' END AS nombre2,
       CAST(1000.00 + l_partkey % 500 AS {M}) AS ini,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(0.00 AS {M}) ELSE precio END AS debe,
       CASE WHEN l_linenumber % 3 = 0 THEN CAST(100.00 AS {M}) ELSE CAST(0.00 AS {M}) END AS haber
FROM w_slots"""

RELATIONS["w_texts"] = f"""
SELECT doc_id, page, linea, cuenta AS texto, 0 AS n, 26.0 AS izq, NULL AS der FROM w_rows
UNION ALL SELECT doc_id, page, linea, nombre1, 1, 128.0, NULL FROM w_rows
UNION ALL SELECT doc_id, page, linea, nombre2, 2, 132.0 + 3.11 * length(nombre1), NULL FROM w_rows
UNION ALL SELECT doc_id, page, linea + 1, 'continuado', 1, 128.0, NULL FROM w_rows WHERE envuelve
UNION ALL SELECT doc_id, page, linea, {_money_text('ini')}, 3, NULL, 287.0 FROM w_rows
UNION ALL SELECT doc_id, page, linea, {_money_text('debe')}, 4, NULL, 343.6 FROM w_rows
UNION ALL SELECT doc_id, page, linea, {_money_text('haber')}, 5, NULL, 400.3 FROM w_rows
UNION ALL SELECT doc_id, page, linea,
       {_money_text('ini + debe - haber + CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END')},
       6, NULL, 457.0 FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, 0, 'Cuenta', 0, 26.0, NULL FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, 0, 'Nombre', 1, 128.0, NULL FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, 0, 'Inicial', 3, NULL, 287.0 FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, 0, 'Debe', 4, NULL, 343.6 FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, 0, 'Haber', 5, NULL, 400.3 FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, 0, 'Final', 6, NULL, 457.0 FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, -1, 'Saldo', 3, NULL, 285.0 FROM w_rows
UNION ALL SELECT DISTINCT doc_id, page, -1, 'Saldo', 6, NULL, 455.0 FROM w_rows"""

_TOP = "CAST(60.0 + linea * 10.5 + (CASE WHEN linea > 0 THEN linea % 3 ELSE 0 END) * 0.4 AS DECIMAL(18,3))"
RELATIONS["words"] = f"""
SELECT doc_id, page, (linea + 1) * 8 + n AS pos, texto AS text,
       CAST(COALESCE(izq, der - 3.11 * length(texto)) AS DOUBLE) AS x0,
       CAST(COALESCE(der, izq + 3.11 * length(texto)) AS DOUBLE) AS x1,
       CAST({_TOP} AS DOUBLE) AS top, CAST({_TOP} + 8.0 AS DOUBLE) AS bottom,
       CAST(8.0 AS DOUBLE) AS size, linea <= 0 AS bold, 0 AS run
FROM w_texts"""

# ------------------------------------------------------------- formats and templates (T)
RELATIONS["lecturas"] = """
SELECT DISTINCT o_custkey % 16 AS doc_id, 't' || CAST(o_custkey % 4 AS STRING) AS tenant_id,
       'f' || CAST((o_custkey % 16) % 6 AS STRING) AS huella, 'polizas' AS tipo,
       'pdf_text' AS estrategia, 'diario' AS forma,
       CASE WHEN (o_custkey % 16) % 3 = 0 THEN 'vocabulario' ELSE 'aritmetica' END AS verificado_por,
       (o_custkey % 16) % 3 <> 0 AS orientacion_verificada,
       CAST((o_custkey % 16) % 3 AS BIGINT) * 7 AS filas_afectadas,
       3 + CAST(o_custkey % 2 AS INT) AS col_debe, 4 + CAST(o_custkey % 2 AS INT) AS col_haber
FROM orders"""

# ------------------------------------------------- printed cells, labels and dates (F)
# One amount in every notation, with the number it stands for.
RELATIONS["montos"] = f"""
SELECT o_orderkey AS k, CAST(o_totalprice AS {M}) AS v, o_orderkey % 10 AS forma,
       CASE o_orderkey % 10
         WHEN 0 THEN {_money_text('o_totalprice')}
         WHEN 1 THEN '-' || {_money_text('o_totalprice')}
         WHEN 2 THEN '$' || {_money_text('o_totalprice')}
         WHEN 3 THEN '$ ' || {_money_text('o_totalprice')}
         WHEN 4 THEN '(' || {_money_text('o_totalprice')} || ')'
         WHEN 5 THEN {_money_text('o_totalprice')} || '-'
         WHEN 6 THEN '  '
         WHEN 7 THEN 'Totales'
         WHEN 8 THEN '-$' || {_money_text('o_totalprice')} || ' '
         ELSE '.' || CAST(10 + o_orderkey % 89 AS STRING) END AS texto
FROM orders"""

# Cells of every shape a table column can hold.
RELATIONS["celdas_txt"] = f"""
SELECT o_orderkey AS k, CASE o_orderkey % 18
         WHEN 0 THEN {_dmy('o_orderdate')}
         WHEN 1 THEN {_money_text('o_totalprice')}
         WHEN 2 THEN '$' || {_money_text('o_totalprice')}
         WHEN 3 THEN {_money_text('o_totalprice')} || '-'
         WHEN 4 THEN CAST(o_orderkey AS STRING)
         WHEN 5 THEN CAST(o_orderkey * 1000003 + 1000000000 AS STRING)
         WHEN 6 THEN '101-' || {_pad('o_orderkey % 100', 2)}
         WHEN 7 THEN CAST(o_orderkey % 1000 AS STRING) || '.' || {_pad('o_orderkey % 100', 2)}
         WHEN 8 THEN '101.01.' || {_pad('o_orderkey % 100', 2)}
         WHEN 9 THEN '012180' || {_pad('o_orderkey', 12)}
         WHEN 10 THEN 'ABC' || {_pad('o_orderkey % 1000000', 6)} || 'XY1'
         WHEN 11 THEN '0000abcd-00EF-' || {_pad('o_orderkey', 4)}
         WHEN 12 THEN CAST(o_orderkey % 99 AS STRING) || '%'
         WHEN 13 THEN {_pad('o_orderkey', 4)} || '-' || {_pad('o_custkey', 6)}
         WHEN 14 THEN o_orderpriority
         WHEN 15 THEN ' ' || {_money_text('o_totalprice')} || ' '
         WHEN 16 THEN substr({_money_text('o_totalprice')}, 1, length({_money_text('o_totalprice')}) - 1)
         ELSE '-' || CAST(CAST(o_totalprice AS {M}) AS STRING) END AS texto
FROM orders"""

_MMM = "upper(substr(CASE month(o_orderdate) " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(_MONTHS, 1)) + " END, 1, 3))"
RELATIONS["fechas"] = f"""
SELECT o_orderkey AS k, o_orderkey % 7 AS forma, day(o_orderdate) AS d, month(o_orderdate) AS m,
       year(o_orderdate) AS a, CASE o_orderkey % 7
         WHEN 0 THEN CAST(day(o_orderdate) AS STRING)
         WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || '-' || {_MMM} || '-' || substr(CAST(year(o_orderdate) AS STRING), 3, 2)
         WHEN 2 THEN CAST(day(o_orderdate) AS STRING) || '/' || {_MMM} || './' || CAST(year(o_orderdate) AS STRING)
         WHEN 3 THEN CAST(day(o_orderdate) AS STRING) || ' ' || lower({_MMM})
         WHEN 4 THEN {_MMM} || '-' || CAST(day(o_orderdate) AS STRING)
         WHEN 5 THEN CAST(day(o_orderdate) AS STRING) || '-XYZ-20'
         ELSE 'PAGO ' || {_MMM} END AS texto,
       '01 ' || {_MMM} || ' ' || CAST(year(o_orderdate) AS STRING) AS ini,
       CASE WHEN o_orderkey % 3 = 0 THEN '05 DIC 2099' ELSE '28 ' || {_MMM} || ' ' || CAST(year(o_orderdate) AS STRING) END AS fin,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS STRING) ELSE '' END AS anio
FROM orders"""

# Headers as documents print them.
RELATIONS["rotulos"] = """
SELECT c_custkey AS k, CASE c_custkey % 16
         WHEN 0 THEN 'Saldo Inicial Deudor' WHEN 1 THEN 'SALDO FINAL ACREEDOR' WHEN 2 THEN 'No. Cuenta'
         WHEN 3 THEN 'Descripción de la operación' WHEN 4 THEN 'F E C H A' WHEN 5 THEN 'Debe'
         WHEN 6 THEN 'DEL MES *** * CREDITOS' WHEN 7 THEN 'Saldo final del periodo anterior'
         WHEN 8 THEN 'Depósitos / Abonos (+)' WHEN 9 THEN 'SaldoInicial' WHEN 10 THEN 'Retiros'
         WHEN 11 THEN 'Saldo al corte' WHEN 12 THEN 'Nombre de la cuenta' WHEN 13 THEN 'Naturaleza'
         WHEN 14 THEN 'Referencia' ELSE c_mktsegment END AS etiqueta
FROM customer"""

# ----------------------------------------------------------------- vocabularies (V)
def _values(rows: list[tuple]) -> str:
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells})"


# Roles of a trial balance with their synonyms, in claiming order.
_CTA = ("no cuenta", "num cuenta", "numero de cuenta", "numero cuenta", "cuenta contable", "codigo", "cuenta")
_NOM = ("nombre", "descripcion", "nombre de la cuenta", "concepto", "cuenta")
_NAT = ("naturaleza", "nat")
TRIAL_FORMS = {
    "deudor_acreedor": (
        ("cuenta", _CTA, True), ("naturaleza", _NAT, False), ("nombre", _NOM, True),
        ("saldo_ini_deudor", ("saldo inicial deudor", "saldo anterior deudor"), True),
        ("saldo_ini_acreedor", ("saldo inicial acreedor", "saldo anterior acreedor"), True),
        ("debe", ("debe", "cargos"), True), ("haber", ("haber", "abonos", "creditos"), True),
        ("saldo_fin_deudor", ("saldo final deudor", "saldo actual deudor"), True),
        ("saldo_fin_acreedor", ("saldo final acreedor", "saldo actual acreedor"), True)),
    "saldo_con_signo": (
        ("cuenta", _CTA, True), ("naturaleza", _NAT, False), ("nombre", _NOM, True),
        ("saldo_inicial", ("saldo anterior", "saldo inicial", "saldo previo"), True),
        ("debe", ("cargos", "debe"), True), ("haber", ("creditos", "abonos", "haber"), True),
        ("saldo_mes", ("saldo mes", "saldo del mes", "movimiento"), False),
        ("saldo_final", ("saldo actual", "saldo final"), True)),
}
# Subledger fields, synonyms, required, expected cell shape.
SUBLEDGER_FIELDS = (
    ("fecha", ("fecha", "folio fecha", "numerofecha"), True, "fecha"),
    ("folio", ("folio", "numero", "num", "no", "numerofecha", "folio fecha"), False, "entero"),
    ("tipo_movimiento", ("tipo", "tipo de movimiento"), False, "texto"),
    ("documento", ("documento", "referencia"), False, "texto"),
    ("tercero", ("tercero", "beneficiario"), False, "texto"),
    ("concepto", ("concepto", "concepto del movimiento", "descripcion"), False, "texto"),
    ("debe", ("debe", "cargos", "cargo"), True, "monto"),
    ("haber", ("haber", "abonos", "abono"), True, "monto"),
    ("saldo", ("saldo", "saldos", "saldo final"), True, "monto"))
# Statement table header, in priority order.
STATEMENT_FIELDS = (
    ("saldo", ("saldo",)), ("deposito", ("deposito", "abono")), ("retiro", ("retiro", "cargo")),
    ("fecha", ("fecha", "dia")), ("referencia", ("referencia", "folio", "docto")),
    ("descripcion", ("descripcion", "concepto", "establecimiento")))
# Accounts header of a statement, in priority order.
ACCOUNT_FIELDS = (
    ("saldo_inicial", ("saldo anterior", "mes anterior", "saldo inicial")),
    ("saldo_corte", ("saldo al corte", "mes actual", "saldo actual", "saldo final")),
    ("clabe", ("clabe",)),
    ("num_cuenta", ("no de cuenta", "numero de cuenta", "num de cuenta", "cuenta")),
    ("producto", ("producto", "instrumento")))
# How banks name the four balances, written tight, matched at the label end.
BALANCE_FIELDS = (
    ("saldo_inicial", ("saldoinicial", "saldoanterior", "balanceinicial", "saldoinicialdelperiodo",
                       "saldoinicialdel", "saldodeliquidacioninicial", "saldodeoperacioninicial",
                       "saldofinaldelperiodoanterior")),
    ("saldo_corte", ("saldoalcorte", "saldofinal", "saldoactual", "saldofinaldel",
                     "saldofinaldelacuenta", "saldototal")),
    ("depositos", ("depositos", "deposito", "depsitos", "abonos", "abono", "totalabonos",
                   "totaldedepositos", "depositosabonos")),
    ("retiros", ("retiros", "retiro", "cargos", "cargo", "totalcargos", "totalderetiros",
                 "retiroscargos")))

RELATIONS["vocab_balanza"] = _values(
    [(form, i, campo, int(req), s) for form, fields in TRIAL_FORMS.items()
     for i, (campo, syn, req) in enumerate(fields) for s in syn]) + " AS v(forma, orden, campo, obligatorio, sinonimo)"
RELATIONS["vocab_auxiliar"] = _values(
    [(i, campo, int(req), forma, s) for i, (campo, syn, req, forma) in enumerate(SUBLEDGER_FIELDS)
     for s in syn]) + " AS v(orden, campo, obligatorio, forma, sinonimo)"
RELATIONS["vocab_tabla"] = _values(
    [(i, campo, s) for i, (campo, syn) in enumerate(STATEMENT_FIELDS) for s in syn]) + " AS v(prioridad, campo, sinonimo)"
RELATIONS["vocab_cuentas"] = _values(
    [(i, campo, s) for i, (campo, syn) in enumerate(ACCOUNT_FIELDS) for s in syn]) + " AS v(prioridad, campo, sinonimo)"
RELATIONS["vocab_saldos"] = _values(
    [(campo, s) for campo, syn in BALANCE_FIELDS for s in syn]) + " AS v(campo, sinonimo)"

# ------------------------------------------------------ damaged words (WD, WG, CH, X)
RELATIONS["words_dup"] = """
SELECT doc_id, page, pos * 4 + c AS pos, text, x0 + 0.03 * (c - 1) AS x0, x1 + 0.03 * (c - 1) AS x1,
       top, bottom, size, bold, run
FROM (SELECT *, {each_copy} AS c FROM words) w"""

_EMMM = _MMM.replace("o_orderdate", "ts")
_GLUE = (f"{_pad('day(ts)', 2)} || '-' || {_EMMM} || '-' || CASE WHEN floor(event_id / 50) % 5 = 4 AND event_id % 2 = 0 "
         "THEN CAST(year(ts) AS STRING) ELSE substr(CAST(year(ts) AS STRING), 3, 2) END")
RELATIONS["words_glued"] = f"""
SELECT doc_id, page, pos, text, CAST(26.0 AS DOUBLE) AS x0,
       CAST(26.0 + 3.11 * length(text) AS DOUBLE) AS x1, CAST(10.0 * (pos % 50) AS DOUBLE) AS top,
       CAST(10.0 * (pos % 50) + 8 AS DOUBLE) AS bottom, CAST(8.0 AS DOUBLE) AS size, FALSE AS bold, 0 AS run
FROM (SELECT user_id % 8 AS doc_id, CAST(floor(event_id / 50) AS BIGINT) AS page, event_id AS pos,
       CASE event_id % 4 WHEN 0 THEN {_GLUE} || 'DEP.EFECTIVO' WHEN 1 THEN {_GLUE} || {_pad('event_id', 8)}
         WHEN 2 THEN CASE WHEN user_id % 2 = 1 THEN {_GLUE} ELSE 'PAGO' END ELSE event_type END AS text
      FROM events) g"""

# Glyphs of whole texts: a page holds 1,000 of them, a run restarts every 37.
RELATIONS["glyphs"] = """
SELECT doc_id, i, substr(text, CAST(i AS INT), 1) AS ch FROM (SELECT doc_id, text, {each_char} AS i FROM documents) c"""
RELATIONS["chars"] = """
SELECT doc_id, CAST(floor((i - 1) / 1000) AS BIGINT) AS page, CAST(i AS BIGINT) AS pos, ch,
       CAST(3.0 * ((i - 1) % 37) + CASE WHEN i % 11 = 0 THEN 1.5 ELSE 0.0 END AS DOUBLE) AS x0,
       CAST(3.0 * ((i - 1) % 37) + 3.0 AS DOUBLE) AS x1,
       CAST(10.0 * floor((i - 1) / 37) AS DOUBLE) AS top, CAST(10.0 * floor((i - 1) / 37) + 8.0 AS DOUBLE) AS bottom
FROM glyphs"""

# Second reading of every page: boxes in pixels at 300 dpi.
RELATIONS["tsv"] = """
SELECT doc_id, page, pos, CAST(floor(x0 * 300 / 72) AS BIGINT) AS izquierda, CAST(floor(top * 300 / 72) AS BIGINT) AS arriba,
       CAST(floor((x1 - x0) * 300 / 72) AS BIGINT) AS ancho, CAST(floor((bottom - top) * 300 / 72) AS BIGINT) AS alto,
       100 - pos % 70 AS confianza,
       CASE WHEN pos % 13 = 0 AND text LIKE '%.__' THEN substr(text, 1, length(text) - 1)
            WHEN pos % 29 = 0 THEN '   ' ELSE text END AS texto
FROM words"""
RELATIONS["reread"] = """
SELECT doc_id, page, pos, trim(texto) AS text, CAST(izquierda * 0.24 AS DOUBLE) AS x0,
       CAST((izquierda + ancho) * 0.24 AS DOUBLE) AS x1, CAST(arriba * 0.24 AS DOUBLE) AS top,
       CAST((arriba + alto) * 0.24 AS DOUBLE) AS bottom
FROM tsv WHERE trim(texto) <> '' AND confianza >= 40"""
# Words of which some came without a glyph map, some glued, some on top of another.
RELATIONS["words_cid"] = """
SELECT doc_id, page, pos, CASE WHEN doc_id % 8 = 7 OR pos % 197 = 0 THEN '(cid:12)(cid:7)'
       WHEN doc_id % 8 = 3 AND pos % 53 = 5 THEN 'SERDAN-228,200.69' WHEN doc_id % 8 = 4 AND pos % 59 = 6 THEN
       '1,185.22-227,015.47' ELSE text END AS text,
       x0 - CASE WHEN doc_id % 8 = 5 AND pos % 8 = 5 THEN 60 ELSE 0 END AS x0, x1, top, bottom
FROM words"""

# ------------------------------------------------------- printed documents (R)
def _signed_text(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' || {_money_text('-(' + x + ')')} ELSE {_money_text(x)} END)"


def _left(src: str, cols: str, text: str, x: float, pos: int, line: str, run: int = 1, where: str = "") -> str:
    return (f"SELECT {cols}, {line} AS line, {pos} AS pos, {text} AS text, CAST({x} AS DOUBLE) AS x0, "
            f"CAST({x} + 3.11 * length({text}) AS DOUBLE) AS x1, {run} AS run FROM {src}" + (f" WHERE {where}" if where else ""))


def _right(src: str, cols: str, text: str, edge: float, pos: int, line: str, where: str = "") -> str:
    return (f"SELECT {cols}, {line} AS line, {pos} AS pos, {text} AS text, CAST({edge} - 3.11 * length({text}) AS DOUBLE) AS x0, "
            f"CAST({edge} AS DOUBLE) AS x1, 2 AS run FROM {src}" + (f" WHERE {where}" if where else ""))


_U = " UNION ALL "
# Journals: one page per entry; even documents label their blocks, odd ones open them by name and hold no invoices. Theirs are
# printed in documents 17, 19, ... under labelled blocks without moves: a named block does not open after invoices.
RELATIONS["pj_movs"] = """
SELECT doc_id, poliza_id + 1 AS page, cuenta, nombre_cuenta, debe, haber, row_number() OVER (
       PARTITION BY doc_id, poliza_id ORDER BY orden, cuenta, debe, haber) AS r FROM movimientos"""
_head = "seq, poliza_id, tipo, naturaleza, fecha, descripcion, folio, total_debe, total_haber, completa, poliza_id + 1 AS page FROM polizas"
RELATIONS["pj_heads"] = f"SELECT doc_id, {_head} UNION ALL SELECT doc_id + 16, {_head} WHERE doc_id % 2 = 1"
RELATIONS["pj_cfdi"] = "SELECT doc_id + 16 * (doc_id % 2) AS doc_id, seq, fecha, documento, uuid, rfc, tipo, seq + 1 AS page FROM cfdi"
_c = "doc_id, page"
_even, _odd = "(doc_id % 2 = 0 OR doc_id > 16)", "(doc_id % 2 = 1 AND doc_id < 16)"
_ml = "10 + 2 * r + CASE WHEN r % 5 = 0 THEN 1 ELSE 0 END"
RELATIONS["pj_words"] = _U.join([
    _left("pj_heads", _c, "'Tipo'", 20, 0, "0", 1, _even), _left("pj_heads", _c, "'de'", 45, 1, "0", 1, _even),
    _left("pj_heads", _c, "'poliza:'", 60, 2, "0", 1, _even), _left("pj_heads", _c, "tipo", 130, 3, "0", 1, _even),
    _left("pj_heads", _c, "'Fecha'", 20, 0, "1", 1, _even), _left("pj_heads", _c, "fecha", 130, 1, "1", 1, _even),
    _left("pj_heads", _c, "'Descripción'", 20, 0, "2", 1, _even), _left("pj_heads", _c, "'FACT.'", 130, 1, "2", 1, _even),
    _left("pj_heads", _c, "'FOLIO:'", 160, 2, "2", 1, _even), _left("pj_heads", _c, "folio", 200, 3, "2", 1, _even),
    _left("pj_heads", _c, "tipo", 10, 0, "0", 1, _odd), _left("pj_heads", _c, "'cliente'", 60, 1, "0", 1, _odd),
    _left("pj_heads", _c, "fecha", 200, 2, "0", 2, _odd),
    _left("pj_movs", _c, "cuenta", 20, 0, "10 + 2 * r"), _left("pj_movs", _c, "nombre_cuenta", 60, 1, "10 + 2 * r"),
    _left("pj_movs", _c, "'largo'", 60, 0, "11 + 2 * r", 1, "r % 5 = 0"),
    _right("pj_movs", _c, _money_text("debe"), 400, 2, _ml, "debe <> 0"),
    _right("pj_movs", _c, _money_text("haber"), 500, 3, _ml, "haber <> 0"),
    _left("pj_heads", _c, "'Totales'", 20, 0, "1000000", 1, "completa AND total_debe IS NOT NULL"),
    _right("pj_heads", _c, _money_text("total_debe"), 400, 1, "1000000", "completa AND total_debe IS NOT NULL"),
    _right("pj_heads", _c, _money_text("total_haber"), 500, 2, "1000000", "completa AND total_debe IS NOT NULL"),
    _left("pj_cfdi", _c, "'CFDI'", 20, 0, "1000001"), _left("pj_cfdi", _c, "fecha", 20, 0, "1000002"),
    _left("pj_cfdi", _c, "CASE WHEN uuid = '' THEN 'Diario' ELSE documento END", 80, 1, "1000002"),
    _left("pj_cfdi", _c, "uuid", 150, 2, "1000002", 1, "uuid <> ''"), _left("pj_cfdi", _c, "rfc", 300, 3, "1000002", 1, "uuid <> ''"),
    _left("pj_cfdi", _c, "CASE WHEN uuid = '' THEN '(Manual)' ELSE tipo END", 400, 4, "1000002"),
    _left("pj_cfdi", _c, "'ABCD-12'", 150, 0, "1000003", 1, "uuid <> '' AND seq % 4 < 2")])

# General ledgers: one page per account.
RELATIONS["pm_heads"] = "SELECT *, CAST(cuenta AS BIGINT) - 999999 AS page FROM mayor_base"
RELATIONS["pm_months"] = "SELECT *, CAST(cuenta AS BIGINT) - 999999 AS page, orden + 1 AS ln FROM mayor_meses"
RELATIONS["pm_words"] = _U.join([
    _left("pm_heads", _c, "cuenta", 20, 0, "0"), _left("pm_heads", _c, "'BANCOS'", 90, 1, "0"),
    _left("pm_heads", _c, "'Inicial'", 20, 0, "1", 1, "saldo_inicial IS NOT NULL"),
    _right("pm_heads", _c, _money_text("saldo_inicial"), 120, 1, "1", "saldo_inicial IS NOT NULL"),
    _left("pm_heads", _c, "'Acumulados'", 430, 2, "1", 1, "saldo_inicial IS NOT NULL"),
    _left("pm_months", _c, "periodo", 20, 0, "ln"),
    _right("pm_months", _c, _signed_text("cargos"), 201, 1, "ln"), _right("pm_months", _c, _signed_text("abonos"), 280, 2, "ln"),
    _right("pm_months", _c, _signed_text("saldo"), 359, 3, "ln", "saldo IS NOT NULL"),
    _right("pm_months", _c, _signed_text("acum_cargos"), 440, 4, "ln", "acum_cargos IS NOT NULL"),
    _right("pm_months", _c, _signed_text("acum_abonos"), 520, 5, "ln", "acum_abonos IS NOT NULL")])

# Subledgers: one page per account run; odd accounts open by label, even ones by a row.
RELATIONS["pa_rows"] = f"""
SELECT *, CAST(floor(seq / {EVENT_SPAN}) AS BIGINT) + 1 AS page,
       CASE WHEN es_subtotal THEN {EVENT_SPAN - 100} ELSE CAST(folio AS BIGINT) * 4 + 10 END AS ln FROM auxiliar"""
RELATIONS["pa_runs"] = "SELECT DISTINCT doc_id, page, cuenta, CAST(cuenta AS BIGINT) % 2 AS tipo FROM pa_rows"


def _role(text: str, role: str) -> str:
    return f"SELECT *, {role} AS rol FROM ({text}) q"


_mv = "NOT es_subtotal"
RELATIONS["pa_words"] = _U.join([
    _role(_left("pa_runs", _c, "'Cuenta:'", 20, 0, "0", 1, "tipo = 1"), "''"),
    _role(_left("pa_runs", _c, "cuenta || '~7CUENTA'", 70, 1, "0", 1, "tipo = 1"), "''"),
    _role(_left("pa_runs", _c, "'larga'", 150, 2, "0", 1, "tipo = 1"), "''"),
    _role(_left("pa_runs", _c, "'Saldo'", 20, 0, "1", 1, "tipo = 1"), "''"),
    _role(_left("pa_runs", _c, "'Inicial:'", 50, 1, "1", 1, "tipo = 1"), "''"),
    _role(_right("pa_runs", _c, "'1,000.00'", 500, 2, "1", "tipo = 1"), "'saldo'"),
    _role(_left("pa_runs", _c, "cuenta", 20, 0, "0", 1, "tipo = 0"), "''"),
    _role(_left("pa_runs", _c, "'BANORTE'", 70, 1, "0", 1, "tipo = 0"), "''"),
    _role(_right("pa_runs", _c, "'1,000.00'", 500, 2, "0", "tipo = 0"), "'saldo'"),
    _role(_left("pa_rows", _c, "folio", 20, 0, "ln", 1, _mv), "'folio'"),
    _role(_left("pa_rows", _c, "fecha", 100, 1, "ln", 1, _mv), "'fecha'"),
    _role(_left("pa_rows", _c, "documento", 200, 2, "ln", 1, _mv), "'documento'"),
    _role(_left("pa_rows", _c, "concepto", 300, 3, "ln", 1, _mv), "'concepto'"),
    _role(_left("pa_rows", _c, "'sigue'", 300, 0, "ln + 1", 1, "NOT es_subtotal AND ln % 28 < 4"), "'concepto'"),
    _role(_left("pa_rows", _c, "'Total'", 20, 0, "ln", 1, "es_subtotal"), "''"),
    _role(_right("pa_rows", _c, _signed_text("debe"), 400, 4, "ln"), "'debe'"),
    _role(_right("pa_rows", _c, _signed_text("haber"), 450, 5, "ln"), "'haber'"),
    _role(_right("pa_rows", _c, _signed_text("saldo"), 500, 6, "ln", "saldo IS NOT NULL"), "'saldo'")])

# Trial balance cells: header repeated on every page, every ninth name goes on below.
RELATIONS["pb_rows"] = """
SELECT *, CAST(floor(seq / 1000000000000) AS BIGINT) AS page, (seq % 1000000000000) * 2 + 2 AS ln FROM balanza"""
RELATIONS["pb_cells"] = _U.join(
    ["SELECT DISTINCT doc_id, page, CAST(0 AS BIGINT) AS line, 0 AS idx, 'Cuenta' AS texto FROM pb_rows",
     "SELECT doc_id, page, ln, 0, cuenta FROM pb_rows",
     "SELECT doc_id, page, ln, 1, CASE WHEN es_acumulativa THEN nombre || ' Acum' ELSE nombre END FROM pb_rows",
     "SELECT doc_id, page, ln + 1, 1, 'continuado' FROM pb_rows WHERE ln % 18 = 2"]
    + [f"SELECT doc_id, page, ln, {i}, {_signed_text(m)} FROM pb_rows" for i, m in enumerate(
        ("saldo_ini_deudor", "saldo_ini_acreedor", "debe", "haber", "saldo_fin_deudor", "saldo_fin_acreedor"), 2)]
    + ["SELECT doc_id, 999999, CAST(1 AS BIGINT), 1, '734 Cuentas Totales:' FROM totales",
       f"SELECT doc_id, 999999, CAST(1 AS BIGINT), 4, {_signed_text('debe')} FROM totales",
       f"SELECT doc_id, 999999, CAST(1 AS BIGINT), 5, {_signed_text('haber')} FROM totales"])

# Trial balances with their headers, one document a nation, in six prints (nation % 6): two forms of balance, labels that
# occur twice, accumulated figures that look like the month's, figures that fit no mapping, and missing columns.
TRIAL_PRINTS = (
    (("Cuenta", "cuenta"), ("Nombre", "nombre"), ("Saldo Inicial Deudor", "inicial"), ("Saldo Inicial Acreedor", "0.00"), ("Debe", "debe"),
     ("Haber", "haber"), ("Saldo Final Deudor", "final"), ("Saldo Final Acreedor", "0.00")),
    (("No. Cuenta", "cuenta"), ("Nombre de la cuenta", "nombre"), ("Saldo Anterior", "inicial"), ("Cargos", "debe"), ("Abonos", "haber"),
     ("Saldo Actual", "final")),
    (("Cuenta", "cuenta"), ("Descripción", "nombre"), ("Saldo Anterior", "inicial"), ("Cargos", "debe * 3 + 17.25"), ("Abonos", "haber * 2 + 8.50"),
     ("Cargos", "debe"), ("Abonos", "haber"), ("Saldo Actual", "final")),
    (("Codigo", "cuenta"), ("Concepto", "nombre"), ("Saldo Inicial", "inicial"), ("Abonos", "haber"), ("Cargos", "debe"), ("Saldo Mes", "debe - haber"),
     ("Saldo Final", "final")),
    (("Cuenta", "cuenta"), ("Cuenta", "nombre"), ("Saldo Anterior", "inicial"), ("Cargos", "debe"), ("Abonos", "haber"), ("Saldo Actual", "final + 1000")),
    (("Cuenta", "cuenta"), ("Nombre", "nombre"), ("Importe", "inicial"), ("Debe", "debe"), ("Otro", "haber")))
RELATIONS["pt_base"] = """
SELECT CAST(floor(seq / 1000000000000) AS BIGINT) % 100 - 1 AS doc_id, CAST(floor((seq % 1000000000000) / 1000) AS BIGINT) AS page, seq, cuenta,
       'CUENTA_' || CAST(clave AS STRING) AS nombre, inicial, debe, haber, final FROM bal_rows WHERE nivel > 1"""
RELATIONS["pt_rows"] = "SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS line FROM pt_base"
RELATIONS["pt_pages"] = "SELECT DISTINCT doc_id, page FROM pt_base"


def printed_table(rows: str, pages: str, prints: tuple, kind: str, lefts: dict, first: float, pitch: float, number, signed: dict) -> str:
    """Header and rows of every print: text columns open at their place in ``lefts``, amounts end every ``pitch`` points from ``first`` on.

    Labels of three words take two lines."""
    parts = []
    for f, columns in enumerate(prints):
        mine, edge = f"{kind} = {f}", first
        for i, (label, source) in enumerate(columns):
            text, x0 = source in lefts, 0.0
            if text:
                x0 = lefts[source]
                parts.append(_left(rows, _c, source, x0, i, "line", 1, mine))
            else:
                value = f"CAST({source} AS {M})"
                parts.append(_right(rows, _c, number(value), edge, i, "line", " AND ".join([mine, *signed.get(source, [])])))
                edge += pitch
            words = label.split()
            above = words[:-1] if len(words) == 3 and not text else []
            for n, row in ((-1, above), (0, words[len(above):])):
                for k, w in enumerate(row):
                    at = (x0 if text else edge - pitch - 3.11 * len(" ".join(row))) + 3.11 * sum(len(v) + 1 for v in row[:k])
                    parts.append(_left(pages, _c, f"'{w}'", round(at, 2), 10 * i + k, str(n), 1, mine))
    return _U.join(parts)


RELATIONS["pt_words"] = ("SELECT doc_id, page, line * 1000 + pos AS pos, text, x0, x1, CAST(30 + 10 * line AS DOUBLE) AS top, "
    "CAST(38 + 10 * line AS DOUBLE) AS bottom, CAST(8.0 AS DOUBLE) AS size, line <= 0 AS bold, run FROM ("
    + printed_table("pt_rows", "pt_pages", TRIAL_PRINTS, "doc_id % 6", {"cuenta": 20.0, "nombre": 110.0}, 290.0, 85.0, _signed_text, {}) + ") w")

# Subledgers with their headers, in three prints (document % 3): plain labels, two labels run together, labels left out.
SUBLEDGER_PRINTS = (
    (("Folio", "folio"), ("Fecha", "fecha"), ("Documento", "documento"), ("Concepto", "concepto"), ("Debe", "debe"), ("Haber", "haber"), ("Saldo", "saldo")),
    (("NumeroFecha", "folio"), ("", "fecha"), ("Referencia", "documento"), ("Concepto", "concepto"), ("Cargos", "debe"), ("Abonos", "haber"), ("Saldo", "saldo")),
    (("", "folio"), ("", "fecha"), ("Documento", "documento"), ("Concepto", "concepto"), ("Cargo", "debe"), ("", "haber"), ("", "saldo")))
RELATIONS["ps_base"] = f"""
SELECT doc_id, CAST(floor(seq / {EVENT_SPAN}) AS BIGINT) * 100000 + pagina AS page, seq, cuenta, folio, fecha, 'DOC' || documento AS documento,
       'C' || concepto AS concepto, debe, haber, saldo FROM auxiliar WHERE NOT es_subtotal"""
RELATIONS["ps_rows"] = "SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS line FROM ps_base"
RELATIONS["ps_pages"] = "SELECT DISTINCT doc_id, page FROM ps_base"
RELATIONS["ps_words"] = ("SELECT doc_id, page, line * 1000 + pos AS pos, text, x0, x1, CAST(30 + 10 * line AS DOUBLE) AS top, "
    "CAST(38 + 10 * line AS DOUBLE) AS bottom, CAST(8.0 AS DOUBLE) AS size, line <= 0 AS bold, run FROM ("
    + printed_table("ps_rows", "ps_pages", SUBLEDGER_PRINTS, "doc_id % 3", {"folio": 20.0, "fecha": 80.0, "documento": 150.0, "concepto": 220.0},
                    400.0, 80.0, _signed_text, {"saldo": ["saldo IS NOT NULL"]}) + ") w")

# Bank statements: identity, accounts table, then one page per account.
RELATIONS["pe_acc"] = """
SELECT doc_id, CAST(2 AS BIGINT) AS page, seq + 10 AS ln, seq + 10 AS own, CASE WHEN num_cuenta = '' THEN '' ELSE '5500' || num_cuenta END AS num,
       'N' || CAST(seq AS STRING) AS nombre, saldo_inicial, saldo_corte FROM est_cuentas"""
RELATIONS["pe_sec"] = "SELECT doc_id, own AS page, nombre FROM pe_acc"
RELATIONS["pe_movs"] = f"""
SELECT doc_id, CAST(floor(seq / {EVENT_SPAN}) AS BIGINT) + 10 AS page, (seq % {EVENT_SPAN}) * 4 + 10 AS ln, dia, descripcion, referencia,
       deposito, retiro, saldo, seq FROM est_movs"""
RELATIONS["pe_docs"] = "SELECT doc_id, CAST(1 AS BIGINT) AS page FROM est_meta"
_I = [("0", ["'BANCA'", "'UNO,'", "'Institución'", "'de'", "'Banca'"]), ("1", ["'RFC:'", "'AAA010101AAA'"]),
      ("2", ["'PERIODO'", "'DEL'", "'01'", "'ENE'", "'2024'", "'AL'", "'31'", "'ENE'", "'2024'"]),
      ("3", ["'Moneda:'", "'NACIONAL'"]), ("4", ["'CUENTA'", "'CONECTA'", "'00112233-4'"]), ("5", ["'CLABE'", "'012180001234567890'"])]
RELATIONS["pe_words"] = _U.join(
    [_left("pe_docs", _c, w, 20 + 45 * i, i, ln) for ln, ws in _I for i, w in enumerate(ws)]
    + [_left("pe_docs", _c, "'AV.'", 30, 9, "0", 2), _left("pe_docs", _c, "'REFORMA'", 70, 10, "0", 2)]
    + [_left("pe_docs", "doc_id, CAST(2 AS BIGINT) AS page", w, x, i, "1") for i, (w, x) in enumerate(
        [("'Producto'", 20), ("'Cuenta'", 150), ("'Saldo'", 245), ("'anterior'", 263), ("'Saldo'", 345), ("'al'", 363), ("'corte'", 372)])]
    + [_left("pe_acc", _c, "'ENLACE'", 20, 0, "ln"), _left("pe_acc", _c, "nombre", 50, 1, "ln"), _left("pe_acc", _c, "num", 150, 2, "ln", 1, "num <> ''"),
       _right("pe_acc", _c, _signed_text("saldo_inicial"), 290, 3, "ln"), _right("pe_acc", _c, _signed_text("saldo_corte"), 388, 4, "ln"),
       _left("pe_docs", "doc_id, CAST(2 AS BIGINT) AS page", "'TOTAL'", 20, 0, "4000000000"),
       _right("est_meta", "doc_id, CAST(2 AS BIGINT) AS page", _signed_text("total_saldo_inicial"), 290, 1, "4000000000", "total_saldo_inicial IS NOT NULL"),
       _right("est_meta", "doc_id, CAST(2 AS BIGINT) AS page", _signed_text("total_saldo_corte"), 388, 2, "4000000000", "total_saldo_corte IS NOT NULL"),
       _left("pe_sec", _c, "'ENLACE'", 20, 0, "0"), _left("pe_sec", _c, "nombre", 50, 1, "0")]
    + [_left("pe_sec", _c, w, x, i, "1") for i, (w, x) in enumerate(
        [("'Fecha'", 20), ("'Descripción'", 80), ("'Referencia'", 250), ("'Retiros'", 358), ("'Depósitos'", 422), ("'Saldo'", 504)])]
    + [_left("pe_movs", _c, "dia || '-ENE'", 20, 0, "ln"), _left("pe_movs", _c, "descripcion", 80, 1, "ln"), _left("pe_movs", _c, "referencia", 245, 2, "ln"),
       _left("pe_movs", _c, "'sigue'", 80, 0, "ln + 1", 1, "ln % 24 = 10"), _left("pe_movs", _c, "'pie'", 80, 0, "ln + 3", 1, "ln % 124 = 10"),
       _right("pe_movs", _c, _signed_text("retiro"), 380, 3, "ln", "retiro <> 0"), _right("pe_movs", _c, _signed_text("deposito"), 450, 4, "ln", "deposito <> 0"),
       _left("pe_movs", _c, "'-$'", 480, 5, "ln", 1, "saldo < 0"), _right("pe_movs", _c, _money_text("abs(saldo)"), 520, 6, "ln", "saldo IS NOT NULL")])

# -------------------------------------------------------------------- job log (J)
RELATIONS["trabajos"] = """
SELECT event_id AS id, 't' || CAST(user_id % 5 AS STRING) AS tenant,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'en_cola'
            WHEN 'view' THEN 'procesando' WHEN 'signup' THEN 'con_discrepancias'
            ELSE 'listo' END AS estado, ts AS creado
FROM events"""


# How each engine spells the row generators.
_SPARK = {"{each_month}": "explode(sequence(1, 12))",
          "{each_copy}": "explode(sequence(1, CAST(1 + doc_id % 3 AS INT)))"}
_ANSI = {"{each_month}": "unnest(generate_series(1, 12))",
         "{each_copy}": "unnest(generate_series(1, 1 + doc_id % 3))",
         "{each_char}": "unnest(generate_series(1, length(text)))"}


def _for_engine(text: str, spelling: dict[str, str]) -> str:
    for token, words in spelling.items():
        text = text.replace(token, words)
    return text


def closure(names: list[str]) -> list[str]:
    """The relations ``names`` need, dependencies first."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done or n not in RELATIONS:
            return
        for dep in re.findall(r"[a-z_0-9]+", RELATIONS[n]):
            if dep in RELATIONS and dep != n:
                visit(dep)
        done.append(n)

    for n in names:
        visit(n)
    return done


# Typed tables that a corpus keeps stored: they are read several times per query.
STORED = {"polizas", "movimientos", "auxiliar", "est_movs", "mayor_meses", "w_rows", "words", "pj_heads", "pj_movs", "tsv", "pj_words", "pm_words", "pa_words",
          "pb_cells", "pe_words", "pt_words", "ps_words"}
_stored: dict[tuple[str, str, str], DataFrame] = {}


class Corpus:
    """The relations over one data folder, built lazily as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in RELATIONS and name not in TABLES):
            raise AttributeError(name)
        if name in STORED:
            key = (self.spark.sparkContext.applicationId, self.folder, name)
            if key not in _stored:
                _stored[key] = stage(self._build(name))
            return _stored[key]
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "aux_moves":
            out = ordered_scan(
                self.aux_base, ["doc_id", "user_id", "mitad"], "event_id",
                running={"_acum": F.col("signo") * (F.col("debe") - F.col("haber"))})
            return out.withColumn(
                "cierto", (F.lit(1000).cast(M) + F.col("_acum")).cast(M)).drop("_acum")
        if name == "est_base":
            out = ordered_scan(self.est_flow, ["doc_id", "user_id"], "event_id",
                               running={"_acum": F.col("deposito") - F.col("retiro")})
            return out.withColumn(
                "cierto", (F.lit(2000).cast(M) + F.col("_acum")).cast(M)).drop("_acum")
        if name == "glyphs":  # one pass over each text; substr per position would be quadratic
            return self.documents.select(
                "doc_id", F.posexplode(F.split("text", "")).alias("p", "ch")).select(
                "doc_id", (F.col("p") + 1).alias("i"), "ch")
        text = _for_engine(RELATIONS[name], _SPARK)
        deps = {d: getattr(self, d) for d in set(re.findall(r"[a-z_0-9]+", text))
                if d != name and (d in RELATIONS or d in TABLES)
                and re.search(rf"\b(FROM|JOIN)\s+{d}\b", text)}
        for d in deps:
            text = re.sub(rf"\b(FROM|JOIN)\s+{d}\b(?!\s*\.)(\s+[a-z]\b)?",
                          lambda m, d=d: f"{m[1]} {{{d}}}" + (m[2] or f" AS {d}"), text)
        return self.spark.sql(text, **deps)


def oracle_ctes(names: list[str]) -> str:
    """``name AS (...)`` items for the checking engine."""
    return ",\n".join(f"{n} AS ({_for_engine(RELATIONS[n], _ANSI)})" for n in closure(names))
