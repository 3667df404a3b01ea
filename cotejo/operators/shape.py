"""Result shaping: O1-O9."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators.verdict import FALLA

# Kinds by name, in presentation order (fixed values).
KINDS = ("balanza", "auxiliar", "polizas", "estado-cuenta", "mayor")


def journal_heads(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """O1: declared beside read totals; ``completa`` needs a closed block AND equal figures."""
    f = F.col
    same = (f("total_debe") == f("leido_debe")) & (f("total_haber") == f("leido_haber"))
    j = entries.join(totals, ["doc_id", "poliza_id"], "left")
    return j.select(
        "doc_id", "poliza_id", "tipo", "naturaleza", "fecha", "descripcion", "folio",
        f("total_debe").alias("total_debe_declarado"), f("leido_debe").alias("total_debe_leido"),
        f("total_haber").alias("total_haber_declarado"), f("leido_haber").alias("total_haber_leido"),
        (f("completa") & F.coalesce(same, F.lit(False))).alias("completa"))


def ledger_heads(heads: DataFrame, totals: DataFrame) -> DataFrame:
    """O2."""
    f = F.col
    j = heads.join(totals, ["doc_id", "cuenta"], "left")
    return j.select(
        "doc_id", "cuenta", "nombre_cuenta", "saldo_inicial", "saldo_final",
        f("total_cargos").alias("total_cargos_declarado"), f("leido_cargos").alias("total_cargos_leido"),
        f("total_abonos").alias("total_abonos_declarado"), f("leido_abonos").alias("total_abonos_leido"),
        "naturaleza", "pagina_inicio")


def flat(detail: DataFrame, heads: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """O3: header columns repeated on each detail row; detail without a header stays."""
    return detail.join(heads.select(*keys, *columns), list(keys), "left")


def top_discrepancies(disc: DataFrame, keys: Sequence[str] = ("doc_id",), k: int = 50) -> DataFrame:
    """The first ``k`` per document in rule order, with the total.

    ``row_number <= k`` becomes a group limit before the shuffle.
    """
    f = F.col
    w = Window.partitionBy(*keys).orderBy("n_regla", "indice", "fila", "subregla", "esperado", "obtenido")
    top = disc.withColumn("lugar", F.row_number().over(w)).filter(f("lugar") <= k)
    total = disc.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_discrepancias"))
    numeric = f("esperado").isNotNull()

    def text(c: str) -> Column:
        return F.when(numeric, F.format_number(c, 2)).otherwise("")

    return top.join(total, list(keys)).select(
        *keys, "lugar", "fila", f("subregla").alias("regla"), numeric.alias("numerica"),
        text("esperado").alias("esperado"), text("obtenido").alias("obtenido"),
        "total_discrepancias")


def rule_line() -> Column:
    """The summary line of one rule, always with its denominator."""
    f = F.col
    parts = F.concat_ws(
        ", ", F.format_string("%d de %d evaluados", "evaluados", "aplicables"),
        F.format_string("%d exactos", "exactas"),
        F.when(f("exactas_recalculadas") > 0, F.format_string(
            "%d contra dato impreso y %d contra saldo recalculado por el sistema",
            "exactas_impresas", "exactas_recalculadas")),
        F.when(f("con_tolerancia") > 0, F.format_string("%d dentro de tolerancia", "con_tolerancia")),
        F.when(f("discrepancias") > 0, F.format_string("%d con diferencia", "discrepancias")))
    return F.when(f("aplicables").isNull(), F.concat(f("regla"), F.lit(": universo sin determinar"))
                  ).otherwise(F.concat(f("regla"), F.lit(": "), parts))


def rule_records(results: DataFrame) -> DataFrame:
    """Every count of a rule and its line."""
    return results.withColumn("linea", rule_line())


def rule_records_json(results: DataFrame) -> DataFrame:
    """O5 as one JSON text per rule."""
    r = rule_records(results)
    cols = [c for c in r.columns if c not in ("doc_id", "n_regla")]
    return r.select("doc_id", "regla", F.to_json(F.struct(*cols)).alias("registro"))


def exit_codes(cover: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """1 if any rule failed, else 0."""
    return cover.select(*keys, F.when(F.col("fallan") > 0, 1).otherwise(0).alias("codigo"))


def kind_known(name: Column) -> Column:
    """Is this one of the kinds that can be processed?"""
    return name.isin(*KINDS)


# --- O6: per-kind document summaries -----------------------------------------------
def trial_summary(b: DataFrame, levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    n = F.col("nivel")
    return b.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("filas"),
        *[F.count_if(n == k).alias(f"nivel_{k}") for k in levels],
        F.count_if(~n.isin(*levels)).alias("otros_niveles"))


def subledger_summary(aux: DataFrame) -> DataFrame:
    return aux.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if("es_subtotal").alias("subtotales"),
        F.count_if(F.col("saldo").isNotNull()).alias("legibles"),
        F.count_if(F.col("saldo").isNull()).alias("sin_saldo"))


def journal_summary(entries: DataFrame, moves: DataFrame, cfdi: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    e = entries.groupBy("doc_id").agg(one.alias("polizas"),
                                      F.count_if(~F.col("completa")).alias("sin_cerrar"))
    m = moves.groupBy("doc_id").agg(one.alias("movimientos"))
    c = cfdi.groupBy("doc_id").agg(one.alias("cfdi"))
    return (e.join(m, "doc_id", "left").join(c, "doc_id", "left")
            .na.fill(0, ["movimientos", "cfdi"]))


def bank_summary(accounts: DataFrame, moves: DataFrame) -> DataFrame:
    """One row per account: its name, moves and closing balance."""
    f = F.col
    n = moves.groupBy("doc_id", "num_cuenta").agg(F.count(F.lit(1)).alias("movimientos"))
    label = (F.when(f("producto") != "", f("producto"))
             .when(f("num_cuenta") != "", f("num_cuenta")).otherwise("(sin identificar)"))
    return accounts.join(n, ["doc_id", "num_cuenta"], "left").na.fill(0, ["movimientos"]).select(
        "doc_id", "seq", label.alias("etiqueta"), "movimientos", "saldo_corte")


def ledger_summary(heads: DataFrame, months: DataFrame) -> DataFrame:
    h = heads.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("cuentas"),
        F.count_if(F.col("naturaleza") == "").alias("sin_naturaleza"))
    m = months.groupBy("doc_id").agg(F.count(F.lit(1)).alias("meses"))
    return h.join(m, "doc_id", "left").na.fill(0, ["meses"])


# --- O8, O9 -------------------------------------------------------------------------
def template_state() -> Column:
    """no / pendiente / reutilizada / aprendida."""
    f = F.col
    return (F.when(f("pendiente").isNull(), "no").when(f("pendiente"), "pendiente")
            .when(f("reutilizada"), "reutilizada").otherwise("aprendida"))


def inventory(expected: DataFrame, cover: DataFrame, rejected: DataFrame,
              templates: DataFrame) -> DataFrame:
    """Every expected document once, as accepted, rejected or absent.

    ``templates`` carries (tipo, doc_id, pendiente, reutilizada). Order by (grupo, tipo, doc_id).
    """
    f = F.col
    key = ["tipo", "doc_id"]
    j = (expected.select(*key).join(rejected.select(*key, "motivo"), key, "left")
         .join(cover, key, "left").join(templates, key, "left"))
    out = f("motivo").isNotNull()
    inn = ~out & f("evaluados").isNotNull()
    return j.select(
        *key, F.when(out, "rechazado").when(inn, "aceptado").otherwise("ausente").alias("grupo"),
        F.when(inn, F.format_string("%d de %d", "evaluados", "aplicables")).alias("cobertura"),
        F.when(inn, F.format_string("%d/%d/%d", "cuadran", "fallan", "no_verificables")).alias("reglas"),
        F.when(inn, template_state()).alias("plantilla"),
        F.when(inn, F.when(f("fallan") > 0, 1).otherwise(0)).alias("codigo"), "motivo")


def rejections(docs: DataFrame, typed: DataFrame, reasons: DataFrame) -> DataFrame:
    """Documents whose typed table is empty, with the key, the reason and all evidence lines.

    ``reasons`` carries (tipo, doc_id, clave, motivo, evidencia array).
    """
    f = F.col
    key = ["tipo", "doc_id"]
    empty = docs.select(*key).join(typed.select(*key).distinct(), key, "left_anti")
    default = F.format_string("no se encontro ninguna tabla de %s en el documento", f("tipo"))
    return empty.join(reasons, key, "left").select(
        *key, F.coalesce("clave", F.lit("no_reconocido")).alias("clave"),
        F.coalesce("motivo", default).alias("motivo"),
        F.coalesce(F.array_join("evidencia", " | "), F.lit("")).alias("evidencia"))


def failing(results: DataFrame) -> DataFrame:
    return results.filter(F.col("estado") == FALLA)
