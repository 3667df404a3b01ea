"""Journal rules: V9 double entry, V10 declared totals, V11/V12 invoices (and A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F

from cotejo.operators.verdict import BAD, EXACT, MONEY, Rule, compare, money

KEY = ["doc_id", "poliza_id"]


def entry_totals(moves: DataFrame) -> DataFrame:
    """What was read per entry. Partial sums run before the shuffle."""
    return moves.groupBy(*KEY).agg(
        money(F.sum("debe")).alias("leido_debe"), money(F.sum("haber")).alias("leido_haber"),
        F.count(F.lit(1)).alias("n_movs"))


def _gap(parts: list) -> F.Column:
    return F.concat_ws("; ", *parts)


def double_entry(entries: DataFrame, totals: DataFrame) -> Rule:
    """V9: debits equal credits in every complete entry; the others stay in the universe."""
    j = entries.join(totals, KEY, "left")
    frame = j.select(
        "doc_id", "seq", F.col("poliza_id").cast("string").alias("fila"),
        F.lit("partida_doble").alias("subregla"),
        F.col("leido_debe").alias("esperado"), F.col("leido_haber").alias("obtenido"),
        F.when(F.col("completa"), compare(F.col("leido_debe"), F.col("leido_haber")))
        .alias("veredicto"),
        F.col("completa"), F.col("n_movs").isNull().alias("vacia"))

    def reason():
        return _gap([
            F.when(F.col("n_inc") > 0, F.format_string(
                "%d de %d polizas no cerraron dentro de lo leido", "n_inc", "aplicables")),
            F.when(F.col("n_vacias") > 0, F.format_string(
                "%d de %d polizas no trajeron ningun movimiento", "n_vacias", "aplicables"))])

    return Rule(
        "partida_doble", frame,
        counts={"n_inc": F.count_if(~F.col("completa")),
                "n_vacias": F.count_if(F.col("completa") & F.col("vacia"))},
        reason=reason,
        reason_none=lambda: F.when(F.col("n_inc") == F.col("aplicables"),
                                   "ninguna poliza cerro dentro de lo leido")
        .otherwise(reason()))


def declared_totals(entries: DataFrame, totals: DataFrame) -> Rule:
    """Printed totals against read sums; two cases per entry."""
    j = entries.join(totals, KEY, "left")
    usable = F.col("completa") & F.col("total_debe").isNotNull() & F.col("n_movs").isNotNull()
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"totales_{s}").alias("subregla"), F.col(f"leido_{s}").alias("esperado"),
                 F.col(f"total_{s}").alias("obtenido")) for s in ("debe", "haber")]))
    rows = j.select(
        "doc_id", "seq", F.col("poliza_id").cast("string").alias("fila"), usable.alias("usable"),
        (F.col("completa") & F.col("total_debe").isNotNull()).alias("con_totales"),
        sides.alias("s"))
    frame = rows.select(
        "doc_id", "seq", "fila", "con_totales", "s.*",
        F.when(F.col("usable"), compare(F.col("s.esperado"), F.col("s.obtenido")))
        .alias("veredicto"))
    gap = F.format_string(
        "%d de %d polizas no declaran totales o no cerraron dentro de lo leido",
        F.expr("(aplicables - evaluados) div 2"), F.expr("aplicables div 2"))
    return Rule(
        "totales", frame, counts={"n_con": F.count_if(F.col("con_totales"))},
        reason=lambda: F.when(F.col("evaluados") < F.col("aplicables"), gap),
        reason_none=lambda: F.when(
            F.col("n_con") == 0, "ninguna poliza declara totales dentro de lo leido")
        .otherwise("ninguna poliza con totales trajo movimientos"))


_NO_CFDI = "el documento no trae tabla de CFDI"


def invoices_attached(cfdi: DataFrame, entries: DataFrame) -> Rule:
    """Every invoice points to an entry that exists in its own document."""
    known = entries.select(*KEY, F.lit(True).alias("existe"))
    j = cfdi.join(known, KEY, "left")
    fila = F.when(F.col("uuid") != "", F.col("uuid")).otherwise(F.col("documento"))
    frame = j.select(
        "doc_id", F.lit(-1).alias("seq"), fila.alias("fila"), F.lit("cfdi").alias("subregla"),
        F.lit(None).cast(MONEY).alias("esperado"),
        F.lit(None).cast(MONEY).alias("obtenido"),
        F.when(F.col("existe"), EXACT).otherwise(BAD).alias("veredicto"))
    return Rule("cfdi", frame, empty=_NO_CFDI)


def invoices_crossed(cfdi: DataFrame, entries: DataFrame) -> Rule:
    """The invoice number is contained in the description of its entry.

    The equi key finds the entry; containment is then tested on that one row.
    """
    j = cfdi.join(entries.select(*KEY, "descripcion"), KEY, "left")
    comparable = (F.col("documento") != "") & (F.coalesce("descripcion", F.lit("")) != "")
    frame = j.select(
        "doc_id", F.lit(-1).alias("seq"), F.col("poliza_id").cast("string").alias("fila"),
        F.lit("cfdi_cruzado").alias("subregla"),
        F.lit(None).cast(MONEY).alias("esperado"),
        F.lit(None).cast(MONEY).alias("obtenido"),
        F.when(comparable, F.when(F.col("descripcion").contains(F.col("documento")), EXACT)
               .otherwise(BAD)).alias("veredicto"),
        (F.col("uuid") == "").alias("sin_uuid"))

    def reason():
        lost = F.col("aplicables") - F.col("evaluados")
        return F.when(lost > 0, F.concat(
            F.format_string("%d de %d CFDI sin numero de documento con el que cruzar",
                            lost, F.col("aplicables")),
            F.when(F.col("n_sin") > 0, F.format_string(
                "; %d de ellos no traen folio fiscal, o sea son polizas manuales sin "
                "comprobante", "n_sin")).otherwise("")))

    return Rule(
        "cfdi_cruzado", frame, counts={"n_sin": F.count_if(F.col("sin_uuid"))},
        reason=reason, empty=_NO_CFDI,
        reason_none=lambda: F.lit("ni el CFDI ni la poliza traen un numero de documento "
                                  "con el que cruzarlos"))


def journal_rules(entries: DataFrame, moves: DataFrame, cfdi: DataFrame) -> list[Rule]:
    """V22 for journals, in rule order."""
    t = entry_totals(moves)
    return [double_entry(entries, t), declared_totals(entries, t),
            invoices_attached(cfdi, entries), invoices_crossed(cfdi, entries)]


def journal_verified(entries: DataFrame, totals: DataFrame, minimum: int = 2) -> DataFrame:
    """M7: at least ``minimum`` entries and 90 % of those with moves balance exactly."""
    j = entries.select(*KEY).join(totals, KEY, "left")
    return j.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("polizas"), F.count("n_movs").alias("con_movs"),
        F.count_if(F.col("leido_debe") == F.col("leido_haber")).alias("iguales"),
    ).withColumn("verificado", (F.col("polizas") >= minimum) & (F.col("con_movs") > 0)
                 & (F.col("iguales") * 10 >= F.col("con_movs") * 9))
