"""Bank-statement rules and totals: A13, A14, V13-V16."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.scan import ordered_scan
from cotejo.operators.verdict import MONEY, Rule, compare, money

KEY = ["doc_id", "num_cuenta"]
SUMMARY = ("saldo_inicial", "depositos", "retiros", "saldo_corte")


def read_totals(accounts: DataFrame, moves: DataFrame) -> DataFrame:
    """Sums per account key; accounts without moves give 0/0, unlisted keys stay."""
    zero = F.lit(0).cast(MONEY)
    sums = moves.groupBy(*KEY).agg(F.sum("deposito").alias("d"), F.sum("retiro").alias("r"))
    keys = accounts.select(*KEY).distinct()
    return keys.join(sums, KEY, "full_outer").select(
        *KEY, money(F.coalesce("d", zero)).alias("leido_depositos"),
        money(F.coalesce("r", zero)).alias("leido_retiros"))


def moves_of_account(moves: DataFrame, num_cuenta: str) -> DataFrame:
    """A14."""
    return moves.filter(F.col("num_cuenta") == num_cuenta)


def _label() -> F.Column:
    return F.trim(F.concat(F.lit("resumen "), F.col("num_cuenta")))


def summary_identity(accounts: DataFrame) -> Rule:
    """Opening + deposits - withdrawals = closing, per account."""
    f = F.col
    expected = f("saldo_inicial") + f("depositos") - f("retiros")
    frame = accounts.select(
        "doc_id", F.lit(-1).alias("seq"), _label().alias("fila"),
        F.lit("resumen").alias("subregla"), money(expected).alias("esperado"),
        f("saldo_corte").alias("obtenido"),
        compare(expected, f("saldo_corte")).alias("veredicto"),
        *[f(c).isNull().alias(f"no_{c}") for c in SUMMARY])
    missing = F.concat_ws(", ", *[F.when(f(f"n_{c}") > 0, c.replace("_", " "))
                                  for c in sorted(SUMMARY)])
    return Rule(
        "resumen", frame, counts={f"n_{c}": F.count_if(f(f"no_{c}")) for c in SUMMARY},
        reason=lambda: F.when(f("evaluados") < f("aplicables"), F.format_string(
            "%d de %d cuenta(s) no traen el resumen completo y quedaron sin comprobar",
            f("aplicables") - f("evaluados"), f("aplicables"))),
        reason_none=lambda: F.format_string(
            "ninguna de las %d cuenta(s) trae el resumen completo; falta: %s",
            f("aplicables"), F.when(missing == "", "todo").otherwise(missing)))


def summary_against_moves(accounts: DataFrame, moves: DataFrame) -> Rule:
    """Declared deposits and withdrawals against the moves read; two cases per account."""
    f = F.col
    zero = F.lit(0).cast(MONEY)
    sums = moves.groupBy(*KEY).agg(F.sum("deposito").alias("s_deposito"),
                                   F.sum("retiro").alias("s_retiro"))
    docs = moves.select("doc_id").distinct().withColumn("hay_movs", F.lit(True))
    j = accounts.join(sums, KEY, "left").join(docs, "doc_id", "left")
    complete = f("depositos").isNotNull() & f("retiros").isNotNull()
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"resumen_{s}s").alias("subregla"),
                 money(F.coalesce(f"s_{s}", zero)).alias("esperado"), f(f"{s}s").alias("obtenido"))
        for s in ("deposito", "retiro")]))
    frame = j.select(
        "doc_id", F.lit(-1).alias("seq"), _label().alias("fila"), complete.alias("completa"),
        "hay_movs", sides.alias("s")).select(
        "doc_id", "seq", "fila", "completa", "s.*",
        F.when(f("completa") & f("hay_movs"), compare(f("s.esperado"), f("s.obtenido")))
        .alias("veredicto"))
    return Rule(
        "resumen_movimientos", frame, counts={"n_com": F.count_if(f("completa"))},
        reason=lambda: F.when(f("evaluados") < f("aplicables"), F.format_string(
            "%d de %d cuenta(s) no declaran depositos y retiros propios",
            F.expr("(aplicables - evaluados) div 2"), F.expr("aplicables div 2"))),
        reason_none=lambda: F.when(
            f("n_com") == 0,
            "ninguna cuenta declara depositos y retiros propios; con dos o mas cuentas el "
            "total del documento no se reparte").otherwise("no se leyo ningun movimiento"))


def running_balance(accounts: DataFrame, moves: DataFrame) -> Rule:
    """The chain inside each account key; a shared key has no opening."""
    f = F.col
    opening = accounts.groupBy(*KEY).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("saldo_inicial")).alias("inicial"))
    m = ordered_scan(moves, KEY, "seq", lag={"_ps": f("saldo"), "_has": F.lit(True)})
    m = m.join(opening, KEY, "left")
    prev = F.when(f("_has").isNull(), f("inicial")).otherwise(f("_ps"))
    expected = prev + f("deposito") - f("retiro")
    frame = m.select(
        "doc_id", "seq", F.concat(F.lit("dia "), f("dia")).alias("fila"),
        F.lit("saldo_corrido").alias("subregla"), money(expected).alias("esperado"),
        f("saldo").alias("obtenido"), compare(expected, f("saldo")).alias("veredicto"))

    def reason():
        seeds = f("aplicables") - f("evaluados") - f("n_ileg")
        return F.concat_ws(
            "; ",
            F.when(f("n_ileg") > 0, F.format_string(
                "%d de %d movimientos no traen saldo con el que encadenar", "n_ileg", "aplicables")),
            F.when(seeds > 0, F.format_string(
                "%d de %d abren cadena y no tienen contra que encadenarse",
                seeds, f("aplicables"))))

    return Rule("saldo_corrido", frame, counts={"n_ileg": F.count_if(f("obtenido").isNull())},
                reason=reason, empty="no se leyo ningun movimiento")


def declared_total(accounts: DataFrame, meta: DataFrame) -> Rule:
    """The printed TOTAL row against the sum over accounts, if every account has it."""
    f = F.col
    fields = ("saldo_inicial", "saldo_corte")
    sums = accounts.groupBy("doc_id").agg(
        *[F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(f"s_{c}") for c in fields])
    j = meta.select("doc_id", *[f"total_{c}" for c in fields]).join(sums, "doc_id", "left")
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"total_{c}").alias("subregla"), money(f(f"s_{c}")).alias("esperado"),
                 f(f"total_{c}").alias("obtenido")) for c in fields]))
    frame = j.select("doc_id", F.lit(-1).alias("seq"), F.lit("TOTAL").alias("fila"),
                     sides.alias("s")).select(
        "doc_id", "seq", "fila", "s.*", compare(f("s.esperado"), f("s.obtenido")).alias("veredicto"))
    return Rule(
        "total_declarado", frame, counts={"n_dec": F.count("obtenido")},
        reason=lambda: F.when(
            f("evaluados") < 2,
            "el documento solo imprime uno de los dos totales (saldo inicial y saldo al corte)"),
        reason_none=lambda: F.when(
            f("n_dec") == 0, "el documento no imprime una fila TOTAL con la que cruzar la suma "
            "de los saldos por cuenta").otherwise(
            "el documento imprime una fila TOTAL pero alguna cuenta no trae el saldo con el "
            "que sumarla"))


def bank_rules(meta: DataFrame, accounts: DataFrame, moves: DataFrame) -> list[Rule]:
    """V22 for bank statements. Credit accounts keep the plain identity."""
    return [summary_identity(accounts), summary_against_moves(accounts, moves),
            running_balance(accounts, moves), declared_total(accounts, meta)]
