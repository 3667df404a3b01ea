"""Subledger semantics and rules: A7, A9, A10, A15, V6, V7, V8, V24, M6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.operators.scan import first_names, ordered_scan
from cotejo.operators.verdict import BAD, EXACT, MONEY, TOLERANCE, Rule, compare, money
from cotejo.session import stage

KEY = ["doc_id", "cuenta"]
PRINTED, REFILLED, MISSING = "impreso", "recalculado", "sin_saldo"


def _tol() -> Column:
    return F.lit(TOLERANCE).cast(MONEY)


def _sign(nature: Column | str) -> Column:
    n = F.col(nature) if isinstance(nature, str) else nature
    return F.when(n == "A", F.lit(-1)).otherwise(F.lit(1))


def moves_of(aux: DataFrame) -> DataFrame:
    return aux.filter(~F.col("es_subtotal"))


def accounts(aux: DataFrame) -> DataFrame:
    """A7 and A9 in one pass: one row per (document, account) with nature and anchor.

    The chain of an account runs over all its sections, so the lag is keyed by account.
    """
    f = F.col
    chain = ordered_scan(
        moves_of(aux).select(*KEY, "seq", "debe", "haber", "saldo", "saldo_origen",
                             "saldo_inicial_cuenta"),
        KEY, "seq", lag={"_prev": f("saldo"), "_has": F.lit(True)})
    first = f("_has").isNull()
    prev = F.when(first, f("saldo_inicial_cuenta")).otherwise(f("_prev"))
    net = f("debe") - f("haber")
    votes = (f("saldo").isNotNull() & prev.isNotNull() & (f("debe") != f("haber")))
    per = chain.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("movs"),
        F.count_if(votes & (F.abs(prev + net - f("saldo")) <= _tol())).alias("v_d"),
        F.count_if(votes & (F.abs(prev - net - f("saldo")) <= _tol())).alias("v_a"),
        money(F.sum("debe")).alias("suma_debe"), money(F.sum("haber")).alias("suma_haber"),
        F.bool_or(f("debe").isNull() | f("haber").isNull()).alias("con_hueco"),
        F.max(F.when(first, f("saldo_inicial_cuenta"))).alias("inicial"),
        F.bool_or(f("saldo_origen") == REFILLED).alias("con_recalculo"))
    # A repeated subtotal counts by its first row.
    subs = aux.filter("es_subtotal").groupBy(*KEY).agg(
        F.min_by(F.struct("debe", "haber", "saldo"), "seq").alias("sub"))
    j = per.join(subs, KEY, "left")
    neto = f("suma_debe") - f("suma_haber")
    lands = (f("sub.saldo").isNotNull() & f("inicial").isNotNull() & ~f("con_hueco")
             & (neto != 0))
    one = lambda c: F.when(F.coalesce(lands & c, F.lit(False)), 1).otherwise(0)
    v_d = f("v_d") + one(F.abs(f("inicial") + neto - f("sub.saldo")) <= _tol())
    v_a = f("v_a") + one(F.abs(f("inicial") - neto - f("sub.saldo")) <= _tol())
    j = (j.withColumn("votos_d", v_d).withColumn("votos_a", v_a)
         .withColumn("naturaleza", F.when(f("votos_d") == f("votos_a"), "")
                     .when(f("votos_d") > f("votos_a"), "D").otherwise("A")))
    ends = F.coalesce(
        (f("inicial") + _sign("naturaleza") * neto) == f("sub.saldo"), F.lit(True))
    anchored = (f("sub").isNotNull() & f("inicial").isNotNull() & ~f("con_hueco")
                & (f("suma_debe") == f("sub.debe")) & (f("suma_haber") == f("sub.haber")) & ends)
    return j.select(
        *KEY, "movs", "votos_d", "votos_a", "naturaleza", "inicial", "suma_debe", "suma_haber",
        "con_recalculo", f("sub.debe").alias("sub_debe"), f("sub.haber").alias("sub_haber"),
        f("sub.saldo").alias("sub_saldo"), F.coalesce(anchored, F.lit(False)).alias("anclada"))


def refill(aux: DataFrame, accts: DataFrame) -> DataFrame:
    """A10: fill missing balances, only between verified anchors.

    Only the accounts that need it are scanned; everything else passes through.
    """
    f = F.col
    gaps = moves_of(aux).filter(f("saldo").isNull()).select(*KEY).distinct()
    due = (accts.filter("anclada AND naturaleza <> ''").select(*KEY, "naturaleza", "inicial")
           .join(gaps, KEY, "left_semi"))
    keep = aux.join(due.select(*KEY, F.lit(True).alias("_due")), KEY, "left")
    rest = keep.filter(f("_due").isNull() | f("es_subtotal")).drop("_due")
    todo = moves_of(aux).join(due, KEY)
    step = _sign("naturaleza") * (f("debe") - f("haber"))
    run = ordered_scan(todo, KEY, "seq", running={"_r": step})
    run = ordered_scan(run, KEY, "seq", latest={"_off": f("saldo") - f("_r")})
    value = money(F.coalesce("_off", "inicial") + f("_r"))
    filled = run.select(*[
        F.coalesce("saldo", value).alias("saldo") if c == "saldo"
        else F.when(f("saldo").isNull(), REFILLED).otherwise(f(c)).alias(c)
        if c == "saldo_origen" else f(c) for c in aux.columns])
    return rest.select(*aux.columns).unionByName(filled)


def chained(aux: DataFrame) -> DataFrame:
    """Moves with the balance they start from; a change of ADJACENT account restarts at
    the opening, and a missing balance breaks the chain."""
    f = F.col
    m = ordered_scan(moves_of(aux), ["doc_id"], "seq",
                     lag={"_pc": f("cuenta"), "_ps": f("saldo")})
    new_run = f("_pc").isNull() | (f("_pc") != f("cuenta"))
    return m.withColumn("anterior", F.when(new_run, f("saldo_inicial_cuenta"))
                        .otherwise(f("_ps"))).drop("_pc", "_ps")


def running_balance(aux: DataFrame, accts: DataFrame) -> Rule:
    """V6: previous balance plus signed move equals balance, inside each account run."""
    f = F.col
    m = chained(aux).join(accts.select(*KEY, "naturaleza"), KEY, "left")
    known = F.coalesce(f("naturaleza"), F.lit("")) != ""
    expected = f("anterior") + _sign("naturaleza") * (f("debe") - f("haber"))
    frame = m.select(
        "doc_id", "seq", F.concat_ws(" ", "cuenta", "fecha").alias("fila"),
        F.lit("saldo_corrido").alias("subregla"), money(expected).alias("esperado"),
        f("saldo").alias("obtenido"),
        F.when(known & f("anterior").isNotNull(), compare(expected, f("saldo"))).alias("veredicto"),
        (f("saldo_origen") == REFILLED).alias("recalculado"),
        known.alias("_known"), f("saldo").isNull().alias("_nosaldo"))
    unknown = accts.filter("naturaleza = ''")
    extra = (unknown.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sin"))
             .join(first_names(unknown, "doc_id", "cuenta", ["cuenta"]), "doc_id", "left"))

    def reason():
        seeds = f("aplicables") - f("evaluados") - f("n_ileg") - f("n_ind")
        return F.concat_ws(
            "; ",
            F.when(f("n_ileg") > 0, F.format_string(
                "%d de %d movimientos no traen saldo legible en la capa de texto",
                "n_ileg", "aplicables")),
            F.when(f("n_ind") > 0, F.format_string(
                "%d de %d pertenecen a %d cuenta(s) cuyo saldo no revela de que lado corre: %s",
                "n_ind", "aplicables", "n_sin", "nombres")),
            F.when(seeds > 0, F.format_string(
                "%d de %d abren cadena y no tienen contra que encadenarse",
                seeds, f("aplicables"))))

    return Rule(
        "saldo_corrido", frame,
        counts={"n_ileg": F.count_if(f("_known") & f("_nosaldo")),
                "n_ind": F.count_if(~f("_known"))},
        extra=extra, reason=reason, empty="el documento no trajo movimientos",
        reason_none=lambda: F.when(f("n_sin") > 0, F.format_string(
            "%d cuenta(s) no revelan de que lado corre su saldo: %s", "n_sin", "nombres"))
        .otherwise(F.format_string(
            "%d de %d movimientos no traen saldo en la capa de texto", "n_ileg", "aplicables")))


def subtotals(aux: DataFrame) -> Rule:
    """V7: each printed subtotal against the sum of its account; two cases per subtotal."""
    f = F.col
    sums = moves_of(aux).groupBy(*KEY).agg(
        money(F.sum("debe")).alias("s_debe"), money(F.sum("haber")).alias("s_haber"))
    j = aux.filter("es_subtotal").select(*KEY, "seq", "debe", "haber").join(sums, KEY, "left")
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"subtotal_{s}").alias("subregla"), f(f"s_{s}").alias("esperado"),
                 f(s).alias("obtenido")) for s in ("debe", "haber")]))
    frame = j.select("doc_id", "seq", f("cuenta").alias("fila"), sides.alias("s")).select(
        "doc_id", "seq", "fila", "s.*", compare(f("s.esperado"), f("s.obtenido")).alias("veredicto"))
    return Rule(
        "subtotales", frame, empty="el documento no imprime filas de subtotal",
        reason=lambda: F.when(f("evaluados") < f("aplicables"), F.format_string(
            "%d de %d subtotales no corresponden a ninguna seccion leida",
            F.expr("(aplicables - evaluados) div 2"), F.expr("aplicables div 2"))),
        reason_none=lambda: F.lit("los subtotales no corresponden a ninguna seccion leida"))


def refill_anchor(accts: DataFrame) -> Rule:
    """V8: of the accounts with refilled balances, those whose chain still lands."""
    f = F.col
    frame = accts.filter("con_recalculo").select(
        "doc_id", F.lit(-1).alias("seq"), f("cuenta").alias("fila"),
        F.lit("ancla_recalculo").alias("subregla"),
        F.coalesce("sub_debe", F.lit(0).cast(MONEY)).alias("esperado"),
        F.coalesce("suma_debe", F.lit(0).cast(MONEY)).alias("obtenido"),
        F.when(f("anclada"), EXACT).otherwise(BAD).alias("veredicto"))
    return Rule("ancla_recalculo", frame,
                empty="ningun saldo se derivo: no hay ancla que comprobar")


def subledger_rules(aux: DataFrame, refilled: bool = False) -> list[Rule]:
    """V22 for subledgers: fill between anchors first, then check what results."""
    full = aux if refilled else stage(refill(aux, stage(accounts(aux))))
    accts = stage(accounts(full))
    return [running_balance(full, accts), subtotals(full), refill_anchor(accts)]


def balance_origins(aux: DataFrame) -> DataFrame:
    """Where the balance of each move came from, zeros kept."""
    o = F.col("saldo_origen")
    return moves_of(aux).groupBy("doc_id").agg(
        *[F.count_if(o == k).alias(k) for k in (PRINTED, REFILLED, MISSING)])


def suspicious_pages(aux: DataFrame, accts: DataFrame | None = None) -> DataFrame:
    """Pages with a missing balance or a broken chain; the break reason wins.

    The debit identity is used for every account unless ``accts`` gives natures.
    """
    f = F.col
    m = chained(aux)
    sign = F.lit(1)
    if accts is not None:
        m = m.join(accts.select(*KEY, "naturaleza"), KEY, "left")
        sign = _sign("naturaleza")
    gap = F.abs(f("anterior") + sign * (f("debe") - f("haber")) - f("saldo")) > _tol()
    pages = m.filter(f("pagina") != 0).groupBy("doc_id", "pagina").agg(
        F.bool_or(F.coalesce(gap, F.lit(False))).alias("rota"),
        F.bool_or(f("saldo").isNull()).alias("hueco"))
    return pages.filter("rota OR hueco").select(
        "doc_id", "pagina",
        F.when(f("rota"), "el saldo corrido se rompe sin explicacion")
        .otherwise("dato ilegible en la capa de texto").alias("motivo"))


def subledger_verified(aux: DataFrame, minimum: int = 5) -> DataFrame:
    """M6: enough moves, enough comparisons, 90 % of them chain with the debit identity."""
    f = F.col
    ok = F.abs(f("anterior") + f("debe") - f("haber") - f("saldo")) <= _tol()
    compared = f("saldo").isNotNull() & f("anterior").isNotNull()
    g = chained(aux).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("movimientos"), F.count_if(compared).alias("comprobadas"),
        F.count_if(compared & ok).alias("buenas"))
    return g.withColumn("verificado", (f("movimientos") >= minimum)
                        & (f("comprobadas") >= minimum)
                        & (f("buenas") * 10 >= f("comprobadas") * 9))
