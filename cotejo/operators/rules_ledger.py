"""General-ledger semantics and rules: A8, A12, R18, R19, V17-V19."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.accounts import canonical, canonical_without_marker, infer_schemes
from cotejo.operators.scan import LEVEL_BITS, first_names, ordered_scan
from cotejo.operators.verdict import BAD, EXACT, MONEY, TOLERANCE, Rule, compare, money
from cotejo.session import stage, stage_by, stage_like

KEY = ["doc_id", "cuenta"]


def _with_previous(months: DataFrame) -> DataFrame:
    """Months with ``_prev``, the row before in month order inside their account; null on its first row.

    An account inside one span of the reading order is one window; only one that crosses spans is scanned by month.
    """
    f = F.col
    span = F.shiftright("seq", LEVEL_BITS[0])
    wide = stage(months.groupBy(*KEY).agg(F.min(span).alias("_lo"), F.max(span).alias("_hi")).filter("_lo < _hi").select(*KEY))
    w = Window.partitionBy(*KEY, f("orden").isNull()).orderBy("orden", "seq")
    inside = lambda m: m.withColumn("_prev", F.lag(F.struct("saldo")).over(w))
    if wide.isEmpty():
        return inside(months)
    far = months.join(wide, KEY, "left_semi")
    m = ordered_scan(far, [*KEY, "orden"], "seq", lag={"_ps": f("saldo"), "_has": F.lit(True)})
    # the first row of a month follows the last row of the month before; months per account are few
    ends = far.groupBy(*KEY, "orden").agg(F.max_by(F.struct("saldo"), "seq").alias("_end")).filter("orden IS NOT NULL")
    ends = ends.select(*KEY, "orden", F.lag("_end").over(Window.partitionBy(*KEY).orderBy("orden")).alias("_before"))
    m = m.join(ends, [*KEY, "orden"], "left").withColumn(
        "_prev", F.when(f("_has").isNotNull(), F.struct(f("_ps").alias("saldo"))).otherwise(f("_before")))
    return inside(months.join(wide, KEY, "left_anti")).unionByName(m.select(*months.columns, "_prev"))


def _accounts(months: DataFrame) -> DataFrame:
    """Per account, from one pass over its months: the votes of all rows but the first, that row, and the closing figures ``u``."""
    f = F.col
    m = _with_previous(months)
    placed, net = f("orden").isNotNull(), f("cargos") - f("abonos")
    votes_d, votes_a = _votes(f("_prev.saldo"), net, f("saldo"))
    return m.groupBy(*KEY).agg(
        F.count_if(placed & votes_d).alias("_d"), F.count_if(placed & votes_a).alias("_a"),
        F.max(F.when(placed & f("_prev").isNull(), F.struct(net.alias("net"), f("saldo").alias("saldo")))).alias("_first"),
        F.max_by(F.struct("saldo", "acum_cargos", "acum_abonos"), F.struct(f("orden"), -f("seq"))).alias("u"))


def _votes(prev: Column, net: Column, balance: Column) -> tuple[Column, Column]:
    """Does the balance follow from the one before by the debit sign, and does it by the credit sign?"""
    tol = F.lit(TOLERANCE).cast(MONEY)
    votes = balance.isNotNull() & prev.isNotNull() & (net != 0)
    return votes & (F.abs(prev + net - balance) <= tol), votes & (F.abs(prev - net - balance) <= tol)


def natures(heads: DataFrame, months: DataFrame) -> DataFrame:
    """Majority over the months in month order; no opening means no nature."""
    if "acum_cargos" not in months.columns:  # natures need no printed accumulated figures
        months = months.withColumns({c: F.lit(None).cast(MONEY) for c in ("acum_cargos", "acum_abonos")})
    return _natures(heads, _accounts(months))


def _natures(heads: DataFrame, accounts: DataFrame) -> DataFrame:
    f = F.col
    first = [F.coalesce(v, F.lit(False)).cast("long") for v in _votes(f("saldo_inicial"), f("_first.net"), f("_first.saldo"))]
    v = accounts.join(heads.select(*KEY, "saldo_inicial"), KEY).groupBy(*KEY).agg(
        F.sum(f("_d") + first[0]).alias("votos_d"), F.sum(f("_a") + first[1]).alias("votos_a"))
    j = heads.select(*KEY, "saldo_inicial").join(v, KEY, "left").na.fill(0, ["votos_d", "votos_a"])
    return j.select(
        *KEY, "votos_d", "votos_a",
        F.when(f("saldo_inicial").isNull() | (f("votos_d") == f("votos_a")), "")
        .when(f("votos_d") > f("votos_a"), "D").otherwise("A").alias("naturaleza"))


def close_accounts(heads: DataFrame, months: DataFrame) -> DataFrame:
    """R18 + A8: final balance and totals from the greatest month, first of equals."""
    f = F.col
    accounts = stage(_accounts(months))
    return (heads.join(accounts.select(*KEY, "u"), KEY, "left").join(_natures(heads, accounts), KEY, "left")
            .select(*heads.columns, f("u.saldo").alias("saldo_final"),
                    f("u.acum_cargos").alias("total_cargos"),
                    f("u.acum_abonos").alias("total_abonos"), "naturaleza"))


def read_totals(months: DataFrame) -> DataFrame:
    """A12."""
    return months.groupBy(*KEY).agg(
        money(F.sum("cargos")).alias("leido_cargos"), money(F.sum("abonos")).alias("leido_abonos"))


def without_amounts(months: DataFrame) -> DataFrame:
    """Documents whose months hold not one non-zero amount, with the count."""
    some = F.lit(False)
    for c in ("cargos", "abonos", "saldo", "acum_cargos", "acum_abonos"):
        some = some | (F.coalesce(F.col(c), F.lit(0).cast(MONEY)) != 0)
    g = months.groupBy("doc_id").agg(F.count(F.lit(1)).alias("meses"), F.bool_or(some).alias("hay"))
    return g.filter("NOT hay").select("doc_id", "meses", F.format_string(
        "se detectaron %d renglones de mes y ninguno trae cargos, abonos ni saldo; el documento "
        "no parece un libro mayor", "meses").alias("motivo"))


def _in_order(months: DataFrame, dealt: bool = False) -> DataFrame:
    """Months in document order with a flag on the first row of each account run."""
    f = F.col
    m = ordered_scan(months, ["doc_id"], "seq", lag={"_pc": f("cuenta"), "_ps": f("saldo")}, keep=True, dealt=dealt)
    return m.withColumn("_new", f("_pc").isNull() | (f("_pc") != f("cuenta")))


def in_order(months: DataFrame) -> DataFrame:
    """The months that V17 and V18 read, in document order, as a stage table dealt out by span: they move once for both."""
    parts = max(int(months.sparkSession.conf.get("spark.sql.shuffle.partitions")), months.count() // 1_000_000 + 1)
    span = ["doc_id", "_span"]
    read = months.select("doc_id", "seq", "cuenta", "periodo", "cargos", "abonos", "saldo", "acum_cargos", "acum_abonos",
                         F.shiftright("seq", LEVEL_BITS[0]).alias("_span"))
    dealt = stage_by(read, span, parts)
    return stage_like(_in_order(dealt, dealt=True).drop("_pc"), dealt, span)


def monthly_balance(heads: DataFrame, months: DataFrame, ordered: DataFrame | None = None) -> Rule:
    """Document order inside the account run; unknown nature uses the debit sign. ``ordered`` is ``in_order(months)``, if at hand."""
    f = F.col
    own = heads.groupBy(*KEY).agg(
        F.max_by(F.struct("saldo_inicial", "naturaleza"), "seq").alias("h"))
    m = (_in_order(months) if ordered is None else ordered).join(own, KEY, "left")
    prev = F.when(f("_new"), f("h.saldo_inicial")).otherwise(f("_ps"))
    sign = F.when(f("h.naturaleza") == "A", F.lit(-1)).otherwise(F.lit(1))
    expected = prev + sign * (f("cargos") - f("abonos"))
    frame = m.select(
        "doc_id", "seq", F.concat_ws(" ", "cuenta", "periodo").alias("fila"),
        F.lit("saldo_mensual").alias("subregla"), money(expected).alias("esperado"),
        f("saldo").alias("obtenido"), compare(expected, f("saldo")).alias("veredicto"))
    lost = heads.filter("naturaleza = ''").select(*KEY).distinct()
    extra = (lost.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sin"))
             .join(first_names(lost, "doc_id", "cuenta", ["cuenta"]), "doc_id", "left"))
    text = lambda: F.when(f("n_sin") > 0, F.format_string(
        "%d cuenta(s) sin naturaleza determinable (sus meses no la revelan): %s",
        "n_sin", "nombres"))
    return Rule("saldo_mensual", frame, extra=extra, reason=text, reason_none=text,
                empty="el documento no trajo meses")


def accumulated(months: DataFrame, ordered: DataFrame | None = None) -> Rule:
    """Last printed accumulated plus the month; unreadable ones are skipped over. ``ordered`` is ``in_order(months)``, if at hand."""
    f = F.col
    m = (_in_order(months) if ordered is None else ordered).drop("_pc", "_ps")
    zero = F.lit(0).cast(MONEY)
    seed = lambda c: F.coalesce(f(c), F.when(f("_new"), zero))
    m = ordered_scan(m, ["doc_id"], "seq",
                     before={"_b_cargos": seed("acum_cargos"), "_b_abonos": seed("acum_abonos")}, dealt=True)
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"acum_{s}").alias("subregla"),
                 money(F.when(f("_new"), zero).otherwise(f(f"_b_{s}")) + f(s)).alias("esperado"),
                 f(f"acum_{s}").alias("obtenido")) for s in ("cargos", "abonos")]))
    frame = m.select("doc_id", "seq", F.concat_ws(" ", "cuenta", "periodo").alias("fila"),
                     sides.alias("s")).select(
        "doc_id", "seq", "fila", "s.*", compare(f("s.esperado"), f("s.obtenido")).alias("veredicto"))
    text = lambda: F.when(f("evaluados") < f("aplicables"), F.format_string(
        "%d de %d acumulados no vienen legibles en el documento",
        f("aplicables") - f("evaluados"), f("aplicables")))
    return Rule("acumulados", frame, reason=text, reason_none=text,
                empty="el documento no trajo meses")


def against_trial(heads: DataFrame, trial: DataFrame | None) -> Rule:
    """Final balance against the paired trial balance on the canonical key.

    Both sides carry the ``doc_id`` of the pair. Equality is exact, and a difference is
    handed over as ``no_verificable`` with names, never as a failure.
    """
    f = F.col
    if trial is None:
        frame = heads.select(
            "doc_id", "seq", f("cuenta").alias("fila"), F.lit("cruce_balanza").alias("subregla"),
            f("saldo_final").alias("esperado"), F.lit(None).cast(MONEY).alias("obtenido"),
            F.lit(None).cast("string").alias("veredicto"))
        return Rule("cruce_balanza", frame, never_fails=True, reason_none=lambda: F.lit(
            "no se recibio una balanza con la que cruzar; es una comprobacion entre documentos "
            "y quien orquesta decide cual corresponde"))
    schemes = infer_schemes(trial.select("doc_id", "cuenta"))
    t = trial.join(schemes, "doc_id", "left").withColumn(
        "clave", canonical_without_marker(f("cuenta"), f("marca_ini"), f("marca_fin")))
    t = t.groupBy("doc_id", "clave").agg(F.max_by(
        f("saldo_fin_deudor") - f("saldo_fin_acreedor"), "seq").alias("otro"))
    j = heads.withColumn("clave", canonical(f("cuenta"))).join(t, ["doc_id", "clave"], "left")
    frame = j.select(
        "doc_id", "seq", f("cuenta").alias("fila"), F.lit("cruce_balanza").alias("subregla"),
        f("saldo_final").alias("esperado"), money(f("otro")).alias("obtenido"),
        F.when(f("saldo_final") == f("otro"), EXACT).when(f("saldo_final") != f("otro"), BAD)
        .alias("veredicto"))
    differ = frame.filter(f("veredicto") == BAD)
    extra = first_names(differ, "doc_id", "fila", ["seq"])

    def reason():
        return (F.when(f("discrepancias") > 0, F.format_string(
            "%d de %d coinciden; %d difieren: %s. Sin regla confirmada para decidir si es "
            "esperado", "exactas", "evaluados", "discrepancias", "nombres"))
            .when(f("evaluados") < f("aplicables"), F.format_string(
                "%d de %d cuentas del mayor no aparecen en la balanza recibida",
                f("aplicables") - f("evaluados"), f("aplicables"))))

    return Rule("cruce_balanza", frame, extra=extra, reason=reason, never_fails=True,
                reason_none=lambda: F.lit(
                    "ninguna cuenta del mayor aparece en la balanza recibida"))


def ledger_rules(heads: DataFrame, months: DataFrame, trial: DataFrame | None = None) -> list[Rule]:
    """V22 for general ledgers; ``heads`` comes from ``close_accounts``."""
    ordered = in_order(months)
    return [monthly_balance(heads, months, ordered), accumulated(months, ordered), against_trial(heads, trial)]
