"""Trial-balance semantics and rules: A3-A6, V1-V5, V24, M5, M9, M10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.accounts import (
    ancestors_of,
    infer_schemes,
    level_of,
    nature_of_row,
    parent_of,
)
from cotejo.operators.scan import first_names
from cotejo.operators.skew import by_seq, join_small
from cotejo.operators.verdict import AMOUNT, MONEY, TOLERANCE, Rule, compare, money

KEY = ["doc_id", "cuenta"]
# Where the nature of a row came from (fixed values).
DECLARED, DERIVED, INHERITED, UNKNOWN = "explicita", "derivada", "heredada", "sin_determinar"


def _span(rows: DataFrame) -> Column:
    """Stretches of the reading order; rows without one are dealt out by their account."""
    return by_seq() if "seq" in rows.columns else F.pmod(F.xxhash64("cuenta"), F.lit(64))


def with_scheme(rows: DataFrame) -> DataFrame:
    """Rows plus the scheme of their document; one small row per document is joined."""
    return join_small(rows, infer_schemes(rows), "doc_id", _span(rows), "left")


def _levels(rows: DataFrame) -> DataFrame:
    c = F.col("cuenta")
    a, i, f = F.col("anchos"), F.col("marca_ini"), F.col("marca_fin")
    return rows.withColumn("nivel", level_of(c, i, f)).withColumn(
        "cuenta_padre", parent_of(c, a, i, f))


def levels_and_parents(rows: DataFrame) -> DataFrame:
    """A2 for a whole corpus."""
    return _levels(with_scheme(rows))


def natures(raw: DataFrame, swapped: bool = False) -> DataFrame:
    """A5 + A6: declared, derived, else taken from the nearest ancestor that has one.

    Repeated accounts count by their last row. Ancestors missing from the document are
    skipped through by number, so the path is computed, not walked by joins.
    """
    f = F.col
    d, h = ("haber", "debe") if swapped else ("debe", "haber")
    own = F.when(f("naturaleza").isin("D", "A"), F.struct(
        f("naturaleza").alias("nat"), F.lit(DECLARED).alias("origen")))
    derived = nature_of_row(f("saldo_inicial"), f("saldo_final"), f(d), f(h))
    own = F.coalesce(own, F.when(derived != "", F.struct(
        derived.alias("nat"), F.lit(DERIVED).alias("origen"))),
        F.struct(F.lit("").alias("nat"), F.lit(UNKNOWN).alias("origen")))
    last = raw.withColumn("_own", own).groupBy(*KEY).agg(F.max_by("_own", "seq").alias("_own"), F.max("seq").alias("seq"))
    base = last.select(*KEY, "seq", "_own.nat", "_own.origen")
    open_ = join_small(base.filter("nat = ''"), infer_schemes(raw), "doc_id", by_seq(), "left")
    path = ancestors_of(f("cuenta"), f("anchos"), f("marca_ini"), f("marca_fin"))
    up = open_.select(*KEY, "seq", F.posexplode(path).alias("salto", "ancestro"))
    # an ancestor near the top is that of most rows of its document
    found = (join_small(up, base.filter("nat <> ''").select(
        "doc_id", f("cuenta").alias("ancestro"), f("nat").alias("_up")), ["doc_id", "ancestro"], by_seq())
        .groupBy(*KEY).agg(F.min_by("_up", "salto").alias("_up")))
    j = base.join(found, KEY, "left")
    return j.select(
        *KEY, F.when(f("nat") != "", f("nat")).otherwise(F.coalesce("_up", F.lit(""))).alias("nat"),
        F.when(f("nat") != "", f("origen")).when(f("_up").isNotNull(), INHERITED)
        .otherwise(UNKNOWN).alias("origen"))


def summary_accounts(rows: DataFrame) -> DataFrame:
    """A3: the printed mark if the document has any, else accounts named as a parent."""
    f = F.col
    marked = rows.groupBy("doc_id").agg(F.bool_or(f("marca") != "").alias("_doc_mark"))
    parents = (rows.filter("cuenta_padre <> ''").select("doc_id", f("cuenta_padre").alias("cuenta"))
               .distinct().withColumn("_parent", F.lit(True)))
    j = join_small(rows, marked, "doc_id", _span(rows)).join(parents, KEY, "left")
    return j.withColumn(
        "es_acumulativa", F.when(f("_doc_mark"), f("marca") == "acumulativa")
        .otherwise(F.coalesce("_parent", F.lit(False)))).drop("_doc_mark", "_parent")


def resolve(raw: DataFrame) -> DataFrame:
    """A3-A6 together: raw signed rows become trial-balance rows."""
    f = F.col
    rows = levels_and_parents(raw).join(natures(raw), KEY)
    credit = f("nat") == "A"
    zero = F.lit(0).cast(AMOUNT)
    rows = summary_accounts(rows)
    return rows.select(
        "doc_id", "seq", "cuenta", "nivel", "cuenta_padre", f("nat").alias("naturaleza"), "nombre",
        F.when(credit, zero).otherwise(f("saldo_inicial")).alias("saldo_ini_deudor"),
        F.when(credit, f("saldo_inicial")).otherwise(zero).alias("saldo_ini_acreedor"),
        "debe", "haber",
        F.when(credit, zero).otherwise(f("saldo_final")).alias("saldo_fin_deudor"),
        F.when(credit, f("saldo_final")).otherwise(zero).alias("saldo_fin_acreedor"),
        "es_acumulativa", f("origen").alias("naturaleza_origen"))


def flipped_by_swap(raw: DataFrame) -> DataFrame:
    """Rows whose final nature would change if debit and credit were swapped."""
    a = natures(raw).select(*KEY, F.col("nat").alias("derecho"))
    b = natures(raw, swapped=True).select(*KEY, F.col("nat").alias("reves"))
    return a.join(b, KEY).groupBy("doc_id").agg(
        F.count_if(F.col("derecho") != F.col("reves")).alias("filas_afectadas"))


def trial_verified(raw: DataFrame, minimum: int = 5, swapped: bool = False) -> DataFrame:
    """M5: at least five rows and 90 % of them satisfy an identity.

    Split form (``saldo_ini_deudor`` present) needs the debit identity; the signed form
    accepts either, or no net move. A wrong printed month balance rejects the mapping.
    """
    f = F.col
    d, h = ("haber", "debe") if swapped else ("debe", "haber")
    tol = F.lit(TOLERANCE).cast(MONEY)
    move = f(d) - f(h)
    if "saldo_ini_deudor" in raw.columns:
        start = f("saldo_ini_deudor") - F.coalesce("saldo_ini_acreedor", F.lit(0).cast(MONEY))
        end = f("saldo_fin_deudor") - F.coalesce("saldo_fin_acreedor", F.lit(0).cast(MONEY))
        ok = F.abs(start + move - end) <= tol
    else:
        ok = (nature_of_row(f("saldo_inicial"), f("saldo_final"), f(d), f(h)) != "") | (move == 0)
    bad_month = (F.abs(f("saldo_mes") - move) > tol if "saldo_mes" in raw.columns
                 else F.lit(False))
    g = raw.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.coalesce(ok, F.lit(False))).alias("buenas"),
        F.bool_or(F.coalesce(bad_month, F.lit(False))).alias("mes_malo"))
    return g.withColumn("verificado", (f("filas") >= minimum) & ~f("mes_malo")
                        & (f("buenas") * 10 >= f("filas") * 9))


def oriented(raw: DataFrame) -> DataFrame:
    """M9: the arithmetic decides the orientation only if swapping it breaks the check."""
    s = trial_verified(raw, swapped=True)
    return s.select("doc_id", (~F.col("verificado")).alias("orientada"))


# ----------------------------------------------------------------------------- rules
def row_identity(b: DataFrame) -> Rule:
    """V1."""
    f = F.col
    expected = f("saldo_ini_deudor") - f("saldo_ini_acreedor") + f("debe") - f("haber")
    actual = f("saldo_fin_deudor") - f("saldo_fin_acreedor")
    return Rule("renglon", b.select(
        "doc_id", "seq", f("cuenta").alias("fila"), F.lit("renglon").alias("subregla"),
        money(expected).alias("esperado"), money(actual).alias("obtenido"),
        compare(expected, actual).alias("veredicto")), empty="el documento no trajo renglones")


def hierarchy(b: DataFrame) -> Rule:
    """V2: each parent against the sum of its direct children, one hash join.

    The universe is two cases per parent that some row NAMES, present or not.
    """
    f = F.col
    kids = b.filter("cuenta_padre <> ''").groupBy("doc_id", "cuenta_padre", "nivel").agg(
        F.sum("debe").alias("s_debe"), F.sum("haber").alias("s_haber"))
    rows = b.select("doc_id", f("cuenta").alias("cuenta_padre"), (f("nivel") + 1).alias("nivel"),
                    "seq", "debe", "haber")
    pairs = kids.join(rows, ["doc_id", "cuenta_padre", "nivel"]).drop("nivel")
    named = kids.select("doc_id", "cuenta_padre").distinct()
    j = named.join(pairs, ["doc_id", "cuenta_padre"], "left")
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"jerarquia_{s}").alias("subregla"), money(f(f"s_{s}")).alias("esperado"),
                 f(s).alias("obtenido")) for s in ("debe", "haber")]))
    frame = j.select("doc_id", "seq", f("cuenta_padre").alias("fila"), sides.alias("s")).select(
        "doc_id", "seq", "fila", "s.*", compare(f("s.esperado"), f("s.obtenido")).alias("veredicto"))
    present = b.select("doc_id", f("cuenta").alias("cuenta_padre"))
    lost = named.join(present, ["doc_id", "cuenta_padre"], "left_anti")
    extra = (b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_filas"))
             .join(lost.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_huerf")), "doc_id", "left")
             .join(first_names(lost, "doc_id", "cuenta_padre", ["cuenta_padre"]), "doc_id", "left"))
    return Rule(
        "jerarquia", frame, extra=extra,
        applicable=F.count_distinct("fila") * 2,
        reason=lambda: F.when(f("n_huerf") > 0, F.format_string(
            "%d cuenta(s) padre que alguna fila declara no aparecen en el documento: %s",
            "n_huerf", "nombres")),
        reason_none=lambda: F.format_string(
            "sin jerarquia: los %d renglones quedaron en nivel 1", "n_filas"))


def subset(b: DataFrame, name: str = "nivel_1") -> DataFrame:
    """The rows the printed totals are compared with."""
    return b.filter(~F.col("es_acumulativa")) if name == "no_acumulativas" else b.filter("nivel = 1")


def _with_totals(b: DataFrame, totals: DataFrame, name: str) -> DataFrame:
    docs = b.select("doc_id").distinct()
    sums = subset(b, name).groupBy("doc_id").agg(
        money(F.sum("debe")).alias("s_debe"), money(F.sum("haber")).alias("s_haber"))
    t = totals.select("doc_id", F.col("debe").alias("t_debe"), F.col("haber").alias("t_haber"))
    return docs.join(sums, "doc_id", "left").join(t, "doc_id", "left")


def printed_totals(b: DataFrame, totals: DataFrame, name: str = "nivel_1") -> Rule:
    """V3."""
    f = F.col
    sides = F.explode(F.array(*[
        F.struct(F.lit(f"totales_{s}").alias("subregla"), f(f"s_{s}").alias("esperado"),
                 f(f"t_{s}").alias("obtenido")) for s in ("debe", "haber")]))
    frame = _with_totals(b, totals, name).select("doc_id", sides.alias("s")).select(
        "doc_id", F.lit(-1).alias("seq"), F.lit("Totales").alias("fila"), "s.*",
        compare(f("s.esperado"), f("s.obtenido")).alias("veredicto"))
    return Rule(
        "totales", frame, counts={"n_t": F.count("obtenido")},
        reason_none=lambda: F.when(f("n_t") == 0, "fila de totales no detectada en el PDF").otherwise(
            f"sin filas en el subconjunto '{name}' contra el que cuadra la fila de totales"))


def double_entry_required(totals: DataFrame, docs: DataFrame) -> DataFrame:
    """V5: required unless the printed totals themselves do not balance."""
    t = totals.select("doc_id", (F.abs(F.col("debe") - F.col("haber"))
                                 <= F.lit(TOLERANCE).cast(MONEY)).alias("exige"))
    return docs.select("doc_id").distinct().join(t, "doc_id", "left").select(
        "doc_id", F.coalesce("exige", F.lit(True)).alias("exige_partida_doble"))


def double_entry(b: DataFrame, totals: DataFrame, name: str = "nivel_1") -> Rule:
    """V4."""
    f = F.col
    j = _with_totals(b, totals, name).join(double_entry_required(totals, b), "doc_id")
    frame = j.select(
        "doc_id", F.lit(-1).alias("seq"), F.lit("Totales").alias("fila"),
        F.lit("partida_doble").alias("subregla"), f("s_debe").alias("esperado"),
        f("s_haber").alias("obtenido"),
        F.when(f("exige_partida_doble"), compare(f("s_debe"), f("s_haber"))).alias("veredicto"),
        "exige_partida_doble")
    return Rule(
        "partida_doble", frame, counts={"n_ex": F.count_if(f("exige_partida_doble"))},
        reason_none=lambda: F.when(
            f("n_ex") == 0,
            "el documento no la declara: su fila de totales no cuadra debe contra haber")
        .otherwise("sin filas contra las que sumar"))


def trial_rules(b: DataFrame, totals: DataFrame, name: str = "nivel_1") -> list[Rule]:
    """V22 for trial balances."""
    return [row_identity(b), hierarchy(b), printed_totals(b, totals, name),
            double_entry(b, totals, name)]


def nature_origins(b: DataFrame) -> DataFrame:
    """How many rows got their nature from where, zeros kept."""
    o = F.col("naturaleza_origen")
    return b.groupBy("doc_id").agg(
        *[F.count_if(o == k).alias(k) for k in (DECLARED, DERIVED, INHERITED, UNKNOWN)])
