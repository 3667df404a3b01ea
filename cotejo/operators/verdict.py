"""From checked cases to a verdict with its denominator.

A rule is a table with ONE ROW PER APPLICABLE CASE::

    doc_id, seq, fila, subregla, esperado, obtenido, veredicto [, recalculado]

``veredicto`` is null when the case exists but could not be checked.  Counting that
table gives the result; filtering it gives the discrepancies.  The universe and the
verdicts thus come from one scan and cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"  # one printed figure
MONEY = "decimal(38,2)"   # sums and what is computed from them
TOLERANCE = "0.01"

# Fixed values of the result table.
CUADRA, FALLA, NO_VERIFICABLE = "cuadra", "falla", "no_verificable"
EXACT, CLOSE, BAD = "exacto", "tolerancia", "falla"

RESULT_COLUMNS = [
    "doc_id", "regla", "estado", "aplicables", "evaluados", "exactas",
    "exactas_impresas", "exactas_recalculadas", "con_tolerancia", "discrepancias",
    "motivo",
]


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def compare(expected: Column, actual: Column, tol: str = TOLERANCE) -> Column:
    """exact, within tolerance, or failed; null when either side is missing."""
    gap = F.abs(expected - actual)
    return (F.when(gap == 0, EXACT)
            .when(gap <= F.lit(tol).cast(MONEY), CLOSE)
            .when(gap.isNotNull(), BAD))


@dataclass(frozen=True)
class Rule:
    """One rule over a corpus: its cases and how to explain what is missing."""

    name: str
    frame: DataFrame
    counts: Mapping[str, Column] = field(default_factory=dict)
    reason: Callable[[], Column] | None = None
    reason_none: Callable[[], Column] | None = None
    extra: DataFrame | None = None
    empty: str = ""
    applicable: Column | None = None
    never_fails: bool = False


def plural_gap() -> Column:
    return F.when(
        F.col("evaluados") < F.col("aplicables"),
        F.format_string("%d de %d casos no se pudieron comprobar",
                        F.col("aplicables") - F.col("evaluados"), F.col("aplicables")))


def rule_results(rule: Rule, docs: DataFrame | None = None) -> DataFrame:
    """One row per document. ``docs`` adds documents without any case."""
    f = rule.frame
    v = F.col("veredicto")
    again = F.col("recalculado") if "recalculado" in f.columns else F.lit(False)
    applicable = F.count(F.lit(1)) if rule.applicable is None else rule.applicable
    agg = f.groupBy("doc_id").agg(
        applicable.alias("aplicables"),
        F.count("veredicto").alias("evaluados"),
        F.count_if(v == EXACT).alias("exactas"),
        F.count_if((v == EXACT) & again).alias("exactas_recalculadas"),
        F.count_if(v == CLOSE).alias("con_tolerancia"),
        F.count_if(v == BAD).alias("discrepancias"),
        *[c.alias(n) for n, c in rule.counts.items()],
    )
    if rule.extra is not None:
        agg = agg.join(rule.extra, "doc_id", "left")
    if docs is not None:
        agg = docs.select("doc_id").distinct().join(agg, "doc_id", "left")
    nums = ["aplicables", "evaluados", "exactas", "exactas_recalculadas",
            "con_tolerancia", "discrepancias"]
    agg = agg.na.fill(0, nums + list(rule.counts))

    own = rule.reason() if rule.reason else F.lit(None).cast("string")
    own = F.when(F.length(own) > 0, own)
    none = rule.reason_none() if rule.reason_none else own
    none = F.when(F.length(none) > 0, none)
    if rule.empty:
        none = F.when(F.col("aplicables") == 0, rule.empty).otherwise(none)
    motivo = F.when(
        F.col("evaluados") == 0,
        F.coalesce(none, plural_gap(),
                   F.lit("el documento no trajo ningun caso de esta regla")),
    ).otherwise(F.coalesce(own, plural_gap(), F.lit("")))
    differs = F.col("discrepancias") > 0
    if rule.never_fails:
        estado = F.when((F.col("evaluados") == 0) | differs, NO_VERIFICABLE)
    else:
        estado = F.when(F.col("evaluados") == 0, NO_VERIFICABLE).when(differs, FALLA)
    out = agg.select(
        "*",
        F.lit(rule.name).alias("regla"),
        estado.otherwise(CUADRA).alias("estado"),
        (F.col("exactas") - F.col("exactas_recalculadas")).alias("exactas_impresas"),
        motivo.alias("motivo"),
    )
    if rule.never_fails:  # differences are handed over as a question, not as failures
        out = out.withColumn("discrepancias", F.lit(0).cast("bigint"))
    return out.select(*RESULT_COLUMNS)


def rule_discrepancies(rule: Rule) -> DataFrame:
    """The failed cases. ``indice`` is the ``seq`` of the named row, -1 for a whole document."""
    bad = rule.frame.filter(F.col("veredicto") == BAD)
    return bad.select(
        "doc_id", F.lit(rule.name).alias("regla"), F.col("subregla"),
        F.col("seq").cast("bigint").alias("indice"), F.col("fila").cast("string").alias("fila"),
        money("esperado").alias("esperado"), money("obtenido").alias("obtenido"))


def rule_tolerated(rule: Rule) -> DataFrame:
    """The cases that only passed by using the tolerance."""
    near = rule.frame.filter(F.col("veredicto") == CLOSE)
    return near.select("doc_id", F.lit(rule.name).alias("regla"), F.col("subregla"),
                       F.col("seq").cast("bigint").alias("indice"),
                       F.col("fila").cast("string").alias("fila"))


def contract_violations(results: DataFrame) -> DataFrame:
    """Rows of a result table that break its own contract. Must be empty."""
    c = F.col
    broken = F.concat_ws(
        "; ",
        F.when((c("estado") == CUADRA) & c("aplicables").isNull(), "cuadra sin universo"),
        F.when((c("estado") == CUADRA) & (c("evaluados") == 0), "cuadra sin evaluar"),
        F.when(c("aplicables") < c("evaluados"), "aplicables < evaluados"),
        F.when(c("exactas_impresas") + c("exactas_recalculadas") != c("exactas"),
               "impresas + recalculadas <> exactas"),
    )
    return (results.withColumn("violacion", broken).filter(F.length("violacion") > 0)
            .select("doc_id", "regla", "estado", "violacion"))


def half_comparisons(discrepancies: DataFrame) -> DataFrame:
    """V21 for discrepancies: both amounts are set or both are null."""
    return discrepancies.filter(F.col("esperado").isNull() != F.col("obtenido").isNull())


def enforce_contract(results: DataFrame) -> DataFrame:
    """V21 strict: fail the job on the first broken result row."""
    c = F.col
    bad = (((c("estado") == CUADRA) & (c("aplicables").isNull() | (c("evaluados") == 0)))
           | (c("aplicables") < c("evaluados"))
           | (c("exactas_impresas") + c("exactas_recalculadas") != c("exactas")))
    checked = F.when(F.coalesce(bad, F.lit(False)),
                     F.raise_error(F.concat(F.lit("broken rule result: "), c("regla")))
                     .cast("string")).otherwise(c("regla"))
    return results.withColumn("regla", checked)


def coverage(results: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document, how many rules and over how many cases."""
    e = F.col("estado")
    agg = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reglas"),
        F.count_if(e == CUADRA).alias("cuadran"),
        F.count_if(e == FALLA).alias("fallan"),
        F.count_if(e == NO_VERIFICABLE).alias("no_verificables"),
        F.sum(F.coalesce("aplicables", F.lit(0))).alias("aplicables"),
        F.sum("evaluados").alias("evaluados"),
        F.sum("exactas_recalculadas").alias("exactas_recalculadas"),
        F.count_if(F.col("aplicables").isNull()).alias("sin_universo"),
        F.sum("discrepancias").alias("discrepancias"),
    )
    s = lambda n: F.when(F.col(n) != 1, "s").otherwise("")
    text = F.concat(
        F.format_string("%d reglas: %d cuadran, %d fallan, %d no verificable",
                        "reglas", "cuadran", "fallan", "no_verificables"),
        s("no_verificables"),
        F.format_string("; %d de %d casos evaluados", "evaluados", "aplicables"),
        F.when(F.col("sin_universo") > 0,
               F.concat(F.format_string(" (%d regla", "sin_universo"), s("sin_universo"),
                        F.lit(" con universo sin determinar)"))).otherwise(""),
        F.when(F.col("exactas_recalculadas") > 0,
               F.format_string(
                   "; OJO: %d de esas comprobaciones cayeron sobre saldos recalculados "
                   "por el sistema, no sobre dato impreso", "exactas_recalculadas"))
        .otherwise(""))
    return agg.withColumn("resumen", text)
