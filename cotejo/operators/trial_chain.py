"""The chain of a trial balance: cells and a column mapping -> typed rows -> rules -> outcome of the document.

A mapping is known (a template of the tenant's format) or searched; only documents without a template are searched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import row_mark
from cotejo.operators import reading as rd
from cotejo.operators import rules_trial as rt
from cotejo.operators.skew import by_page, by_seq, join_small
from cotejo.operators.suites import suite_results
from cotejo.operators.verdict import AMOUNT, coverage
from cotejo.session import stage

c = F.col
SPLIT = ("saldo_ini_deudor", "saldo_ini_acreedor", "saldo_fin_deudor", "saldo_fin_acreedor")
SIGNED = ("saldo_inicial", "saldo_final")
MONEY_ROLES = (*SIGNED, *SPLIT, "debe", "haber")
#: Lines of one page; a page is physically bounded.
PAGE_LINES = 100_000


def reading_rows(cells: DataFrame, mapped: DataFrame) -> DataFrame:
    """Lines with their cells under the roles of ``mapped`` (doc_id, asigna); documents without a mapping are left out."""
    known = join_small(cells, mapped.filter(c("asigna").isNotNull()).select("doc_id"), "doc_id", by_page(), "left_semi")
    roles = mapped.select("doc_id", F.explode("asigna").alias("campo", "idx"))
    return rd.role_rows(known, roles, ("cuenta", "nombre", "naturaleza", *MONEY_ROLES))


def raw_rows(rows: DataFrame) -> DataFrame:
    """R1 in reading order: amounts that a form or a line does not print are zero."""
    marks = rows.select(*rd.LINE, row_mark(F.split("nombre", " ")).alias("marca"))
    zero = F.lit(0).cast(AMOUNT)
    r = rd.trial_rows(rows, marks, MONEY_ROLES)
    return r.withColumn("seq", c("page").cast("long") * PAGE_LINES + c("line")).withColumns(
        {m: F.coalesce(c(m).cast(AMOUNT), zero) for m in MONEY_ROLES})


def typed_rows(raw: DataFrame, forms: DataFrame) -> DataFrame:
    """Trial-balance rows of either form; ``forms`` (doc_id, dividida) says whose balances come in a debtor and a creditor column."""
    base = rt.resolve(raw)
    own = join_small(raw.select("doc_id", "seq", *SPLIT), forms.filter("dividida").select("doc_id"), "doc_id", by_seq(), "left_semi")
    j = base.join(own.select("doc_id", "seq", *[c(m).alias(f"_{m}") for m in SPLIT]), ["doc_id", "seq"], "left")
    return j.select(*[F.coalesce(f"_{m}", m).alias(m) if m in SPLIT else c(m) for m in base.columns])


def read_trials(cells: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells to ``(raw rows, typed rows, printed totals)``, stage tables; ``mapped`` is (doc_id, asigna)."""
    rows = stage(reading_rows(cells, mapped))
    raw = stage(raw_rows(rows))
    forms = mapped.select("doc_id", F.coalesce(F.map_contains_key("asigna", F.lit(SPLIT[0])), F.lit(False)).alias("dividida"))
    return raw, stage(typed_rows(raw, forms)), stage(rd.trial_totals(rows))


def choose_mappings(readings: DataFrame, store: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T3 + T7: the template's mapping where the tenant knows the format, else what ``search`` finds.

    ``readings``: (doc_id, tenant_id, huella). ``search`` gets the documents without a template (doc_id) and returns (doc_id, forma,
    mapeo, asigna, motivo, orientada, verificado_por); a document it does not return has no mapping.
    """
    t = store.select("tenant_id", "huella", c("forma"), c("mapeo").alias("asigna"), c("orientacion_verificada").alias("orientada"),
                     "verificado_por", F.lit(True).alias("reutilizada"))
    hit = stage(readings.join(t, ["tenant_id", "huella"], "left"))
    found = search(hit.filter("reutilizada IS NULL").select("doc_id"))
    names = ["forma", "asigna", "orientada", "verificado_por"]
    new = readings.join(found.select("doc_id", *names, "motivo"), "doc_id").select(
        "doc_id", "tenant_id", "huella", *names, F.lit(False).alias("reutilizada"), "motivo")
    return hit.filter("reutilizada").select("doc_id", "tenant_id", "huella", *names, "reutilizada", F.lit("").alias("motivo")).unionByName(new)


def verdicts(balanza: DataFrame, totales: DataFrame, rules: Sequence | None = None) -> DataFrame:
    """Results of the trial-balance rules, one row a document and rule."""
    return suite_results(rules or rt.trial_rules(balanza, totales))


def outcomes(docs: DataFrame, mapped: DataFrame, missing: DataFrame, results: DataFrame) -> DataFrame:
    """One row per document: ``cuadra``, ``con_discrepancias`` or ``rechazado`` with the reason, and how much was checked.

    ``missing`` is M4. A document whose columns allow no mapping names the columns it lacks.
    """
    cover = coverage(results).select("doc_id", "reglas", "cuadran", "fallan", "no_verificables", "aplicables", "evaluados")
    j = docs.select("doc_id").distinct().join(mapped.select("doc_id", "reutilizada", c("motivo").alias("_m")), "doc_id", "left") \
        .join(missing.select("doc_id", "faltan"), "doc_id", "left").join(cover, "doc_id", "left")
    lacks = F.concat(F.lit("el layout no parece una balanza; faltan las columnas: "), F.coalesce("faltan", F.lit("")))
    return j.select(
        "doc_id", F.when(c("reglas").isNull(), "rechazado").when(c("fallan") > 0, "con_discrepancias").otherwise("cuadra").alias("estado"),
        F.when(c("reglas").isNotNull(), "").when(F.coalesce("_m", F.lit("")) != "", c("_m")).otherwise(lacks).alias("motivo"),
        F.coalesce("reutilizada", F.lit(False)).alias("reutilizada"),
        *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("reglas", "cuadran", "fallan", "no_verificables", "aplicables", "evaluados")])
