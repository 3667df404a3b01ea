"""Column-role mapping: the vocabulary proposes, the document's arithmetic decides.

Proposals are drawn lazily, best first, a few per document and round; what a round proposes is checked on
the sampled lines of the document, and only documents without an accepted mapping go on to the
next round, with twice as many proposals. The columns and the sample of a document are a few hundred cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.accounts import is_account
from cotejo.functions.text import cell_shape, parse_money, vocabulary_scores
from cotejo.operators.assignment import assignments
from cotejo.operators.verdict import AMOUNT, MONEY, TOLERANCE
from cotejo.session import stage

c = F.col
Forms = Mapping[str, Sequence[tuple[str, bool]]]
PROPOSALS = "doc_id long, orden_forma int, forma string, mapeo string, asigna map<string,int>, puntos long, rango long"


def role_candidates(columns: DataFrame, vocab: DataFrame) -> DataFrame:
    """M1: (doc_id, forma, orden, campo, idx, puntaje) for every column that may play a role."""
    keep = [k for k in ("doc_id", "idx", "header") if k in columns.columns]
    roles = vocab.select("forma", "orden", "campo", "obligatorio").distinct()
    # A synonym list belongs to (form, field): the same field may differ between forms.
    forms = vocab.select("forma", "campo", "sinonimo").withColumn("campo", F.concat_ws("/", "forma", "campo"))
    s = vocabulary_scores(columns.select(*keep), forms.select("campo", "sinonimo"), "header")
    return s.select("doc_id", "idx", "puntaje", F.split("campo", "/")[0].alias("forma"),
                    F.split("campo", "/")[1].alias("campo")).join(roles, ["forma", "campo"])


def missing_roles(docs: DataFrame, cands: DataFrame, required: list[tuple[str, int, str]]) -> DataFrame:
    """M4: the required roles without candidate, of the form that lacks fewest.

    ``required`` is the fixed list of (form, order, role).
    """
    forms = F.array(*[F.struct(F.lit(a).alias("forma"), F.lit(b).alias("orden"), F.lit(r).alias("campo"))
                      for a, b, r in required])
    every = docs.select("doc_id").distinct().select("doc_id", F.explode(forms).alias("r")).select("doc_id", "r.*")
    gone = every.join(cands.select("doc_id", "forma", "campo").distinct(), ["doc_id", "forma", "campo"], "left_anti")
    g = gone.groupBy("doc_id", "forma").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("orden", "campo"))), lambda s: s["campo"]), ", ").alias("faltan"))
    full = every.select("doc_id", "forma").distinct().join(g, ["doc_id", "forma"], "left").na.fill(0, ["n"]).na.fill("", ["faltan"])
    return full.groupBy("doc_id").agg(F.min(F.struct("n", "forma", "faltan")).alias("m")).select(
        "doc_id", c("m.n").cast("bigint").alias("n"), "m.forma", "m.faltan")


def shape_candidates(columns: DataFrame, shapes: DataFrame, fields: DataFrame, form: str) -> DataFrame:
    """M2 + M3: candidates of a form whose columns may lack a label.

    ``fields``: (orden, campo, obligatorio, forma, sinonimo), ``shapes`` the observed ones. A label scores 3 or 2; a
    column that no synonym of the field names scores 1 where its cells have the shape that the field expects.
    """
    labels = vocabulary_scores(columns.select("doc_id", "idx", "header"), fields.select("campo", "sinonimo"), "header")
    named = labels.select("doc_id", "idx", "campo", "puntaje")
    roles = fields.select("orden", "campo", "obligatorio", "forma").distinct()
    shaped = (shapes.select("doc_id", "idx", "forma").join(columns.select("doc_id", "idx"), ["doc_id", "idx"])
              .join(roles.filter("forma IN ('fecha', 'monto', 'entero')").select("campo", "forma"), "forma")
              .join(named.select("doc_id", "idx", "campo"), ["doc_id", "idx", "campo"], "left_anti")
              .select("doc_id", "idx", "campo", F.lit(1).cast(dict(named.dtypes)["puntaje"]).alias("puntaje")))
    return named.unionByName(shaped).join(roles.select("orden", "campo", "obligatorio"), "campo").withColumn("forma", F.lit(form))


def proposals(cands: DataFrame, forms: Forms, k: int, skip: int = 0) -> DataFrame:
    """M3: after the first ``skip``, the next ``k`` assignments of distinct columns to roles of each document and form.

    ``PROPOSALS``; the best score comes first, ties go by the printed mapping. A form for which a required
    role has no candidate proposes nothing.
    """
    order = [(n, form, [tuple(r) for r in roles]) for n, (form, roles) in enumerate(forms.items())]
    names = [f.split()[0] for f in PROPOSALS.split(", ")]

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, form, roles in order:
            own = rows[rows.forma == form]
            options: dict[str, dict[int, int]] = {}
            for field, idx, points in zip(own.campo, own.idx, own.puntaje):
                options.setdefault(field, {})[int(idx)] = int(points)
            drawn = itertools.islice(assignments(roles, options), skip, skip + k)
            out += [(key[0], n, form, text, chosen, points, at) for at, (points, text, chosen) in enumerate(drawn, skip + 1)]
        return pd.DataFrame(out, columns=names)

    return cands.select("doc_id", "forma", "campo", "idx", "puntaje").groupBy("doc_id").applyInPandas(draw, PROPOSALS)


def best_by_vocabulary(proposed: DataFrame) -> DataFrame:
    """The first proposal of the first form that has any."""
    w = Window.partitionBy("doc_id").orderBy("orden_forma", "rango")
    return proposed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


# ---------------------------------------------------------------- M5, M9: arithmetic of a sample
def sampled_lines(cells: DataFrame, pages: int) -> DataFrame:
    """The lines of each document's first ``pages`` pages with cells: ``lineas``, an array of column -> (texto, monto).

    Pages are bounded, so this is one small row per document, which every proposal of it meets.
    """
    first = cells.select("doc_id", "page").distinct()
    w = Window.partitionBy("doc_id").orderBy("page")
    first = first.withColumn("_n", F.row_number().over(w)).filter(c("_n") <= pages).drop("_n")
    text = F.trim("texto")
    value = F.when(text != "", parse_money(text).cast(AMOUNT))
    line = cells.join(first, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page", "line").agg(F.map_from_entries(
        F.collect_list(F.struct(c("idx").cast("int"), F.struct(text.alias("texto"), value.alias("monto"))))).alias("celdas"))
    return line.groupBy("doc_id").agg(F.collect_list("celdas").alias("lineas"))


def trial_fits(proposed: DataFrame, sample: DataFrame, minimum: int = 5, swapped: bool = False) -> DataFrame:
    """M5 for every proposal: ``proposed`` plus ``filas``, ``buenas``, ``mes_malo`` and ``verificado``.

    At least ``minimum`` account lines, nine tenths of which satisfy the identity of their form; a printed month
    balance that differs from the month's moves rejects the proposal.
    """
    tol, zero = F.lit(TOLERANCE).cast(MONEY), F.lit(0).cast(MONEY)

    def cell(line: Column, role: str) -> Column:
        return F.try_element_at(line, F.try_element_at("asigna", F.lit(role)))

    def amount(line: Column, role: str) -> Column:
        return cell(line, role)["monto"].cast(MONEY)

    debit, credit = ("haber", "debe") if swapped else ("debe", "haber")

    def judged(line: Column) -> Column:
        move = amount(line, debit) - amount(line, credit)
        split = amount(line, "saldo_ini_deudor")
        start = F.when(split.isNotNull(), split - F.coalesce(amount(line, "saldo_ini_acreedor"), zero)).otherwise(
            F.coalesce(amount(line, "saldo_inicial"), zero))
        end = F.when(split.isNotNull(), amount(line, "saldo_fin_deudor") - F.coalesce(amount(line, "saldo_fin_acreedor"), zero)).otherwise(
            F.coalesce(amount(line, "saldo_final"), zero))
        debtor, creditor = F.abs(start + move - end) <= tol, F.abs(start - move - end) <= tol
        fits = debtor | (split.isNull() & (creditor | (move == zero)))
        return F.struct(F.coalesce(fits, F.lit(False)).alias("buena"),
                        F.coalesce(F.abs(amount(line, "saldo_mes") - move) > tol, F.lit(False)).alias("mes_malo"))

    rows = F.filter("lineas", lambda line: F.coalesce(is_account(cell(line, "cuenta")["texto"]), F.lit(False)))
    j = proposed.join(sample, "doc_id").withColumn("_filas", F.transform(rows, judged))
    return j.select(
        *proposed.columns, F.size("_filas").cast("long").alias("filas"),
        F.size(F.filter("_filas", lambda r: r["buena"])).cast("long").alias("buenas"),
        F.exists("_filas", lambda r: r["mes_malo"]).alias("mes_malo")).withColumn(
        "verificado", (c("filas") >= minimum) & ~c("mes_malo") & (c("buenas") * 10 >= c("filas") * 9))


# ------------------------------------------------------------------------------ M8: first verified
def first_verified(cands: DataFrame, forms: Forms, verify: Callable[[DataFrame], DataFrame], first: int = 40) -> DataFrame:
    """M8: per document the first proposal that ``verify`` accepts (``PROPOSALS`` in, plus ``verificado`` out).

    Round by round: ``first`` proposals of each form, then twice as many of what is left, and only for the
    documents still unsolved, until each is solved or has no more proposals. ``probados`` counts the
    proposals tried; ``motivo`` says why a document has no mapping. A document without any proposal is absent.
    """
    open_, tried, results = stage(cands), None, []
    skip, k = 0, first
    while True:
        batch = stage(verify(proposals(open_, forms, k, skip)))
        w = Window.partitionBy("doc_id").orderBy("orden_forma", "rango")
        here = batch.withColumn("_n", F.row_number().over(w).cast("long")).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("_todas"), F.min(F.when(c("verificado"), c("_n"))).alias("_en"),
            F.min_by(F.struct("forma", "mapeo", "asigna", "puntos"), F.when(c("verificado"), c("_n"))).alias("m"))
        if tried is None:
            here = here.withColumn("_antes", F.lit(0).cast("long"))
        else:
            results.append(tried.join(here.select("doc_id"), "doc_id", "left_anti")
                           .select("doc_id", F.lit(None).cast(here.schema["m"].dataType).alias("m"), c("_antes").alias("probados")))
            here = here.join(tried, "doc_id")
        here = stage(here.select("doc_id", "m", (c("_antes") + F.coalesce("_en", "_todas")).alias("probados"), c("_en").isNotNull().alias("_ok")))
        results.append(here.filter("_ok").drop("_ok"))
        tried = here.filter("NOT _ok").select("doc_id", c("probados").alias("_antes"))
        if tried.isEmpty():
            break
        open_ = open_.join(tried.select("doc_id"), "doc_id", "left_semi")
        skip, k = skip + k, 2 * k
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    return every.select("doc_id", "m.*", "probados", F.when(c("m").isNull(), F.format_string(
        "ninguno de los %d mapeos propuestos hace cuadrar la aritmetica del documento", "probados")).otherwise("").alias("motivo"))


def oriented(accepted: DataFrame, fits: Callable[..., DataFrame]) -> DataFrame:
    """M9: ``accepted`` plus ``orientada`` (swapping debit and credit breaks the arithmetic) and ``verificado_por``."""
    swapped = fits(accepted.filter(c("mapeo").isNotNull()), swapped=True).select("doc_id", (~c("verificado")).alias("orientada"))
    return accepted.join(swapped, "doc_id", "left").withColumn(
        "verificado_por", F.when(c("orientada"), "aritmetica").when(~c("orientada"), "vocabulario"))


def observed_shape(cell_table: DataFrame, share: float = 0.8) -> DataFrame:
    """M2: the shape that covers 80 % of the non-empty cells of a column, tried in order."""
    s = cell_table.filter(F.trim("texto") != "").withColumn("_s", cell_shape(c("texto")))

    def rate(n: str) -> Column:
        return F.count_if(c("_s") == n) >= F.count(F.lit(1)) * share

    return s.groupBy("doc_id", "idx").agg(
        F.count(F.lit(1)).alias("celdas"),
        F.when(rate("fecha"), "fecha").when(rate("monto"), "monto").when(rate("entero"), "entero")
        .otherwise("texto").alias("forma"))
