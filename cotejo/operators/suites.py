"""All rules of a document kind as one table, in rule order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.verdict import (
    BAD,
    CLOSE,
    Rule,
    money,
    rule_discrepancies,
    rule_results,
    rule_tolerated,
)
from cotejo.session import stage


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def suite_results(rules: Sequence[Rule], docs: DataFrame | None = None) -> DataFrame:
    """One row per document and rule."""
    return _union([rule_results(r, docs).withColumn("n_regla", F.lit(i))
                   for i, r in enumerate(rules, 1)])


def suite_discrepancies(rules: Sequence[Rule]) -> DataFrame:
    """Every discrepancy with its rule number; order by (n_regla, indice)."""
    return _union([rule_discrepancies(r).withColumn("n_regla", F.lit(i))
                   for i, r in enumerate(rules, 1)])


def suite_tolerated(rules: Sequence[Rule]) -> DataFrame:
    return _union([rule_tolerated(r).withColumn("n_regla", F.lit(i))
                   for i, r in enumerate(rules, 1)])


def stored_rules(rules: Sequence[Rule]) -> list[Rule]:
    """The same rules over one stage table of their cases, so results, discrepancies and tolerated cases come from one run.

    Place, name and amounts are kept of the cases that failed or used the tolerance; of the others only verdict, own
    columns and whether an amount was found, which is what a rule counts by. A rule that counts its universe itself
    (``applicable``) keeps all of them.
    """
    f = F.col
    frames = []
    for i, r in enumerate(rules):
        named = f("veredicto").isin(BAD, CLOSE) if r.applicable is None else F.lit(True)
        frames.append(r.frame.withColumns({
            "seq": F.when(named, f("seq").cast("bigint")), "fila": F.when(named, f("fila").cast("string")),
            "esperado": F.when(named, money("esperado")),
            "obtenido": F.when(named, money("obtenido")).when(f("obtenido").isNotNull(), money(F.lit(0))),
            "_regla": F.lit(i)}))
    every = stage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))
    return [replace(r, frame=every.filter(f("_regla") == i).select(*r.frame.columns)) for i, r in enumerate(rules)]
