"""U1 + U3: rules as an open list, vocabularies as tables that are read at run time.

A registry is a value: adding a rule gives another registry, so a user's rules never leak into someone else's run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators import rules_bank, rules_journal, rules_ledger, rules_subledger, rules_trial
from cotejo.operators.suites import suite_discrepancies, suite_results
from cotejo.operators.verdict import Rule, contract_violations

Tables = Mapping[str, DataFrame]
Builder = Callable[[Tables], Rule | Sequence[Rule]]
VOCABULARY = "forma string, orden int, campo string, obligatorio int, sinonimo string"


@dataclass(frozen=True)
class Registry:
    """Per document kind the builders of its rules, in rule order; a builder makes rules of the kind's typed tables."""

    builders: Mapping[str, tuple[Builder, ...]] = field(default_factory=dict)

    def with_rule(self, kind: str, build: Builder) -> Registry:
        return Registry({**self.builders, kind: (*self.builders.get(kind, ()), build)})

    def rules(self, kind: str, tables: Tables) -> list[Rule]:
        out: list[Rule] = []
        for build in self.builders.get(kind, ()):
            made = build(tables)
            out += [made] if isinstance(made, Rule) else list(made)
        return out

    def results(self, kind: str, tables: Tables) -> DataFrame:
        """V22 over every registered rule of a kind."""
        return suite_results(self.rules(kind, tables))

    def discrepancies(self, kind: str, tables: Tables) -> DataFrame:
        return suite_discrepancies(self.rules(kind, tables))

    def violations(self, kind: str, tables: Tables) -> DataFrame:
        """V21 walks whatever is registered, a user's rules included."""
        return contract_violations(self.results(kind, tables))


#: What the library itself knows. Tables of a kind go by these names.
RULES = Registry({
    "polizas": (lambda d: rules_journal.journal_rules(d["polizas"], d["movimientos"], d["cfdi"]),),
    "auxiliar": (lambda d: rules_subledger.subledger_rules(d["auxiliar"], refilled=True),),
    "balanza": (lambda d: rules_trial.trial_rules(d["balanza"], d["totales"]),),
    "estado-cuenta": (lambda d: rules_bank.bank_rules(d["documento"], d["cuentas"], d["movimientos"]),),
    "mayor": (lambda d: rules_ledger.ledger_rules(d["cuentas"], d["meses"], d["balanza"]),),
})


def read_vocabulary(spark: SparkSession, *paths: str) -> DataFrame:
    """Forms, fields and synonyms from vocabulary tables; a form of a later table is one more form."""
    return spark.read.schema(VOCABULARY).parquet(*paths).distinct()


def forms_of(vocabulary: DataFrame) -> dict[str, list[tuple[str, bool]]]:
    """The roles of every form in claiming order, as the mapping search wants them. A vocabulary is a few hundred words."""
    rows = vocabulary.groupBy("forma", "campo").agg(F.min("orden").alias("orden"), F.max("obligatorio").alias("obligatorio")) \
        .orderBy("forma", "orden").collect()
    out: dict[str, list[tuple[str, bool]]] = {}
    for r in rows:
        out.setdefault(r.forma, []).append((r.campo, bool(r.obligatorio)))
    return out


def required_of(vocabulary: DataFrame) -> list[tuple[str, int, str]]:
    """(form, order, role) of every required role."""
    return [(form, n, role) for form, roles in forms_of(vocabulary).items() for n, (role, must) in enumerate(roles) if must]
