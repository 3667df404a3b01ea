"""Propose and verify: the lazy search against brute force, rounds, ambiguous columns."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from cotejo.operators import mapping as mp
from cotejo.operators.assignment import assignments, best_total
from cotejo.plans.relations import TRIAL_FORMS

SIGNED = [(role, req) for role, _, req in TRIAL_FORMS["saldo_con_signo"]]


def brute(roles, options):
    out = []

    def go(i, used, chosen, points):
        if i == len(roles):
            out.append((points, ",".join(f"{a}={b}" for a, b in chosen), dict(chosen)))
            return
        name, required = roles[i]
        for k, p in options.get(name, {}).items():
            if k not in used:
                go(i + 1, used | {k}, [*chosen, (name, k)], points + p)
        if not required:
            go(i + 1, used, chosen, points)

    go(0, set(), [], 0)
    return sorted(out, key=lambda t: (-t[0], t[1]))


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_brute_force(seed):
    rnd = random.Random(seed)
    roles = [(f"r{i}", rnd.random() < 0.6) for i in range(rnd.randint(1, 5))]
    options = {r: {k: rnd.randint(1, 3) for k in rnd.sample(range(12), rnd.randint(0, 4))} for r, _ in roles}
    want = brute(roles, options)
    assert list(assignments(roles, options)) == want
    total = best_total([options[r] for r, _ in roles], [q for _, q in roles])
    assert total == (want[0][0] if want else None)


def test_twelve_ambiguous_columns_are_searched_lazily():
    """Every column may play every role: 12!/4! assignments, of which only those asked for are made."""
    roles = SIGNED
    options = {r: {k: 2 for k in range(12)} for r, _ in roles}
    start = time.time()
    first = list(itertools.islice(assignments(roles, options), 500))
    assert time.time() - start < 10 and len({text for _, text, _ in first}) == 500
    assert all(len(set(chosen.values())) == len(chosen) for _, _, chosen in first)
    assert [p for p, _, _ in first] == sorted((p for p, _, _ in first), reverse=True)


def ambiguous(spark, true_columns):
    """One document of 12 amount columns, all of them candidates of all amount roles; the true ones obey the identity."""
    rnd = random.Random(3)
    cells = []
    for line in range(12):
        start, debit, credit = (rnd.randint(1000, 90000) for _ in range(3))
        value = dict(zip(true_columns, (start, debit, credit, start + debit - credit)))
        cells += [(1, 1, line, 0, f"101-{line:02d}"), (1, 1, line, 1, "CUENTA")]
        cells += [(1, 1, line, k, f"{value.get(k, rnd.randint(10 ** 6, 10 ** 7))}.00") for k in range(2, 14)]
    roles = [(r, k) for r in ("saldo_inicial", "debe", "haber", "saldo_final") for k in range(2, 14)]
    cands = [(1, "saldo_con_signo", r, k, 2) for r, k in [("cuenta", 0), ("nombre", 1), *roles]]
    return (spark.createDataFrame(cells, "doc_id long, page int, line int, idx int, texto string"),
            spark.createDataFrame(cands, "doc_id long, forma string, campo string, idx int, puntaje int"))


def test_rounds_reach_the_mapping_that_fits(spark):
    cells, cands = ambiguous(spark, (4, 2, 3, 5))
    sample = mp.sampled_lines(cells, 2)
    got = mp.first_verified(cands, {"saldo_con_signo": SIGNED}, lambda p: mp.trial_fits(p, sample), 40).collect()
    lines = {}
    for r in cells.filter("idx > 1").collect():
        lines.setdefault(r.line, {})[r.idx] = float(r.texto)
    options = {r: {k: 2 for k in range(2, 14)} for r in ("saldo_inicial", "debe", "haber", "saldo_final")} | {"cuenta": {0: 2}, "nombre": {1: 2}}

    def fits(m):  # either identity, line by line
        return all(abs(v[m["saldo_final"]] - v[m["saldo_inicial"]]) == abs(v[m["debe"]] - v[m["haber"]]) for v in lines.values())

    at, want = next((n, text) for n, (_, text, m) in enumerate(assignments(SIGNED, options), 1) if fits(m))
    assert at > 40 and [(r.mapeo, r.probados, r.motivo) for r in got] == [(want, at, "")]


def test_document_that_nothing_fits_reports_all_tried(spark):
    cells, cands = ambiguous(spark, (20, 21, 22, 23))
    few = cands.filter(F.col("idx") < 6)
    sample = mp.sampled_lines(cells, 2)
    got = mp.first_verified(few, {"saldo_con_signo": SIGNED}, lambda p: mp.trial_fits(p, sample), 5).collect()
    assert [(r.mapeo, r.probados) for r in got] == [(None, 24)] and "ninguno de los 24" in got[0].motivo


def test_swapped_columns_without_month_balance_stay_undecided(spark):
    cells, cands = ambiguous(spark, (2, 3, 4, 5))
    sample = mp.sampled_lines(cells, 2)

    def fits(p, swapped=False):
        return mp.trial_fits(p, sample, swapped=swapped)

    few = cands.filter(F.col("idx") < 6)
    row = mp.oriented(mp.first_verified(few, {"saldo_con_signo": SIGNED}, fits), fits).first()
    assert row.orientada is False and row.verificado_por == "vocabulario"


def test_shape_scores_only_columns_that_no_synonym_names(spark):
    columns = spark.createDataFrame([(1, 0, ""), (1, 1, "Saldo"), (1, 2, "")], "doc_id long, idx int, header string")
    shapes = spark.createDataFrame([(1, 0, "fecha"), (1, 1, "monto"), (1, 2, "texto")], "doc_id long, idx int, forma string")
    fields = spark.createDataFrame([(0, "fecha", 1, "fecha", "fecha"), (1, "debe", 1, "monto", "cargos"), (2, "saldo", 1, "monto", "saldo"),
                                    (3, "concepto", 0, "texto", "concepto")], "orden int, campo string, obligatorio int, forma string, sinonimo string")
    got = {(r.campo, r.idx): r.puntaje for r in mp.shape_candidates(columns, shapes, fields, "auxiliar").collect()}
    assert got == {("fecha", 0): 1, ("debe", 1): 1, ("saldo", 1): 3}


def test_no_candidates(spark):
    cands = spark.createDataFrame([], "doc_id long, forma string, campo string, idx int, puntaje int")
    sample = mp.sampled_lines(spark.createDataFrame([], "doc_id long, page int, line int, idx int, texto string"), 2)
    assert mp.first_verified(cands, {"saldo_con_signo": SIGNED}, lambda p: mp.trial_fits(p, sample)).count() == 0
