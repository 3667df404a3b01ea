"""A spread of registered queries against their checking SQL at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from cotejo.plans.relations import TABLES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import norm  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PICK = ["V9_journal_double_entry", "V12_journal_invoices_crossed", "V6_subledger_running_balance", "A10_subledger_refill",
        "V2_trial_hierarchy", "A3_A4_trial_rows", "V15_bank_running_balance", "V18_ledger_accumulated", "O1_journal_heads",
        "D4_hierarchy_universe", "F9_statement_dates", "K3_split_glued_dates", "L9_table_region", "M3_proposals",
        "T2_learn_templates", "E2E_trial_outcomes", "R10_R11_R13_journal_moves", "R5_R6_subledger_rows", "I1_intake_stream"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", PICK)
def test_query(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    got = sorted(tuple(norm(v) for v in r) for r in df.collect())
    cur = con.execute(contract.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    ix = [cols.index(k) for k in df.columns]
    assert got == sorted(tuple(norm(r[i]) for i in ix) for r in cur.fetchall())
    assert got


def test_entry(spark):
    assert contract.entry(spark).count() == 16


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
