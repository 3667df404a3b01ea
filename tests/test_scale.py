"""Cases that only large inputs meet."""

import re

import pytest
from pyspark.sql import functions as F

from cotejo.functions.accounts import ancestors_of
from cotejo.functions.text import parse_money
from cotejo.operators.reading_bank import section_lines
from cotejo.operators.rules_journal import entry_totals
from cotejo.operators.rules_ledger import natures
from cotejo.operators.scan import ordered_scan
from cotejo.session import shared_dir


def test_a_scan_after_a_join_deals_rows_out_by_span(spark):
    """A join on the key alone must not decide where the rows of a hot key go."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("seq"))
        heads = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("h"))
        plan = ordered_scan(rows.join(heads, "doc_id"), ["doc_id"], "seq", running={"r": F.col("h")})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = plan[plan.index("Window"):]
    exchange = re.search(r"Exchange hashpartitioning\(([^)]*)\)", first)
    assert "_span" in exchange[1]


def test_month_order_holds_on_late_pages(spark):
    """Three months printed in falling order on pages from 20,000 on: three debit votes."""
    page = 1 << 36
    months = spark.createDataFrame(
        [(1, "A", 3, (20_000 * page), 30), (1, "A", 2, (20_001 * page), 20), (1, "A", 1, (20_002 * page), 10)],
        "doc_id long, cuenta string, orden int, seq long, s int").select(
        "doc_id", "cuenta", "orden", "seq", F.lit(10).cast("decimal(18,2)").alias("cargos"),
        F.lit(0).cast("decimal(18,2)").alias("abonos"), F.col("s").cast("decimal(18,2)").alias("saldo"))
    heads = spark.createDataFrame([(1, "A", 0)], "doc_id long, cuenta string, i int").select(
        "doc_id", "cuenta", F.col("i").cast("decimal(18,2)").alias("saldo_inicial"))
    (r,) = natures(heads, months).collect()
    assert (r.votos_d, r.votos_a, r.naturaleza) == (3, 0, "D")


def test_ancestors_of_a_deep_account(spark):
    account = "-".join(["100"] + ["01"] * 11)
    df = spark.createDataFrame([(account,)], "c string")
    null = F.lit(None).cast("int")
    (r,) = df.select(ancestors_of(F.col("c"), F.array().cast("array<int>"), null, null).alias("p")).collect()
    assert len(r.p) == 11 and r.p[-1] == "100"


def test_money_cells_with_other_white_space(spark):
    df = spark.createDataFrame([("\t1,200.50 ",), (" (3.00)\n",)], "c string")
    assert [float(r.v) for r in df.select(parse_money(F.col("c")).alias("v")).collect()] == [1200.50, -3.0]


def test_longest_product_name_wins(spark):
    word = lambda t: [(0.0, 0, 1.0, t, 0)]
    lines = spark.createDataFrame([(1, 10, word("ENLACE ORO PLUS 9")), (1, 11, word("ENLACE OTRO")), (1, 12, word("AB 1")), (2, 13, word("ENLACE ORO"))],
                                  "doc_id long, seq long, w array<struct<x0:double,pos:int,x1:double,text:string,run:int>>")
    accounts = spark.createDataFrame([(1, 1, "n1", "ENLACE ORO"), (1, 2, "n2", "ENLACE ORO PLUS"), (1, 3, "n3", "AB")],
                                     "doc_id long, seq long, num_cuenta string, producto string")
    assert sorted((r.seq, r.seccion) for r in section_lines(lines, accounts).collect()) == [(10, "n2"), (12, "n3")]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master, applicationId = "spark://head:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_sums_beyond_one_amount(spark):
    """Three amounts of 9e15 exceed the type of one amount."""
    moves = spark.createDataFrame([(1, 1, k, 9 * 10 ** 15) for k in range(3)], "doc_id long, poliza_id long, seq long, v long").select(
        "doc_id", "poliza_id", "seq", F.col("v").cast("decimal(18,2)").alias("debe"), F.lit(0).cast("decimal(18,2)").alias("haber"))
    (r,) = entry_totals(moves).collect()
    assert int(r.leido_debe) == 27 * 10 ** 15
