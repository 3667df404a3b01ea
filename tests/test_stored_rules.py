"""Cases of a suite stored once: the same results, discrepancies and tolerated cases as from the rules themselves."""

import pytest
from pyspark.sql import functions as F

from cotejo.operators.scan import ordered_scan
from cotejo.operators.suites import stored_rules, suite_discrepancies, suite_results, suite_tolerated
from cotejo.operators.verdict import Rule, compare, money


def cases(spark):
    rows = [(d, k, f"fila {k % 3}", float(k % 4), None if k % 5 == 0 else k % 4 + (k % 3) * 0.01 * (1 + k % 2)) for d in (1, 2) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, seq long, fila string, e double, o double").select(
        "doc_id", "seq", "fila", F.lit("x").alias("subregla"), money("e").alias("esperado"), F.col("o").cast("decimal(18,2)").alias("obtenido"),
        compare(money("e"), F.col("o").cast("decimal(18,2)")).alias("veredicto"), (F.col("seq") % 7 == 0).alias("propia"))


@pytest.mark.parametrize("make", [suite_results, suite_discrepancies, suite_tolerated])
def test_stored_rules_say_the_same(spark, make):
    c = cases(spark)
    rules = [Rule("uno", c, counts={"n": F.count_if("propia"), "sin": F.count_if(F.col("obtenido").isNull())},
                  reason=lambda: F.format_string("%d propias, %d sin", "n", "sin")),
             Rule("dos", c.drop("propia"), applicable=F.count_distinct("fila") * 2),
             Rule("tres", c.withColumn("recalculado", F.col("seq") % 2 == 0))]
    got, want = make(stored_rules(rules)), make(rules)
    assert got.columns == want.columns and want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_second_scan_of_dealt_rows_moves_nothing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), (F.col("id") * 16384).alias("seq"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
        once = ordered_scan(rows, ["doc_id"], "seq", lag={"p": F.col("v")}, keep=True)
        twice = ordered_scan(once, ["doc_id"], "seq", before={"b": F.coalesce("v", "p")}, dealt=True)
        plain = ordered_scan(once.drop("_span"), ["doc_id"], "seq", before={"b": F.coalesce("v", "p")})
        assert twice.columns == plain.columns == ["doc_id", "seq", "v", "p", "b"]
        assert sorted(map(str, twice.collect())) == sorted(map(str, plain.collect()))
        moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL")
        assert moves(twice) < moves(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
