"""Several tables published as one: readers see a whole version or the one before."""

import pytest
from pyspark.sql import functions as F

from cotejo.session import shared_dir
from cotejo.sources import sinks


def tables(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(n).alias("x"))
    return {"uno": rows, "dos": rows.withColumn("x", F.col("x") + 1)}


def test_a_version_is_read_whole(spark):
    folder = f"{shared_dir(spark)}/sink-whole"
    first = sinks.publish(spark, tables(spark, 3), folder)
    second = sinks.publish(spark, tables(spark, 5), folder)
    assert first < second
    assert sinks.published(spark, folder, "uno").count() == 5
    assert sinks.published(spark, folder, "uno", first).count() == 3
    got = {(r.version, r.tabla): r.filas for r in sinks.versions(spark, folder).collect()}
    assert got == {(first, "uno"): 3, (first, "dos"): 3, (second, "uno"): 5, (second, "dos"): 5}


def test_a_run_that_dies_changes_nothing_for_readers(spark):
    folder = f"{shared_dir(spark)}/sink-dies"
    sinks.publish(spark, tables(spark, 4), folder)
    broken = {"uno": spark.range(9).withColumnRenamed("id", "doc_id"),
              "dos": spark.range(9).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("broken")).cast("int").alias("x"))}
    with pytest.raises(Exception, match="broken"):
        sinks.publish(spark, broken, folder)
    assert sinks.published(spark, folder, "uno").count() == 4 and sinks.published(spark, folder, "dos").count() == 4


def test_a_shared_account_number_names_no_account(spark):
    accounts = spark.createDataFrame([(1, 1, "7", "c1", "p1"), (1, 2, "7", "c2", "p2"), (1, 3, "8", "c3", "p3")],
                                     "doc_id long, seq long, num_cuenta string, clabe string, producto string")
    for c in ("moneda",):
        accounts = accounts.withColumn(c, F.lit("MXN"))
    for c in ("saldo_inicial", "depositos", "retiros", "saldo_corte"):
        accounts = accounts.withColumn(c, F.lit(1).cast("decimal(18,2)"))
    meta = spark.createDataFrame([(1, "b", "r", "i", "f")], "doc_id long, banco string, rfc string, periodo_ini string, periodo_fin string")
    moves = spark.createDataFrame([(1, 1, "7"), (1, 2, "8"), (1, 3, "9")], "doc_id long, seq long, num_cuenta string")
    totals = accounts.select("doc_id", "num_cuenta", F.lit(0).alias("leido_depositos"), F.lit(0).alias("leido_retiros")).distinct()
    got = sinks.bank_tables(meta, accounts, moves, totals, {"validacion": meta})
    assert list(got) == ["cuentas", "movimientos", "plana", "validacion"]
    assert sorted((r.num_cuenta, r.producto) for r in got["plana"].collect()) == [("7", None), ("8", "p3"), ("9", None)]
