"""A sign printed as its own token belongs to the amount behind it, in cells and in values."""

from decimal import Decimal

from pyspark.sql import functions as F

from cotejo.operators import reading as rd
from cotejo.operators import reading_bank as bk
from cotejo.operators import tokens as tk

COLUMNS = [(1, 1, f, a, b) for f, a, b in (("fecha", 20.0, 36.0), ("descripcion", 80.0, 114.0), ("referencia", 250.0, 281.0),
                                           ("retiro", 358.0, 380.0), ("deposito", 422.0, 450.0), ("saldo", 504.0, 520.0))]


def test_negative_balance_is_an_amount(spark):
    rows = []
    for line, signs in enumerate((["-$"], ["$"], ["-"], ["$", "-"], [])):
        words = [("30-ENE", 20.0, 38.0), ("view", 80.0, 93.0), ("REF7", 245.0, 258.0), ("63.45", 364.0, 380.0),
                 *[(s, 480.0 + 8 * i, 486.0 + 8 * i) for i, s in enumerate(signs)], ("10.15", 504.0, 520.0)]
        rows += [(1, 1, line, pos, t, a, b, 1) for pos, (t, a, b) in enumerate(words)]
    words = spark.createDataFrame(rows, "doc_id long, page long, line long, pos int, text string, x0 double, x1 double, run int")
    lines = rd.pack_lines(tk.join_signs(words)).withColumn("cab", F.lit(1).cast("long"))
    columns = spark.createDataFrame(COLUMNS, "doc_id long, cab long, campo string, x_min double, x_max double")
    cells = bk.move_cells(lines, columns).select("line", "c_descripcion", "c_referencia", "c_retiro", bk.empty_amounts(F.col("c_saldo"), True).alias("v"))
    got = {r.line: r for r in cells.collect()}
    assert [(got[i].c_descripcion, got[i].c_referencia, got[i].c_retiro) for i in range(5)] == [("view", "REF7", "63.45")] * 5
    assert [got[i].v for i in range(5)] == [Decimal(x) for x in ("-10.15", "10.15", "-10.15", "-10.15", "10.15")]
