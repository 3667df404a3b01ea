"""Labels are named beside the vocabulary: no exchange carries their spellings."""

from pyspark.sql import functions as F

from cotejo.functions.text import RE_MAYBE_LETTER, field_by_priority, normalize


def test_labels_stay_where_they_are(spark):
    vocab = spark.createDataFrame([(0, "saldo", "saldo"), (1, "fecha", "fecha"), (1, "fecha", "f echa")], "prioridad int, campo string, sinonimo string")
    labels = spark.range(20_000).select("id", F.when(F.col("id") % 1000 == 0, "Fecha del SALDO").when(
        F.col("id") % 1000 == 1, "f e c h a").otherwise(F.col("id").cast("string")).alias("etiqueta"))
    named = field_by_priority(labels, vocab)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_n" not in plan and "SortMergeJoin" not in plan
    got = {r.id: r.campo for r in named.collect()}
    assert got == {i: ("saldo" if i % 1000 == 0 else "fecha") for i in range(20_000) if i % 1000 < 2}


def test_labels_without_letters_are_not_read_further(spark):
    """Only where every synonym has a letter; and no character that the sieve holds back becomes one."""
    vocab = spark.createDataFrame([(0, "saldo", "saldo"), (1, "dia", "d1")], "prioridad int, campo string, sinonimo string")
    labels = spark.createDataFrame([(1, "1,234.50"), (2, "SÁLDO"), (3, "d 1"), (4, "7 7"), (5, ""), (6, None), (7, "-")], "id int, etiqueta string")
    named = field_by_priority(labels, vocab)
    lines = named._jdf.queryExecution().optimizedPlan().toString().split("\n")
    sieve = [k for k, line in enumerate(lines) if "RLIKE(etiqueta" in line.replace("`", "") and "_letras" in line]
    normal = [k for k, line in enumerate(lines) if "Generate explode" in line]
    assert sieve and normal and normal[0] < sieve[0]  # the sieve lies below, so it is first
    assert {r.id: r.campo for r in named.collect()} == {2: "saldo", 3: "dia"}
    digits = vocab.unionByName(spark.createDataFrame([(2, "clave", "77")], vocab.schema))
    assert {r.id: r.campo for r in field_by_priority(labels, digits).collect()} == {2: "saldo", 3: "dia", 4: "clave"}
    chars = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("ch"))
    assert chars.filter(~F.col("ch").rlike(RE_MAYBE_LETTER) & normalize(F.col("ch")).rlike(r"\p{L}")).isEmpty()
