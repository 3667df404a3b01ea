"""Data-quality diagnostics over the typed tables: D1-D12, D14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.operators.verdict import CUADRA, MONEY, money

ENTRY = ["doc_id", "poliza_id"]


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def orphan_subtotals(aux: DataFrame) -> DataFrame:
    """Subtotals of accounts without moves, summary/detail by zero/non-zero."""
    f = F.col
    moves = aux.filter(~f("es_subtotal")).select("doc_id", "cuenta").distinct()
    lost = aux.filter("es_subtotal").join(moves, ["doc_id", "cuenta"], "left_anti")
    size = F.abs(F.coalesce("debe", _zero())) + F.abs(F.coalesce("haber", _zero()))
    return lost.groupBy(
        "doc_id", f("cuenta").rlike("-0+$").alias("acumulativa"), (size != 0).alias("con_importe"),
    ).agg(F.count(F.lit(1)).alias("subtotales"), money(F.sum(size)).alias("importe"))


def _declared_read(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Declared totals (the read ones where absent) beside the read sums."""
    j = entries.join(totals, ENTRY, "left")
    for s in ("debe", "haber"):
        read = F.coalesce(f"leido_{s}", _zero())
        j = (j.withColumn(f"l_{s}", read)
             .withColumn(f"d_{s}", F.coalesce(f"total_{s}", f"l_{s}")))
    return j


def declared_vs_read(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """D2."""
    f = F.col
    j = _declared_read(entries, totals)
    diff = (f("d_debe") != f("l_debe")) | (f("d_haber") != f("l_haber"))
    return j.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("polizas"), F.count_if(diff).alias("difieren"),
        F.count_if(diff & (f("d_debe") > f("l_debe"))).alias("corto"),
        F.count_if(diff & (f("d_debe") <= f("l_debe"))).alias("exceso"),
        money(F.sum(F.when(diff, f("d_debe") - f("l_debe")).otherwise(_zero()))).alias("falta_debe"),
        money(F.coalesce(F.sum("total_debe"), _zero())).alias("declarado_debe"),
        money(F.coalesce(F.sum("total_haber"), _zero())).alias("declarado_haber"),
        money(F.sum("l_debe")).alias("leido_debe"), money(F.sum("l_haber")).alias("leido_haber"))


def shape_of_loss(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """D3: (debit, credit) each short, over or ok, for the entries that differ."""
    f = F.col

    def side(s: str) -> Column:
        return (F.when(f(f"d_{s}") > f(f"l_{s}"), f"{s} corto")
                .when(f(f"d_{s}") < f(f"l_{s}"), f"{s} sobra").otherwise(f"{s} ok"))

    j = _declared_read(entries, totals).filter("d_debe <> l_debe OR d_haber <> l_haber")
    return j.groupBy("doc_id", side("debe").alias("lado_debe"), side("haber").alias("lado_haber")
                     ).agg(F.count(F.lit(1)).alias("polizas"))


def entry_sizes(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """D3: upper-median and maximum moves per entry, all entries against the differing ones.

    The upper median is read from a histogram of sizes, so no list of entries is built.
    """
    f = F.col
    j = _declared_read(entries, totals).withColumn("n", F.coalesce("n_movs", F.lit(0)))
    j = j.withColumn("falla", (f("d_debe") != f("l_debe")) | (f("d_haber") != f("l_haber")))
    both = j.select("doc_id", "n", F.explode(F.when(f("falla"), F.array(F.lit("todas"), F.lit("fallidas")))
                                              .otherwise(F.array(F.lit("todas")))).alias("grupo"))
    return upper_median(both, ["doc_id", "grupo"], "n").join(
        both.groupBy("doc_id", "grupo").agg(F.count(F.lit(1)).alias("polizas"),
                                            F.max("n").alias("maximo"),
                                            F.count_if(f("n") == 0).alias("vacias")),
        ["doc_id", "grupo"])


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "mediana") -> DataFrame:
    """``sorted(values)[n // 2]`` per key from the histogram of distinct values."""
    f = F.col
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    run = hist.withColumn("_up", F.sum("_c").over(w.orderBy(value))).withColumn(
        "_n", F.sum("_c").over(w))
    return (run.filter(f("_up") > F.expr("_n div 2")).groupBy(*keys)
            .agg(F.min(value).alias(name)))


def two_sided_moves(moves: DataFrame, entries: DataFrame, totals: DataFrame) -> DataFrame:
    """D3: moves with both amounts, and how many of them sit in entries that differ."""
    f = F.col
    bad = (_declared_read(entries, totals).filter("d_debe <> l_debe OR d_haber <> l_haber")
           .select(*ENTRY, F.lit(True).alias("falla")))
    j = moves.join(bad, ENTRY, "left")
    two = (f("debe") != 0) & (f("haber") != 0)
    return j.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("movimientos"), F.count_if(two).alias("con_ambos"),
        F.count_if(two & f("falla").isNotNull()).alias("en_fallidas"))


def hierarchy_universe(b: DataFrame) -> DataFrame:
    """Referenced parents = with children + absent + present without direct children."""
    f = F.col
    named = b.filter("cuenta_padre <> ''").select("doc_id", f("cuenta_padre").alias("cuenta")).distinct()
    rows = b.select("doc_id", "cuenta").distinct()
    absent = named.subtract(rows)
    kids = b.select("doc_id", f("cuenta_padre").alias("cuenta"), (f("nivel") - 1).alias("nivel")).distinct()
    parents = b.join(kids, ["doc_id", "cuenta", "nivel"], "left_semi").select("doc_id", "cuenta")
    barren = named.intersect(rows).subtract(parents)
    tag = lambda d, n: d.select("doc_id", F.lit(n).alias("clase"))
    every = (tag(named, "referidos").unionAll(tag(parents, "con_hijas"))
             .unionAll(tag(absent, "ausentes")).unionAll(tag(barren, "sin_hijas")))
    g = every.groupBy("doc_id").pivot("clase", ["referidos", "con_hijas", "ausentes", "sin_hijas"]
                                      ).count().na.fill(0)
    return g.withColumn("se_explican", f("referidos") - f("con_hijas") == f("ausentes") + f("sin_hijas"))


def rows_with_many(disc: DataFrame) -> DataFrame:
    """Rows named by more than one discrepancy, and by which sub-rules.

    The number of sub-rules is a small constant, so the collected set is bounded.
    """
    return disc.groupBy("doc_id", "fila").agg(
        F.count(F.lit(1)).alias("veces"),
        F.array_join(F.sort_array(F.collect_set("subregla")), ", ").alias("reglas"),
    ).filter("veces > 1")


def entry_sheet(entries: DataFrame, totals: DataFrame, failing: DataFrame) -> DataFrame:
    """Counts per document, and whether the entries that differ are exactly the entries
    that fail ``partida_doble``. ``failing`` carries (doc_id, fila)."""
    f = F.col
    j = entries.join(totals, ENTRY, "left")
    declared = f("total_debe").isNotNull() & f("total_haber").isNotNull()
    diff = declared & ((f("total_debe") != F.coalesce("leido_debe", _zero()))
                       | (f("total_haber") != F.coalesce("leido_haber", _zero())))
    j = j.select("doc_id", f("poliza_id").cast("string").alias("fila"), "completa", declared.alias("dec"),
                 f("n_movs").isNull().alias("vacia"), diff.alias("dif"))
    j = j.join(failing.select("doc_id", "fila", F.lit(True).alias("mal")), ["doc_id", "fila"], "full_outer")
    bad, dif = F.coalesce("mal", F.lit(False)), F.coalesce("dif", F.lit(False))
    g = j.groupBy("doc_id").agg(
        F.count("completa").alias("polizas"), F.count_if(~f("completa")).alias("incompletas"),
        F.count_if(~f("dec")).alias("sin_totales"), F.count_if(f("dec") & f("vacia")).alias("sin_movimientos"),
        F.count_if(dif).alias("difieren"), F.count_if(bad).alias("fallan"),
        F.count_if(bad & dif).alias("en_comun"))
    return g.withColumn("son_las_mismas", (f("difieren") == f("en_comun")) & (f("fallan") == f("en_comun")))


def rules_without_cases(results: DataFrame) -> DataFrame:
    """Rules that evaluated nothing, and how many of them dare to say ``cuadra``."""
    f = F.col
    return results.filter("evaluados = 0").groupBy("regla").agg(
        F.count_distinct("doc_id").alias("documentos"),
        F.count_if(f("estado") == CUADRA).alias("prohibidas"))


def ledger_declared_vs_read(heads: DataFrame, months: DataFrame) -> DataFrame:
    """D8, ledgers: totals and chained final balance, one row per differing field."""
    f = F.col
    sums = months.groupBy("doc_id", "cuenta").agg(F.sum("cargos").alias("c"), F.sum("abonos").alias("a"))
    sign = F.when(f("naturaleza") == "A", F.lit(-1)).otherwise(F.lit(1))
    j = heads.join(sums, ["doc_id", "cuenta"]).withColumn(
        "cadena", f("saldo_inicial") + sign * (f("c") - f("a")))
    rows = j.select("doc_id", "cuenta", F.expr("""stack(3,
        'total_cargos', total_cargos, CAST(c AS DECIMAL(38,2)),
        'total_abonos', total_abonos, CAST(a AS DECIMAL(38,2)),
        'saldo_final', saldo_final, CAST(cadena AS DECIMAL(38,2))) AS (campo, declarado, leido)"""))
    return rows.filter("declarado <> leido")


def bank_declared_vs_read(accounts: DataFrame, moves: DataFrame) -> DataFrame:
    """D8, statements: declared deposits, withdrawals and closing against what was read."""
    sums = moves.groupBy("doc_id", "num_cuenta").agg(
        F.sum("deposito").alias("d"), F.sum("retiro").alias("r"),
        F.max_by("saldo", F.when(F.col("saldo").isNotNull(), F.col("seq"))).alias("ultimo"))
    j = accounts.join(sums, ["doc_id", "num_cuenta"], "left")
    rows = j.select("doc_id", "seq", "num_cuenta", F.expr("""stack(3,
        'depositos', depositos, CAST(COALESCE(d, 0) AS DECIMAL(38,2)),
        'retiros', retiros, CAST(COALESCE(r, 0) AS DECIMAL(38,2)),
        'saldo_corte', saldo_corte, CAST(ultimo AS DECIMAL(38,2))) AS (campo, declarado, leido)"""))
    return rows.groupBy("doc_id", "campo").agg(
        F.count_if(F.col("declarado") != F.col("leido")).alias("difieren"),
        F.count_if(F.col("declarado").isNull() | F.col("leido").isNull()).alias("sin_cifra"))


def month_quality(months: DataFrame, heads: DataFrame) -> DataFrame:
    """Months per account, repeated orders, months with amounts and accumulated."""
    f = F.col
    per = months.groupBy("doc_id", "cuenta").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("orden").alias("k"),
        F.count_if((f("cargos") != 0) | (f("abonos") != 0) | f("saldo").isNotNull()).alias("imp"),
        F.count_if(f("acum_cargos").isNotNull() | f("acum_abonos").isNotNull()).alias("acu"))
    m = per.groupBy("doc_id").agg(
        F.sum("n").alias("meses"), F.max("n").alias("max_por_cuenta"),
        F.sum(f("n") - f("k")).alias("repetidos"), F.sum("imp").alias("con_importe"),
        F.sum("acu").alias("con_acumulado"))
    h = heads.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("cuentas"), F.count("saldo_final").alias("con_saldo_final"),
        F.count_if(f("naturaleza") != "").alias("con_naturaleza"))
    return h.join(m, "doc_id")


def tolerated_vs_chain(heads: DataFrame, months: DataFrame, tolerated: DataFrame) -> DataFrame:
    """Accounts on one side only of (tolerated by saldo_mensual, final differs from chain)."""
    f = F.col
    chain = ledger_declared_vs_read(heads, months).filter("campo = 'saldo_final'").select("doc_id", "cuenta").distinct()
    near = tolerated.select("doc_id", F.split("fila", " ")[0].alias("cuenta")).distinct()
    left = near.subtract(chain).withColumn("lado", F.lit("solo_tolerancia"))
    right = chain.subtract(near).withColumn("lado", F.lit("solo_cadena"))
    return left.unionByName(right).select("doc_id", f("cuenta"), "lado")


def reasons(results: DataFrame, template: Column) -> DataFrame:
    """Distinct reasons of the rules that did not pass, largest group first on display."""
    f = F.col
    rows = results.filter(f("estado") != CUADRA).select(
        "estado", F.when(F.length(template) == 0, "(SIN MOTIVO)").otherwise(template).alias("motivo"),
        "doc_id", "regla", "evaluados", "aplicables")
    return rows.groupBy("estado", "motivo").agg(
        F.count(F.lit(1)).alias("casos"), F.count_distinct("doc_id").alias("documentos"),
        F.sum("evaluados").alias("evaluados"), F.sum("aplicables").alias("aplicables"))


def label_pages(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(document, label, page) where a label occurs; ``arranca`` asks for the line start.

    ``labels`` is a handful of rows; Spark knows their size and chooses how to join.
    """
    f = F.col
    hit = F.when(f("arranca"), f("texto").startswith(f("etiqueta"))).otherwise(
        f("texto").contains(f("etiqueta")))
    return lines.join(labels, hit).select("doc_id", "etiqueta", "page").distinct()
