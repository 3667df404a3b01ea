"""Output tables: S7-S12. Each sink is a set of DataFrames, published together.

Tables are written as Parquet, clustered by ``doc_id``: a range of documents per file keeps
the number of files independent of the number of documents, and readers prune by statistics.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.scan import first_names
from cotejo.operators.shape import flat, journal_heads, ledger_heads

TRIAL_COLUMNS = ["doc_id", "seq", "cuenta", "nivel", "cuenta_padre", "naturaleza", "nombre",
                 "saldo_ini_deudor", "saldo_ini_acreedor", "debe", "haber", "saldo_fin_deudor",
                 "saldo_fin_acreedor", "es_acumulativa"]
SUBLEDGER_COLUMNS = ["doc_id", "seq", "cuenta", "nombre_cuenta", "saldo_inicial_cuenta", "folio",
                     "fecha", "tipo_movimiento", "documento", "tercero", "concepto", "debe", "haber",
                     "saldo", "saldo_origen", "es_subtotal", "pagina"]


def trial_table(b: DataFrame, disc: DataFrame) -> DataFrame:
    """The rows plus a mark on each one a discrepancy names by index."""
    hit = disc.filter("indice >= 0").select("doc_id", F.col("indice").alias("seq")).distinct()
    j = b.join(hit.withColumn("_m", F.lit(True)), ["doc_id", "seq"], "left")
    return j.select(*TRIAL_COLUMNS, F.coalesce("_m", F.lit(False)).alias("marcada"))


#: Columns of a header that its flat table repeats on every detail row: both figures of each total.
JOURNAL_HEAD = ["tipo", "naturaleza", "fecha", "descripcion", "folio", "total_debe_declarado", "total_debe_leido",
                "total_haber_declarado", "total_haber_leido", "completa"]
LEDGER_HEAD = ["nombre_cuenta", "naturaleza", "saldo_inicial", "saldo_final", "total_cargos_declarado", "total_cargos_leido",
               "total_abonos_declarado", "total_abonos_leido"]
BANK_HEAD = ["banco", "rfc", "periodo_ini", "periodo_fin", "clabe", "producto", "moneda", "saldo_inicial", "depositos_declarado",
             "leido_depositos", "retiros_declarado", "leido_retiros", "saldo_corte"]


def journal_flat(moves: DataFrame, heads: DataFrame) -> DataFrame:
    """O3: moves under the header of their entry, declared and read totals included."""
    return flat(moves, heads, ["doc_id", "poliza_id"], JOURNAL_HEAD)


def ledger_flat(months: DataFrame, heads: DataFrame) -> DataFrame:
    """O3: months under the header of their account, declared and read totals included."""
    return flat(months, heads, ["doc_id", "cuenta"], LEDGER_HEAD)


def journal_tables(entries: DataFrame, moves: DataFrame, cfdi: DataFrame, totals: DataFrame,
                   validation: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Headers, moves, invoices, the flat table and what was validated."""
    heads = journal_heads(entries, totals)
    return {"polizas": heads, "movimientos": moves, "cfdi": cfdi, "plana": journal_flat(moves, heads), **validation}


def ledger_tables(heads: DataFrame, months: DataFrame, totals: DataFrame, validation: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Accounts, months, the flat table and what was validated."""
    accounts = ledger_heads(heads, totals)
    return {"cuentas": accounts, "meses": months, "plana": ledger_flat(months, accounts), **validation}


def bank_accounts_table(accounts: DataFrame, meta: DataFrame, totals: DataFrame) -> DataFrame:
    """S10, accounts: document metadata repeated, declared beside read totals."""
    return (accounts.join(totals, ["doc_id", "num_cuenta"], "left").join(meta, "doc_id", "left")
            .select("doc_id", "seq", "banco", "rfc", "periodo_ini", "periodo_fin", "num_cuenta",
                    "clabe", "producto", "moneda", "saldo_inicial",
                    F.col("depositos").alias("depositos_declarado"), "leido_depositos",
                    F.col("retiros").alias("retiros_declarado"), "leido_retiros", "saldo_corte"))


def bank_tables(meta: DataFrame, accounts: DataFrame, moves: DataFrame, totals: DataFrame,
                validation: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Accounts, moves, the flat table and what was validated."""
    table = bank_accounts_table(accounts, meta, totals)
    # A number shared by several accounts identifies none of them.
    alone = accounts.groupBy("doc_id", "num_cuenta").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    own = table.join(alone, ["doc_id", "num_cuenta"], "left_semi")
    moves_only = moves.drop(*[c for c in BANK_HEAD if c in moves.columns])
    return {"cuentas": table, "movimientos": moves, "plana": flat(moves_only, own, ["doc_id", "num_cuenta"], BANK_HEAD), **validation}


def validation_tables(results: DataFrame, tolerated: DataFrame, disc: DataFrame) -> dict[str, DataFrame]:
    """The two tables that say what was checked, with its denominator, and every difference."""
    return {"validacion": validation_rules(results, tolerated), "discrepancias": validation_discrepancies(disc)}


def subledger_table(aux: DataFrame) -> DataFrame:
    """S11."""
    return aux.select(*SUBLEDGER_COLUMNS)


def validation_rules(results: DataFrame, tolerated: DataFrame) -> DataFrame:
    """Rule, state, applicable, evaluated, exact, detail and reason."""
    f = F.col
    names = first_names(tolerated.withColumn("k", F.concat_ws("#", "doc_id", "n_regla")), "k", "fila",
                        ["indice", "fila", "subregla"])
    j = results.withColumn("k", F.concat_ws("#", "doc_id", "n_regla")).join(names, "k", "left")
    detail = F.concat_ws(
        "; ",
        F.when(f("exactas") > 0, F.concat(f("exactas").cast("string"), F.lit(" exacta"),
                                          F.when(f("exactas") != 1, "s").otherwise(""))),
        F.when(f("con_tolerancia") > 0, F.format_string(
            "%d dentro de tolerancia: %s", "con_tolerancia", "nombres")),
        F.when(f("discrepancias") > 0, F.format_string("%d con diferencia", "discrepancias")))
    return j.select("doc_id", "n_regla", "regla", "estado", "aplicables", "evaluados", "exactas",
                    F.when(detail == "", "sin comprobaciones").otherwise(detail).alias("detalle"), "motivo")


def validation_discrepancies(disc: DataFrame) -> DataFrame:
    """Null amounts stay null, never zero."""
    return disc.select("doc_id", "n_regla", "fila", F.col("subregla").alias("regla"),
                       "esperado", "obtenido")


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> list[str]:
    """Write each table under ``folder``, ranged by document and, inside it, by entry or row."""
    paths = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        inside = [c for c in ("poliza_id", "seq") if c in df.columns]
        df.repartitionByRange("doc_id", *inside).write.mode(
            mode).parquet(path)
        paths.append(path)
    return paths


# ------------------------------------------------------------- several tables published as one
MANIFEST = "version string, tabla string, filas long, hecho timestamp"


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> str:
    """Write the tables as a new version of ``folder``; readers see all of them or none.

    Every version has its own place. Its manifest is one file, added last, so a run that dies leaves
    no trace for readers, and an older version stays readable until it is cleared away.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_tables(tables, f"{folder}/{version}")
    rows = [(version, name, spark.read.parquet(f"{folder}/{version}/{name}").count()) for name in tables]
    spark.createDataFrame(rows, "version string, tabla string, filas long").withColumn("hecho", F.current_timestamp()) \
        .coalesce(1).write.mode("append").parquet(f"{folder}/_manifest")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """What was published, one row per version and table; the latest version is the greatest."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def published(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the latest published version, or of a given one."""
    if version is None:
        version = versions(spark, folder).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")
