"""Learned formats as a keyed table: T1-T7.

A template row is keyed by (tenant_id, huella); tenants never see each other because the
tenant is part of every join key. The stored table is a log of batches: a batch is seen once its manifest
is written, and readers take of each key the highest version, of equal versions the one published first. So
two writers at once lose nothing, and nobody waits for a lock.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["tenant_id", "huella"]
RE_TENANT = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
RE_FINGERPRINT = r"^[A-Za-z0-9_-]{1,64}$"
TEMPLATE = ("tenant_id string, huella string, tipo string, estrategia string, mapeo map<string,int>, forma string, verificado_por string, "
            "orientacion_verificada boolean, filas_afectadas long, "
            "esquema struct<separador:string,anchos:array<int>,marca_ini:int,marca_fin:int,largo:int>, "
            "reglas struct<tolerancia:string,subconjunto_totales:string,exige_partida_doble:boolean>, "
            "cobertura struct<cuadran:bigint,fallan:bigint,no_verificables:bigint>, "
            "pendiente boolean, confirmada_por string, confirmada_en string, version int, separador_continuacion string")


def valid_tenant(c: Column) -> Column:
    """F27."""
    return c.rlike(RE_TENANT)


def valid_fingerprint(c: Column) -> Column:
    """F27."""
    return c.rlike(RE_FINGERPRINT)


def split_valid(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """usable rows and the quarantine."""
    ok = valid_tenant(F.col("tenant_id")) & valid_fingerprint(F.col("huella"))
    return keys.filter(ok), keys.filter(~F.coalesce(ok, F.lit(False)))


def shaped(rows: DataFrame) -> DataFrame:
    """``rows`` with exactly the columns and types of a template, a ``doc_id`` kept before them."""
    schema = SparkSession.active().createDataFrame([], TEMPLATE).schema
    return rows.select(*[k for k in rows.columns if k == "doc_id"], *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def build(readings: DataFrame, schemes: DataFrame, rules: DataFrame, cover: DataFrame) -> DataFrame:
    """One template row per document that was read, with ``doc_id`` before it.

    ``readings``: doc_id, the key, tipo, estrategia, mapeo (map), forma, verificado_por, orientacion_verificada,
    filas_afectadas. ``schemes``: A1. ``rules``: doc_id and the three parameters. ``cover``: V23. Statements always
    stay pending: geometry cannot tell the continuation separator.
    """
    f = F.col
    j = readings.join(schemes.withColumn("esquema", F.struct("separador", "anchos", "marca_ini", "marca_fin", "largo"))
                      .select("doc_id", "esquema"), "doc_id", "left") \
        .join(rules.withColumn("reglas", F.struct("tolerancia", "subconjunto_totales", "exige_partida_doble")).select("doc_id", "reglas"), "doc_id", "left") \
        .join(cover.withColumn("cobertura", F.struct("cuadran", "fallan", "no_verificables")).select("doc_id", "cobertura"), "doc_id")
    pending = (f("tipo") == "estado_cuenta") | ~F.coalesce("orientacion_verificada", F.lit(False))
    return shaped(j.withColumns({
        "pendiente": pending, "confirmada_por": F.lit(""), "confirmada_en": F.lit(""), "version": F.lit(1), "separador_continuacion": F.lit("")}))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TEMPLATE)


def fresh(store: DataFrame, built: DataFrame) -> DataFrame:
    """The templates to add: new valid keys, only from documents where no rule failed; the first document wins."""
    usable, _ = split_valid(built.filter("cobertura.fallan = 0"))
    new = usable.join(store.select(*KEY), KEY, "left_anti")
    cols = [c for c in new.columns if c not in (*KEY, "doc_id")]
    return shaped(new.groupBy(*KEY).agg(F.min_by(F.struct(*cols), "doc_id").alias("t")).select(*KEY, "t.*"))


def learn(store: DataFrame, built: DataFrame) -> DataFrame:
    """The store with what is new in ``built``."""
    return shaped(store).unionByName(fresh(store, built))


def lookup(readings: DataFrame, store: DataFrame) -> DataFrame:
    """T3."""
    t = store.select(*KEY, F.lit(True).alias("_hit"), F.col("pendiente").alias("t_pendiente"))
    return readings.join(t, KEY, "left").select(
        "doc_id", *KEY, F.coalesce("_hit", F.lit(False)).alias("reutilizada"), "t_pendiente")


def of_tenant(store: DataFrame, tenant: str) -> DataFrame:
    """T4."""
    return store.filter(F.col("tenant_id") == tenant).orderBy("huella")


def confirm(store: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T5: the updated store, and the confirmations whose key is unknown. A confirmed template is a new version of it."""
    c = confirmations.groupBy(*KEY).agg(F.min(F.struct("cuando", "por")).alias("_c"))
    hit = F.col("_c").isNotNull()
    new = store.join(c, KEY, "left").withColumns({
        "pendiente": F.col("pendiente") & ~hit,
        "confirmada_por": F.coalesce("_c.por", "confirmada_por"), "confirmada_en": F.coalesce("_c.cuando", "confirmada_en"),
        "version": F.col("version") + hit.cast("int")})
    return shaped(new), confirmations.join(store.select(*KEY), KEY, "left_anti")


def pending_questions(store: DataFrame) -> DataFrame:
    """What a person still has to confirm, on what it rests and what depends on it."""
    f = F.col
    bank = f("tipo") == "estado_cuenta"
    return store.filter("pendiente").select(
        *KEY,
        F.when(bank, "separador de continuacion").otherwise("orientacion debe/haber").alias("campo"),
        F.when(~bank, F.try_element_at("mapeo", F.lit("debe"))).alias("propone_debe"),
        F.when(~bank, F.try_element_at("mapeo", F.lit("haber"))).alias("propone_haber"),
        F.when(bank, "nada: la geometria no distingue el separador")
        .otherwise(f("verificado_por")).alias("se_apoya_en"),
        F.when(bank, "no afecta ningun importe, saldo ni checksum").otherwise(F.format_string(
            "invertirla cambia la naturaleza de %d filas", "filas_afectadas")).alias("consecuencia"))


def apply(readings: DataFrame, store: DataFrame) -> DataFrame:
    """Mapping, form, strategy and rules of a known template replace what the document proposed."""
    own = ("estrategia", "forma", "mapeo", "reglas")
    t = store.select(*KEY, *[F.col(k).alias(f"t_{k}") for k in own])
    j = readings.join(t, KEY, "left")
    return j.select("doc_id", *KEY, *[F.coalesce(f"t_{k}", k).alias(k) if k in readings.columns else F.col(f"t_{k}").alias(k) for k in own],
                    F.col("t_estrategia").isNotNull().alias("reutilizada"))


# ---------------------------------------------------------------------------- the stored table
def append(spark: SparkSession, folder: str, rows: DataFrame) -> str:
    """Publish new or newer template rows as one batch; a run that dies before its manifest leaves no trace for readers."""
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    shaped(rows).drop("doc_id").write.parquet(f"{folder}/rows/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{folder}/batches")
    return batch


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The templates of all published batches: of a key its highest version, then the batch published first."""
    done = spark.read.schema("batch string").parquet(f"{folder}/batches")
    rows = spark.read.schema(f"{TEMPLATE}, batch string").parquet(f"{folder}/rows").join(done.distinct(), "batch", "left_semi")
    cols = [f for f in rows.columns if f not in (*KEY, "batch")]
    one = rows.groupBy(*KEY).agg(F.min_by(F.struct(*cols), F.struct(-F.col("version"), "batch")).alias("t"))
    return one.select(*KEY, "t.*")
