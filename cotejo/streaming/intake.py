"""Continuous intake of documents of every kind: I1-I3.

A document arrives in any number of parts, in any files and batches. Each row says which document and part it belongs
to, how many parts there are, and carries one record of a typed table as JSON. Keyed streaming state remembers, per
document, which parts were seen and in which files, never the rows. When the last part is there, the document is
read back from its files and judged whole by the rules of its kind; one that stays incomplete past its time,
says different things about its parts, or holds a record that cannot be read ends in ``error``. The final states of
a batch are written under its id, so a replayed batch rewrites the same folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from cotejo.operators.suites import suite_results
from cotejo.operators.verdict import Rule, coverage
from cotejo.session import stage

# Fixed state names.
QUEUED, WORKING, READY = "en_cola", "procesando", "listo"
WITH_GAPS, UNKNOWN_KIND, ERROR = "con_discrepancias", "no_reconocido", "error"

INBOX = "tipo string, doc_id long, parte int, partes int, tabla string, cuerpo string, hora timestamp"
SEEN = "tipo string, doc_id long, parte int, partes int, archivo string, llegada timestamp"
STATE = "partes int, vistas array<int>, archivos array<string>, chocan boolean"
ARRIVED = "tipo string, doc_id long, fin string, mensaje string, archivos array<string>"
WHOLE, INCOMPLETE = "completo", "incompleto"
_CORRUPT = StructField("_corrupt_record", StringType())
#: A kind: the schema of each of its tables, the table without which a document is none of the kind, and its rules.
Kind = tuple[Mapping[str, StructType], str, Callable[[Mapping[str, DataFrame]], list[Rule]]]


def as_inbox(kind: str, tables: Mapping[str, DataFrame], part: Column | None = None, parts: int = 1) -> DataFrame:
    """``INBOX`` rows of typed tables; ``part`` numbers the part of a row from 0."""
    every = None
    for name, df in tables.items():
        rows = df.select(F.lit(kind).alias("tipo"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(name).alias("tabla"),
                         F.to_json(F.struct("*")).alias("cuerpo"))
        every = rows if every is None else every.unionByName(rows)
    number = F.pmod(F.xxhash64("cuerpo"), F.lit(parts)).cast("int") if part is None else part
    return every.select("tipo", "doc_id", number.alias("parte"), F.lit(parts).cast("int").alias("partes"), "tabla", "cuerpo",
                        F.lit(None).cast("timestamp").alias("hora"))


def parts_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which parts a stretch of rows holds: a few rows for each stretch, so a large document stays cheap to follow."""
    for b in batches:
        table = pa.Table.from_batches([b]).group_by(["tipo", "doc_id", "parte", "partes", "archivo", "llegada"]).aggregate([])
        yield from table.combine_chunks().to_batches()


def follow(key: tuple, events: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    """One document: remember parts; report it when whole, or when what arrives is ``wait_ms`` past its last part."""
    tipo, doc = key
    if pd.isna(tipo):
        return
    if state.hasTimedOut:
        parts, seen, files, clash = state.get
        state.remove()
        yield pd.DataFrame([(tipo, doc, INCOMPLETE, f"llegaron {len(seen)} de {parts} partes", files)], columns=["tipo", "doc_id", "fin", "mensaje", "archivos"])
        return
    parts, seen, files, clash = state.get if state.exists else (None, [], [], False)
    seen, files, last = set(seen), set(files), state.getCurrentWatermarkMs()
    for e in events:
        last = max(last, int(e.llegada.max().timestamp() * 1000))
        for part, of, file in zip(e.parte, e.partes, e.archivo):
            clash = clash or parts not in (None, int(of)) or not 0 <= part < of
            parts = int(of) if parts is None else parts
            seen.add(int(part))
            files.add(file)
    if clash or len(seen) >= parts:
        if state.exists:
            state.remove()
        end, message = (INCOMPLETE, "las partes se contradicen") if clash else (WHOLE, "")
        yield pd.DataFrame([(tipo, doc, end, message, sorted(files))], columns=["tipo", "doc_id", "fin", "mensaje", "archivos"])
    else:
        state.update((parts, sorted(seen), sorted(files), bool(clash)))
        state.setTimeoutTimestamp(last + wait_ms)


def parsed(rows: DataFrame, schema: StructType) -> DataFrame:
    """The records of one table, and whether each could be read and is of the document ``_de`` that it came with (``_ok``)."""
    read = F.from_json("cuerpo", StructType([*schema.fields, _CORRUPT]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT.name})
    r = rows.select(F.col("doc_id").alias("_de"), read.alias("r"))
    ok = F.col("r").isNotNull() & F.col(f"r.{_CORRUPT.name}").isNull() & F.col("r.doc_id").eqNullSafe(F.col("_de"))
    return r.select("_de", ok.alias("_ok"), *[F.col("r")[f].alias(f) for f in schema.names])


def judged(arrived: DataFrame, rows: DataFrame, kinds: Mapping[str, Kind]) -> DataFrame:
    """The final state of every document of ``arrived``, from the rows of the whole ones."""
    whole = arrived.filter(F.col("fin") == WHOLE).select("tipo", "doc_id")
    mine = rows.join(whole, ["tipo", "doc_id"], "left_semi")
    states = []
    for kind, (schemas, main, rules) in kinds.items():
        own = mine.filter(F.col("tipo") == kind)
        tables = {n: stage(parsed(own.filter(F.col("tabla") == n), schema)) for n, schema in schemas.items()}
        broken = own.filter(~F.coalesce(F.col("tabla").isin(*schemas), F.lit(False))).select("doc_id")
        for df in tables.values():
            broken = broken.union(df.filter("NOT _ok").select("_de"))
        broken = stage(broken.distinct())
        sound = {n: df.filter("_ok").drop("_de", "_ok").join(broken, "doc_id", "left_anti") for n, df in tables.items()}
        cover = coverage(suite_results(rules(sound)))
        has = sound[main].select("doc_id").distinct().withColumn("_hay", F.lit(True))
        docs = whole.filter(F.col("tipo") == kind).select("doc_id")
        j = docs.join(broken.withColumn("_roto", F.lit(True)), "doc_id", "left").join(has, "doc_id", "left").join(cover, "doc_id", "left")
        states.append(j.select(
            F.lit(kind).alias("tipo"), "doc_id", F.when(F.col("_roto"), ERROR).when(F.col("_hay").isNull(), UNKNOWN_KIND)
            .when(F.col("fallan") > 0, WITH_GAPS).otherwise(READY).alias("estado"),
            F.when(F.col("_roto"), "un registro no se pudo leer").when(F.col("_hay").isNull(), "").otherwise(F.coalesce("resumen", F.lit(""))).alias("resumen")))
    failed = arrived.filter(F.col("fin") != WHOLE).select("tipo", "doc_id", F.lit(ERROR).alias("estado"), F.col("mensaje").alias("resumen"))
    other = whole.filter(~F.col("tipo").isin(*kinds)).select("tipo", "doc_id", F.lit(UNKNOWN_KIND).alias("estado"), F.lit("").alias("resumen"))
    out = failed.unionByName(other)
    for s in states:
        out = out.unionByName(s)
    return out



def run_intake(spark: SparkSession, inbox: str, kinds: Mapping[str, Kind], out: str, checkpoint: str,
               wait_ms: int = 30 * 60 * 1000, files: int = 64) -> None:
    """Judge every document that became whole since the last run, then stop (available-now trigger).

    A run takes ``files`` files a batch; state and files taken are in ``checkpoint``. Time is the ``hora`` of a row or else its file's time: a
    document ends in ``error`` once a row is ``wait_ms`` later than its last part. A row without a kind only moves time on.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        arrived = stage(batch)
        named = [r.f for r in arrived.filter(F.col("fin") == WHOLE).select(F.explode("archivos").alias("f")).distinct().collect()]
        if named:
            rows = spark.read.schema(INBOX).parquet(*named)
        elif arrived.isEmpty():
            return
        else:
            rows = spark.createDataFrame([], INBOX)
        judged(arrived, rows, kinds).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(INBOX).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(inbox)
    seen = stream.select("tipo", "doc_id", "parte", "partes", F.col("_metadata.file_path").alias("archivo"),
                         F.coalesce("hora", "_metadata.file_modification_time").alias("llegada")).mapInArrow(parts_seen, SEEN).withWatermark("llegada", "0 seconds")
    arrived = seen.groupBy("tipo", "doc_id").applyInPandasWithState(
        lambda key, events, state: follow(key, events, state, wait_ms), ARRIVED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    query = (arrived.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def job_log(spark: SparkSession, out: str) -> DataFrame:
    """One row per document; a document sent again counts by its latest batch."""
    log = spark.read.parquet(out)
    return log.groupBy("tipo", "doc_id").agg(F.max_by("estado", "batch").alias("estado"),
                                             F.max_by("resumen", "batch").alias("resumen"))


def expired(jobs: DataFrame, outputs: DataFrame, now: DataFrame, minutes: int = 30) -> DataFrame:
    """Jobs past their age unless in process, and old outputs whose job is gone.

    ``now`` is a one-row table with column ``ahora``.
    """
    f = F.col
    limit = f("ahora") - F.expr(f"INTERVAL {minutes} MINUTES")
    one = F.broadcast(now.agg(F.max("ahora").alias("ahora")))
    old = jobs.join(one, f("creado") < limit).filter(f("estado") != WORKING)
    gone = outputs.join(jobs.select("id"), "id", "left_anti").join(one, f("creado") < limit)
    return (old.select("id", "tenant", F.lit("trabajo").alias("que"))
            .unionByName(gone.select("id", "tenant", F.lit("salida").alias("que"))))


def newest(jobs: DataFrame, k: int = 50) -> DataFrame:
    """The newest jobs of every tenant; the rank is limited before the shuffle."""
    w = Window.partitionBy("tenant").orderBy(F.col("creado").desc(), "id")
    return jobs.withColumn("lugar", F.row_number().over(w)).filter(F.col("lugar") <= k)


def place_in_line(jobs: DataFrame) -> DataFrame:
    """How many queued jobs were created before, counting itself; 0 when not waiting.

    A global rank would sort the queue in one task. Jobs are counted per minute first, the
    running count goes over minutes, and the rank inside a minute is a bounded window.
    """
    f = F.col
    minute = F.floor(F.unix_micros(F.col("creado").cast("timestamp")) / 60_000_000)
    q = jobs.filter(f("estado") == QUEUED).select("id", "creado", minute.alias("m"))
    per = q.groupBy("m").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.floor(f("m") / 1440))
    # One row per day of queue: the only unpartitioned window, over a few thousand rows.
    day = per.groupBy("h").agg(F.sum("n").alias("nd"))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    day = day.withColumn("antes_dia", F.coalesce(
        F.sum("nd").over(prior(Window.orderBy("h"))), F.lit(0))).drop("nd")
    per = per.withColumn("antes_min", F.coalesce(
        F.sum("n").over(prior(Window.partitionBy("h").orderBy("m"))), F.lit(0))).join(day, "h")
    inside = F.rank().over(Window.partitionBy("m").orderBy("creado"))
    ranked = q.withColumn("r", inside).join(per, "m").select(
        "id", (f("antes_dia") + f("antes_min") + f("r")).alias("posicion"))
    return jobs.select("id", "tenant", "estado").join(ranked, "id", "left").na.fill(0, ["posicion"])


def job_of_tenant(jobs: DataFrame, job_id: int, tenant: str) -> DataFrame:
    """The tenant is part of the lookup, so a guessed id of another one finds nothing."""
    return jobs.filter((F.col("id") == job_id) & (F.col("tenant") == tenant))
