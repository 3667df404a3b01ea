"""Session helpers shared by the entry points, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "cotejo") -> SparkSession:
    """A session for one machine. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COTEJO_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for stage tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session (tests)
    gets one fresh folder; on a cluster executors do not share local folders, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback[app]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Ordered scans read their input several times. A stage table cuts the lineage, so
    upstream work is done once, later reads prune columns, and a lost executor re-reads
    files instead of recomputing the chain.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """A stage table that stays dealt out by ``keys``: what groups, sorts or joins it by them later moves no row of it again."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def stage_like(df: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """A stage table dealt out as ``of`` is, which ``stage_by`` has dealt out by ``keys``; rows that are where theirs are do not move."""
    return stage_by(df, keys, of.groupBy(*keys).count().rdd.getNumPartitions())


def join_grown(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` of two tables that both grow with the corpus; neither is sent to the driver.

    Left alone, Spark judges a stage table by its compressed files: ten MB of them, which it broadcasts, may be
    hundreds of MB of rows, first in the driver and then in every executor.
    """
    return left.join(right.hint("merge"), on, how)
