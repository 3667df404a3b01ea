"""A bounded sample of labelled documents, and one task that fits a model on its features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import whole_text
from cotejo.session import stage


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int,
                    among: Column | None = None) -> DataFrame:
    """At most ``most`` labelled ids, the first by a hash of the id, joined to their whole texts.

    The sampled ids are bounded by ``most``, so they are broadcast to the documents.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")) \
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
    if among is not None:
        rows = rows.where(among)
    place = F.xxhash64(F.col("doc_id"), F.lit(17))
    kept = stage(rows.distinct().orderBy(place, "doc_id", "label").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return texts.join(F.broadcast(kept), "doc_id")


def fit_in_one_task(features: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """Fit on the features of a bounded sample in one executor task; the model comes back as bytes.

    The rows come in any order; ``fit`` puts them in order where the order matters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            yield pa.RecordBatch.from_pydict({"model": pa.array([fit(table)], pa.binary())})

    rows = stage(features).repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(rows[0].model) if rows else b""
