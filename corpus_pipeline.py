"""The corpus pipeline: documents in, clean deduplicated tokenised documents out.

Stages, each on all that its predecessor kept: toxic documents go, low quality documents go,
one document of each near-duplicate group stays, documents that hold benchmark items go, and
what is left is cut into pieces. Every stage but the last returns the columns it was given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cotejo.llm import bag_minhash, ordinal_quality, templates, toxicity_mil, unigram_pieces
from cotejo.llm.common import table
from cotejo.session import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_mil.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity_mil.without_toxic(docs, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal_quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.select_quality(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bag_minhash.keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram_pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", pieces),
]

#: Trained classifiers and Viterbi segmentation have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; each stage's rows are written to shared storage and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
