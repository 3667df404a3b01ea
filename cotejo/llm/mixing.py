"""Mixing sources to target weights: random order inside a source, cut at the source's exact budget.

Every document gets a hash-random key. Documents are range-sorted by source and key, prefix sums
of their words run over all tasks, and a source takes whole passes (epochs) over its documents and
of one more pass just the words up to its budget: the document at the cut gives its first words.

Budgets: the weights repeat over the sources by code point, null last, and share ``share`` times
all words. A target stops at ``most`` times its source's words; what is above is shared
again by weight until nothing is above. That is solved in one go: in the order of the ratio of stop
and weight, the sources before some place stop and the rest shares what they leave.

Defined results: a null text has no words; a null source is a source of its own, the last one;
repeated rows and null ids are rows like any other (rows that tie in key, id, size and text change
places without effect); a source without words has target 0; an empty table gives no rows; columns
besides ``doc_id``, ``source`` and ``text`` do not matter, whatever their names. Texts of any length
are counted whole. The same table gives the same words again. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import whole_text
from cotejo.llm.ranges import prefix_sums
from cotejo.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
KEYS = ["_last", "_name"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary")), 1, 16)


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``KEYS``, ``source_size`` and ``target`` of every source, from ``KEYS`` and ``source_size``."""
    ranked = prefix_sums(sources.withColumn("_one", F.lit(1).cast("long")), [], KEYS, {"_place": "_one"})
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)),
                          (F.col("_place") % len(weights)).cast("int") + 1)
    weighed = ranked.withColumn("_weight", weight).withColumn("_stop", most * F.col("source_size")) \
        .withColumn("_ratio", F.col("_stop") / F.col("_weight"))
    before = stage(prefix_sums(weighed, [], ["_ratio", *KEYS], {"_stopped": "_stop", "_used": "_weight"}))
    total = before.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    words, all_weights = total.words or 0, total.weight or 0
    rest = (F.lit(float(share)) * F.lit(words) - F.col("_stopped"), F.lit(all_weights) - F.col("_used"))
    # the first place from which on nobody is above its stop
    fits = before.where(rest[0] / rest[1] <= F.col("_ratio")) \
        .agg(F.min(F.struct("_ratio", *KEYS, rest[0].alias("left"), rest[1].alias("weight"))).alias("f")).first().f
    shared = F.col("_weight") * F.lit(fits.left) / F.lit(fits.weight) if fits else F.col("_stop")
    return before.select(*KEYS, "source_size", F.least(F.col("_stop").cast("double"), shared.cast("double")).alias("target"))


def taken_words(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
                seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every row, with the columns of ``keep``."""
    text = whole_text("text")
    rows = stage(docs.select(
        *keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"), random_key(F.col("doc_id"), seed).alias("_key"), F.xxhash64(text).alias("_tie"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("source").isNull().cast("int").alias("_last"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name")))
    targets = stage(source_targets(stage(rows.groupBy(*KEYS).agg(F.sum("size").alias("source_size"))), weights, share, most))
    placed = prefix_sums(rows, KEYS, ["_key", "doc_id", "size", "_tie", "_row"], {"_before": "size"}, targets)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.select(*keep, "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, one for each epoch (column ``epoch``, from 0) that takes words of them.

    A document at a cut holds its first words, joined by single spaces; all others hold the whole text.
    """
    held = stage(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    taken = taken_words(held, weights, share, most, seed, ["_mix_row"]).where("taken > 0") \
        .select("_mix_row", F.col("taken").alias("_mix_taken"), F.col("size").alias("_mix_size"))
    passes = F.sequence(F.lit(0), F.ceil(F.col("_mix_taken") / F.col("_mix_size")).cast("int") - 1)
    rows = held.join(taken, "_mix_row").withColumn("epoch", F.explode(passes))
    left = F.col("_mix_taken") - F.col("epoch") * F.col("_mix_size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return rows.withColumn("text", F.when(left >= F.col("_mix_size"), F.col("text")).otherwise(first)) \
        .drop("_mix_row", "_mix_taken", "_mix_size")
