"""I-Match fingerprints: what is left of a document inside a band of document frequency.

The lexicon holds the terms (runs of letters and digits in lower case) whose share of
documents lies in a band, i.e. whose inverse document frequency lies between two bounds. A
fingerprint hashes the sorted distinct terms of a document that are in the lexicon, and again
inside several random subsets of the lexicon; the likeness of two fingerprints is the share
of these hashes that agree. A document without lexicon terms is hashed over all its terms.

Documents hold ``mean distinct terms`` each, so at most mean / ``low`` terms can reach the
lower bound, however many documents there are. Up to ``in_plan`` terms the lexicon is a set
inside the expression; a larger one is joined.

Defined results: null reads as the empty text; equal texts have equal fingerprints; rows are
ordered by id, then text, nulls first; an empty table gives no rows. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.common import whole_text
from cotejo.session import stage

LOW, HIGH = 0.005, 0.3
SUBSETS = 6
KEEP = 70  # per cent of the lexicon in each random subset
IN_PLAN = 65_536


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms of ``docs`` whose share of documents lies in the band."""
    texts = docs.select(terms(whole_text("text")).alias("terms"))
    counts = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = texts.count()
    return counts.where((F.col("df") >= max(1, math.ceil(low * total))) & (F.col("df") <= high * total)).select("term")


def hashes(inside: Column, every: Column, subsets: int = SUBSETS, keep: int = KEEP) -> Column:
    """The hash over the lexicon and over each random subset of it."""
    own = F.array_sort(F.when(F.size(inside) > 0, inside).otherwise(every))
    parts = [F.xxhash64(own)]
    for s in range(1, subsets + 1):
        parts.append(F.xxhash64(F.filter(own, lambda t, s=s: F.pmod(F.xxhash64(t, F.lit(s)), F.lit(100)) < keep), F.lit(s)))
    return F.array(*parts)


def with_hashes(rows: DataFrame, key: list[str], columns: dict[str, str], words: DataFrame,
                in_plan: int = IN_PLAN) -> DataFrame:
    """``rows`` with hash arrays of its term columns: ``columns`` maps a term column to its hash column.

    ``key`` names columns that tell all rows apart.
    """
    small = words.limit(in_plan + 1).collect()
    if len(small) <= in_plan:
        held = ",".join(f"{r.term}L" if r.term > -(1 << 63) else "(-9223372036854775807L - 1L)" for r in small) or "NULL"
        for c, into in columns.items():
            rows = rows.withColumn(into, hashes(F.expr(f"filter({c}, t -> t IN ({held}))"), F.col(c)))
        return rows
    for c, into in columns.items():
        inside = rows.select(*key, F.explode(c).alias("term")).join(words, "term") \
            .groupBy(*key).agg(F.collect_list("term").alias("_inside"))
        rows = rows.join(inside, key, "left").withColumn(
            into, hashes(F.coalesce("_inside", F.array().cast("array<bigint>")), F.col(c))).drop("_inside")
    return rows


def printed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "-")


def likeness(a: Column, b: Column) -> Column:
    """Share of places in which two hash arrays agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return same / F.size(a)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row of ``docs``."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), terms(whole_text("text")).alias("terms"))
    done = with_hashes(rows, ["row"], {"terms": "hashes"}, lexicon(docs, low, high))
    return done.select("doc_id", printed(F.col("hashes")).alias("fingerprint"))


def in_order(docs: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into buckets of neighbouring ids, and for each bucket the text after its last row.

    About eight buckets for each task; their bounds are percentiles of the ids.
    """
    many = 8 * tasks
    found = docs.agg(F.percentile_approx("doc_id", [k / many for k in range(many)], 20 * many).alias("b")).first().b
    bounds = sorted(set(found or [0]))
    step = max(1, math.isqrt(len(bounds)))
    literal = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    tops = "array(" + ",".join(f"{b}L" for b in bounds[::step]) + ")"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")) \
        .withColumn("_top", F.expr(f"size(filter({tops}, b -> b <= doc_id))")) \
        .withColumn("bucket", F.expr(f"CASE WHEN doc_id IS NULL OR _top = 0 THEN -1 ELSE (_top - 1) * {step} + "
                                     f"size(filter(slice({literal}, (_top - 1) * {step} + 1, {step}), b -> b <= doc_id)) END")) \
        .drop("_top")
    # few rows: the first id of each bucket, and which bucket follows
    heads = stage(rows.groupBy("bucket").agg(F.min("doc_id").alias("_head")))
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole)).alias("_next"))
    firsts = rows.join(F.broadcast(heads.withColumnRenamed("bucket", "_b")),
                       (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_head"))) \
        .groupBy("bucket").agg(F.min("text").alias("_first"))
    after = follows.join(firsts.withColumnRenamed("bucket", "_next"), "_next").select("bucket", "_next", "_first")
    return rows, stage(after)


def compared_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half (rounded down) replaced by as many first characters of
    the next document.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, after = in_order(docs, tasks)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("_lead", F.lead("text").over(order)) \
        .join(after, "bucket", "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                      F.substring(F.coalesce("_lead", "_first"), F.lit(1), half))
    each = placed.select("bucket", "place", "_next", "doc_id", n.cast("long").alias("n_chars"), terms(F.col("text")).alias("terms"),
                         edited.alias("_edited")) \
        .withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)) \
        .withColumn("edited_terms", terms(F.col("_edited"))).drop("_edited")
    done = with_hashes(each, ["bucket", "place"], {"terms": "hashes", "edited_terms": "edited_hashes"}, lexicon(docs, low, high))
    done = stage(done.drop("terms", "edited_terms"))
    firsts = done.where("place = 1").select(F.col("bucket").alias("_next"), F.col("hashes").alias("_after"))
    here = Window.partitionBy("bucket").orderBy("place")
    paired = done.withColumn("_lead", F.lead("hashes").over(here)).join(firsts, "_next", "left")
    return paired.select("doc_id", "n_chars", "edited_sha256", printed(F.col("hashes")).alias("fingerprint"),
                         printed(F.col("edited_hashes")).alias("edited_fingerprint"),
                         likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
                         likeness(F.col("hashes"), F.coalesce("_lead", "_after")).alias("near_next"))
