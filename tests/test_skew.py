"""Joins with one document that holds nine tenths of the rows: no task gets more than a twentieth."""

import re

import pytest
from pyspark.sql import functions as F

from cotejo.operators import layout as ly
from cotejo.operators import rules_trial as rt
from cotejo.operators.skew import by_page, by_seq, join_small


@pytest.fixture
def spread(spark):
    """Joins as they run when nothing is small enough to broadcast, without mending by Spark."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def largest_share(df):
    # the hash keeps Spark from leaving out a join whose columns nobody reads
    each = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.hash(*df.columns)))
    counts = [r.n for r in each.collect()]
    return max(counts) / sum(counts)


def rows(spark, n=40_000):
    """Document 1 holds 90 % of the rows; a page has ten lines."""
    hot = F.col("id") < int(0.9 * n)
    return spark.range(n).select(F.when(hot, 1).otherwise(2 + F.col("id") % 40).cast("long").alias("doc_id"), F.col("id").alias("seq"),
                                 F.floor(F.col("id") / 10).cast("long").alias("page"))


def test_plain_join_is_skewed_and_this_one_is_not(spread):
    big, small = rows(spread), spread.range(45).select(F.col("id").alias("doc_id"), (F.col("id") * 2).alias("x"))
    assert largest_share(big.join(small, "doc_id")) > 0.85
    got = join_small(big, small, "doc_id", by_page(3))
    assert largest_share(got) < 0.05
    assert got.filter("x = doc_id * 2").count() == big.count() and got.columns == [*big.columns, "x"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_same_rows_as_a_plain_join(spark, how):
    big = spark.createDataFrame([(k % 5 if k % 7 else None, k % 3, k) for k in range(200)], "doc_id long, idx int, seq long")
    small = spark.createDataFrame([(0, 0, "a"), (1, 1, "b"), (1, 1, "c"), (3, 2, None), (None, 0, "d")], "doc_id long, idx int, v string")
    want = big.join(small, ["doc_id", "idx"], how)
    got = join_small(big, small, ["doc_id", "idx"], by_seq(4), how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_words_of_a_hot_document_are_placed_in_many_tasks(spread, monkeypatch):
    monkeypatch.setattr("cotejo.operators.skew.PAGES", 3)
    words = rows(spread).select("doc_id", "page", "seq", F.lit("1,200.50").alias("text"), F.lit(300.0).alias("x0"), F.lit(340.0).alias("x1"))
    layout = spread.range(45).select(F.col("id").alias("doc_id"), F.lit(0).alias("idx"), F.lit("right").alias("align"),
                                     F.lit(290.0).alias("x_min"), F.lit(340.0).alias("x_max"))
    placed = ly.place_words(words, layout)
    assert largest_share(placed) < 0.05 and placed.filter("idx = 0").count() == words.count()


def test_schemes_and_summary_marks_of_a_hot_document(spread, monkeypatch):
    monkeypatch.setattr("cotejo.operators.skew.ROWS", 6)
    raw = rows(spread).select("doc_id", "seq", F.format_string("101-%02d-%06d", F.col("seq") % 90, F.col("seq")).alias("cuenta"), F.lit("").alias("marca"))
    leveled = rt.levels_and_parents(raw)
    assert largest_share(leveled) < 0.05
    plan = rt.summary_accounts(leveled)._jdf.queryExecution().executedPlan().toString()
    keyed = [e for e in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "_tramo" in e]
    assert len(keyed) >= 2  # the rows and the copies of the small side meet by document and span
