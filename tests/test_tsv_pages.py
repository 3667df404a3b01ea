"""OCR pages may share a file: without a page folder the page number of the row is the page."""

from pyspark.sql import functions as F

from cotejo.sources import scans


def test_page_comes_from_the_row(spark, tmp_path):
    z = F.lit("0")
    rows = spark.range(300).select(
        F.lit(1).alias("doc_id"), F.lit("5").alias("level"), F.col("id").cast("string").alias("page_num"), z.alias("block_num"), z.alias("par_num"),
        z.alias("line_num"), z.alias("word_num"), z.alias("left"), z.alias("top"), z.alias("width"), z.alias("height"), F.lit("90").alias("conf"), F.lit("x").alias("text"))
    rows.coalesce(1).write.partitionBy("doc_id").option("sep", "\t").option("header", True).option("quote", "").csv(str(tmp_path / "tsv"))
    got = scans.scan_tsv(spark, str(tmp_path / "tsv"))
    assert sorted((r.doc_id, r.page) for r in got.collect()) == [(1, p) for p in range(300)]
