"""Input scans: S1-S3, S5, S6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("page", T.LongType()),
    T.StructField("pos", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("x0", T.DoubleType()), T.StructField("x1", T.DoubleType()),
    T.StructField("top", T.DoubleType()), T.StructField("bottom", T.DoubleType()),
    T.StructField("size", T.DoubleType()), T.StructField("bold", T.BooleanType()),
    T.StructField("run", T.IntegerType())])

# The twelve fields of an OCR table; boxes are pixels.
TSV_FIELDS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top",
              "width", "height", "conf", "text")
TSV = T.StructType([T.StructField(n, T.StringType()) for n in TSV_FIELDS])

_MONEY = T.DecimalType(18, 2)
TRIAL = T.StructType(
    [T.StructField("cuenta", T.StringType()), T.StructField("nivel", T.IntegerType()),
     T.StructField("cuenta_padre", T.StringType()), T.StructField("naturaleza", T.StringType()),
     T.StructField("nombre", T.StringType())]
    + [T.StructField(n, _MONEY) for n in ("saldo_ini_deudor", "saldo_ini_acreedor", "debe", "haber",
                                          "saldo_fin_deudor", "saldo_fin_acreedor")])


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """The schema is given, so nothing is inferred and columns are pruned at the file."""
    return spark.read.schema(WORD).parquet(path)


def scan_tsv(spark: SparkSession, path: str, dpi: int = 300, min_confidence: float = 40.0) -> DataFrame:
    """OCR rows to words in points. Short rows, blank text, non-numeric boxes and low
    confidence are dropped. Folders ``doc_id=…`` give the document; ``page=…`` below them gives the page, else ``page_num`` does."""
    raw = (spark.read.schema(TSV).option("sep", "\t").option("header", True)
           .option("quote", "").option("mode", "PERMISSIVE").csv(path))
    num = {n: F.col(n).try_cast("double") for n in ("left", "top", "width", "height", "conf")}
    keep = F.trim("text") != ""
    for c in num.values():
        keep = keep & c.isNotNull()
    s = F.lit(dpi / 72)
    page = "page" if "page" in raw.columns else "page_num"
    return raw.filter(keep & (num["conf"] >= min_confidence)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(page).cast("bigint").alias("page"),
        F.trim("text").alias("text"), (num["left"] / s).alias("x0"),
        ((num["left"] + num["width"]) / s).alias("x1"), (num["top"] / s).alias("top"),
        ((num["top"] + num["height"]) / s).alias("bottom"), (num["height"] / s).alias("size"))


def scan_trial_csv(spark: SparkSession, path: str) -> DataFrame:
    """A trial balance as typed CSV with a header."""
    return spark.read.option("header", True).schema(TRIAL).csv(path)


def requested_pages(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """S3: only the wanted (doc_id, page, pedido) rows; out-of-range pages match nothing.

    Read in request order by sorting on (doc_id, pedido, pos).
    """
    return words.join(wanted, ["doc_id", "page"])


def expand_pages(spec: Column, total: Column) -> Column:
    """S5: '1,3-5,-1' to page numbers; no spec is first, second and last."""
    trimmed = F.transform(F.split(spec, ","), lambda p: F.trim(p))

    def one(p: Column) -> Column:
        n = p.try_cast("int")
        ends = F.split(p, "-")
        lo, hi = F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.lit(1)).try_cast("int")
        span = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.when(p.rlike(r"^\d+-\d+$"), span).otherwise(
            F.array(F.when(n < 0, total + n + 1).otherwise(n)))

    listed = F.flatten(F.transform(trimmed, one))
    default = F.array(F.lit(1), F.least(F.lit(2), total), total)
    pages = F.when(F.coalesce(spec, F.lit("")) == "", default).otherwise(listed)
    return F.sort_array(F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= total))))
