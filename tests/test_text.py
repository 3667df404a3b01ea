"""Input/output pairs of the scalar functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cotejo.functions import accounts as ac
from cotejo.functions import text as tx
from cotejo.operators.layout import lines
from cotejo.operators.reading import main_run_text  # noqa: F401
from cotejo.operators.tokens import split_amounts
from cotejo.sources.scans import expand_pages


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize("text,value", [
    ("1,234.56", "1234.56"), ("-99,999.99", "-99999.99"), ("$999.99", "999.99"), ("$ 1,000.00", "1000.00"),
    ("(1,250.25)", "-1250.25"), ("", "0"), ("   ", "0"), ("287,000.00-", "-287000.00"), (".50", "0.50"),
    ("-", "0"), ("Totales", None), ("1.2.3", None), ("1e5", None), ("--5", None)])
def test_parse_money(spark, text, value):
    got = one(spark, text, tx.parse_money)
    assert got == (None if value is None else Decimal(value))


def test_parse_money_strict(spark):
    with pytest.raises(Exception):
        one(spark, "Totales", lambda c: tx.parse_money(c, strict=True))


@pytest.mark.parametrize("text,expected", [
    ("Saldo Inicial Deudor", "saldo inicial deudor"), ("  DESCRIPCIÓN (Ñ) ", "descripcion n"),
    ("F.E-C/H A", "f e c h a"), ("ﬁn ½", None)])
def test_normalize(spark, text, expected):
    got = one(spark, text, tx.normalize)
    assert expected is None or got == expected


@pytest.mark.parametrize("a", ["1120-001-001", "1120001001"])
def test_canonical(spark, a):
    assert one(spark, a, ac.canonical) == "112000100100000000"


def test_padded_catalogue(spark):
    df = spark.createDataFrame([(1, "0400-0001-0000-0000"), (1, "0400-0000-0000-0000")], "doc_id bigint, cuenta string")
    from cotejo.operators.rules_trial import levels_and_parents
    got = {r.cuenta: (r.nivel, r.cuenta_padre) for r in levels_and_parents(df).collect()}
    assert got["0400-0001-0000-0000"] == (2, "0400-0000-0000-0000")
    assert got["0400-0000-0000-0000"] == (1, "")


def test_marker_catalogue(spark):
    rows = [(1, "110000000000000000001"), (1, "112000000000000000002"), (1, "112000100100000000003")]
    s = ac.infer_schemes(spark.createDataFrame(rows, "doc_id bigint, cuenta string")).collect()[0]
    assert (s.marca_ini, s.marca_fin, s.largo) == (18, 21, 21)


def test_pages(spark):
    df = spark.createDataFrame([("1,3-5,-1", 9), ("", 9), (None, 1), ("0,99", 5)], "s string, t int")
    got = [r.p for r in df.select(expand_pages(F.col("s"), F.col("t")).alias("p")).collect()]
    assert got == [[1, 3, 4, 5, 9], [1, 2, 9], [1], []]


def test_glued_amounts(spark):
    df = spark.createDataFrame([("SERDAN-228,200.69",), ("1,185.22-227,015.47",), ("12.50",), ("12.50X",)], "text string")
    got = [r.text for r in split_amounts(df).collect()]
    assert got == ["SERDAN", "-228,200.69", "1,185.22", "-227,015.47", "12.50", "12.50X"]


def test_tall_words_stay_on_their_line(spark):
    w = [(1, 1, 0, "a", 10.0, 20.0, 10.0, 18.0), (1, 1, 1, "b", 30.0, 40.0, 6.0, 22.0), (1, 1, 2, "c", 10.0, 20.0, 26.0, 34.0)]
    df = spark.createDataFrame(w, "doc_id bigint, page bigint, pos bigint, text string, x0 double, x1 double, top double, bottom double")
    got = {r.text: r.line for r in lines(df).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}
