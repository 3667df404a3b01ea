"""Printed ledgers: an open account goes on over pages, and lines that are dealt out by page once are not moved to meet it."""

from types import SimpleNamespace

from cotejo.operators import reading as rd
from cotejo.plans import queries_reading as qr
from cotejo.session import stage_by

WORDS = "doc_id long, page long, line long, pos long, text string, x0 double, x1 double, run int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, lines):
    """Lines as (document, page, line, text): words 40 points apart."""
    return spark.createDataFrame([(d, p, n, i, t, 20.0 + 40 * i, 50.0 + 40 * i, 1) for d, p, n, text in lines for i, t in enumerate(text.split())], WORDS)


def unmoved(spark, make):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df = make()
        moved = [e for e in plan(df.select("doc_id", "seq", "w")).split("\n") if "Exchange" in e and "seq" in e]
        return df.collect(), moved
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_an_account_stays_open_over_pages(spark):
    """Pages without a heading inherit the last account of the pages before, also over empty pages and not over documents."""
    text = [(1, 1, 0, "portada"), (1, 2, 0, "1000001 BANCOS"), (1, 2, 1, "Enero 1.00"), (1, 3, 0, "Febrero 2.00"), (1, 900, 0, "Marzo 3.00"),
            (1, 900, 1, "1000002 CAJA"), (1, 900, 2, "Enero 4.00"), (1, 901, 0, "Febrero 5.00"), (2, 5, 0, "Enero 6.00")]
    packed = rd.pack_lines(words(spark, text).repartition(4, "doc_id", "page"))
    rows, moved = unmoved(spark, lambda: rd.ledger_lines(packed, keep=lambda x: stage_by(x, ["doc_id", "page"], 4)))
    assert not moved
    assert sorted((r.page, r.line, r.cta.cuenta) for r in rows) == [
        (2, 0, "1000001"), (2, 1, "1000001"), (3, 0, "1000001"), (900, 0, "1000001"), (900, 1, "1000002"), (900, 2, "1000002"), (901, 0, "1000002")]


def test_lines_of_a_journal_are_packed_once(spark, monkeypatch):
    """Blocks read their lines twice, so they get them as a stage table."""
    text = [(1, 1, 0, "Tipo de poliza: Diario"), (1, 1, 1, "101-01 CARGO 5.00"), (1, 2, 0, "101-02 CARGO 6.00"), (1, 3, 0, "Tipo de poliza: Egreso"), (1, 3, 1, "101-03 X 7.00")]
    tables = SimpleNamespace(spark=spark, folder="one journal", pj_words=words(spark, text))
    real, seen = rd.journal_blocks, []
    monkeypatch.setattr(rd, "journal_blocks", lambda lines: seen.append(plan(lines)) or real(lines))
    rows = qr.blocks(tables).collect()
    assert "Aggregate" not in seen[0]
    assert sorted((r.page, r.line, r.poliza_id, r.es_mov) for r in rows) == [
        (1, 0, "P00001", False), (1, 1, "P00001", True), (2, 0, "P00001", True), (3, 0, "P00002", False), (3, 1, "P00002", True)]


def test_lines_of_a_journal_are_dealt_out_once(spark):
    """Neither the scans nor the meeting of lines and flags moves a line; a block, its invoices and a waiting account go on over pages."""
    text = [(1, 1, 0, "101-09 ANTES 1.00"), (1, 1, 1, "Tipo de poliza: Diario"), (1, 1, 2, "101-01 CARGO 5.00"), (1, 2, 0, "101-02"), (1, 3, 0, "SIGUE 6.00"),
            (1, 3, 1, "CFDI"), (1, 4, 1000000, "01/02/2024 F-1"), (1, 5, 0, "Tipo de poliza: Egreso"), (1, 5, 1, "101-03 X 7.00"), (2, 1, 0, "Tipo de poliza: Diario")]
    packed = rd.pack_lines(words(spark, text).withColumn("_span", rd.reading_span()).repartition(4, *rd.SPAN), ["_span"])
    rows, moved = unmoved(spark, lambda: rd.journal_blocks(rd.dealt_lines(packed, 4)))
    assert not moved
    want = [(1, 1, 1, "P00001", False, False), (1, 1, 2, "P00001", True, False), (1, 2, 0, "P00001", False, False), (1, 3, 0, "P00001", False, False),
            (1, 3, 1, "P00001", False, False), (1, 4, 1000000, "P00001", False, True), (1, 5, 0, "P00002", False, False), (1, 5, 1, "P00002", True, False), (2, 1, 0, "P00001", False, False)]
    assert sorted((r.doc_id, r.page, r.line, r.poliza_id, r.es_mov, r.en_cfdi) for r in rows) == want
    wait = {(r.page, r.line): (r.abre_envuelto, r.envuelto) for r in rows if r.doc_id == 1}
    assert wait[2, 0][0] and wait[3, 0][1] == 2 << rd.PAGE_BITS and wait[5, 1][1] is None
    plain = rd.journal_blocks(rd.pack_lines(words(spark, text)))
    assert sorted((r.doc_id, r.page, r.line, r.poliza_id, r.es_mov, r.en_cfdi) for r in plain.collect()) == want
