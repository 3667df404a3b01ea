"""The intake stream: documents in several files, broken, incomplete and repeated ones."""

import uuid

import pytest
from pyspark.sql import functions as F

from cotejo.operators import rules_journal as rj
from cotejo.session import shared_dir
from cotejo.streaming import intake

ENTRIES = "doc_id long, seq long, poliza_id long, completa boolean, total_debe decimal(18,2), total_haber decimal(18,2)"
MOVES = "doc_id long, poliza_id long, orden long, debe decimal(18,2), haber decimal(18,2)"


@pytest.fixture
def box(spark):
    base = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    entries, moves = spark.createDataFrame([], ENTRIES), spark.createDataFrame([], MOVES)
    kinds = {"polizas": ({"polizas": entries.schema, "movimientos": moves.schema}, "polizas",
                         lambda d: [rj.double_entry(d["polizas"], rj.entry_totals(d["movimientos"]))])}

    def send(*rows):
        spark.createDataFrame(list(rows), intake.INBOX).coalesce(1).write.mode("append").parquet(f"{base}/inbox")

    def run(files=1):
        intake.run_intake(spark, f"{base}/inbox", kinds, f"{base}/out", f"{base}/checkpoint", wait_ms=60_000, files=files)
        return {(r.tipo, r.doc_id): (r.estado, r.resumen) for r in intake.job_log(spark, f"{base}/out").collect()}

    return spark, send, run


def entry(doc, part, of, balance=True):
    return ("polizas", doc, part, of, "polizas", f'{{"doc_id": {doc}, "seq": 1, "poliza_id": 1, "completa": true, "total_debe": 5.00, "total_haber": 5.00}}', None)


def move(doc, part, of, debit, credit, order=1):
    return ("polizas", doc, part, of, "movimientos", f'{{"doc_id": {doc}, "poliza_id": 1, "orden": {order}, "debe": {debit}, "haber": {credit}}}', None)


def test_documents_end_in_their_state(box):
    spark, send, run = box
    # document 1 comes in three files and balances only when it is whole; 2 does not balance
    send(entry(1, 0, 3), entry(2, 0, 1), move(2, 0, 1, 5, 4))
    send(move(1, 1, 3, 5, 0))
    # 3 lacks its second part, 4 holds a broken record, 5 has no entries, 6 is of no known kind, 7 contradicts itself
    send(move(1, 2, 3, 0, 5, 2), entry(3, 0, 2), entry(4, 0, 1), ("polizas", 4, 0, 1, "movimientos", "{oh", None), move(5, 0, 1, 1, 1),
         ("nada", 6, 0, 1, "x", "{}", None), entry(7, 0, 2))
    send(entry(7, 1, 3))
    got = run()
    assert {k[1]: v[0] for k, v in got.items()} == {1: "listo", 2: "con_discrepancias", 4: "error", 5: "no_reconocido", 6: "no_reconocido", 7: "error"}
    assert "contradicen" in got["polizas", 7][1] and "1 de 1 casos" in got["polizas", 1][1]
    # time passes without the missing part
    late = spark.createDataFrame([(None, None, 0, 1, None, None, None)], intake.INBOX).withColumn("hora", F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    rows = [tuple(r) for r in late.collect()]
    send(*rows)
    got = run()
    assert got["polizas", 3] == ("error", "llegaron 1 de 2 partes")


def test_a_document_sent_again_counts_by_its_latest_batch(box):
    _, send, run = box
    send(entry(1, 0, 1), move(1, 0, 1, 5, 4))
    assert run()["polizas", 1][0] == "con_discrepancias"
    send(entry(1, 0, 1), move(1, 0, 1, 5, 5))
    assert run()["polizas", 1][0] == "listo"


def test_a_record_of_another_document_is_not_judged_with_it(box):
    _, send, run = box
    # document 1 balances; document 2 holds a movement that says it is of document 1
    send(entry(1, 0, 1), move(1, 0, 1, 5, 5), entry(2, 0, 1), ("polizas", 2, 0, 1, *move(1, 0, 1, 3, 0, 2)[4:]))
    got = run()
    assert got["polizas", 1][0] == "listo" and got["polizas", 2] == ("error", "un registro no se pudo leer")


def test_a_record_is_read_or_marked(spark):
    rows = spark.createDataFrame([entry(1, 0, 1), ("polizas", 2, 0, 1, "polizas", "{oh", None), ("polizas", 3, 0, 1, "polizas", None, None),
                                  ("polizas", 4, 0, 1, "polizas", '{"doc_id": 1}', None)], intake.INBOX)
    got = intake.parsed(rows, spark.createDataFrame([], ENTRIES).schema)
    assert {r._de: (r._ok, r.seq) for r in got.collect()} == {1: (True, 1), 2: (False, None), 3: (False, None), 4: (False, None)}
