"""Words that are dealt out by page once stay where they are: zones, columns, places and cells move none of them again."""

from pyspark.sql import functions as F

from cotejo.operators import layout as ly
from cotejo.plans import queries_layout as ql


def words(spark):
    """Forty pages of two documents: a header, then ten lines of an account, a name of two words and two amounts."""
    rows = []
    for page in range(40):
        for line in range(11):
            texts = [("Cuenta", 20.0), ("Nombre", 80.0), ("Debe", 285.0), ("Haber", 385.0)] if line == 0 else [
                (f"101-{line:02d}", 20.0), ("Caja", 80.0), ("norte", 95.0), (f"{line},200.50", 275.1), ("300.00", 381.3)]
            for k, (text, x0) in enumerate(texts):
                x1 = {"Debe": 300.0, "Haber": 400.0}.get(text) or (300.0 if "," in text else 400.0 if "." in text else x0 + 3 * len(text))
                rows.append((page % 2, page, line * 8 + k, text, x0, x1, 10.0 * line, 10.0 * line + 8))
    return spark.createDataFrame(rows, "doc_id long, page long, pos long, text string, x0 double, x1 double, top double, bottom double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_page_stay_where_they_are(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        lin = ql.stored_lines(words(spark))
        assert "Exchange" not in plan(ly.account_zone(lin))
        layout = spark.createDataFrame([(d, 0, "left", 20.0, 40.0) for d in (0, 1)] + [(d, 1, "left", 80.0, 110.0) for d in (0, 1)]
                                       + [(d, 2, "right", 275.0, 300.0) for d in (0, 1)] + [(d, 3, "right", 380.0, 400.0) for d in (0, 1)],
                                       "doc_id long, idx int, align string, x_min double, x_max double")
        cells = ly.cells(ly.place_words(lin, layout), layout)
        # a word is moved by an exchange that reads its text
        assert not [e for e in plan(cells).split("\n") if "Exchange" in e and ("line" in e or "text" in e)]
        got = {(r.line, r.idx): r.texto for r in cells.filter("page = 7").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got[0, 1] == "Nombre" and got[3, 0] == "101-03" and got[3, 1] == "Caja norte" and got[3, 2] == "3,200.50" and got[3, 3] == "300.00" and len(got) == 42


def test_the_word_nearest_to_the_edge_is_the_amount(spark):
    """Two amounts in one column: the nearer one stands, ties go to the left one; texts keep the order of their places."""
    lay = spark.createDataFrame([(1, 0, "left", 20.0, 90.0), (1, 1, "right", 250.0, 300.0)], "doc_id long, idx int, align string, x_min double, x_max double")
    w = [(1, 1, 0, 2, "b", 50.0, 60.0), (1, 1, 0, 1, "a", 30.0, 40.0), (1, 1, 0, 3, "5.00", 270.0, 290.0), (1, 1, 0, 4, "6.00", 275.0, 301.0),
         (1, 1, 1, 5, "7.00", 272.0, 298.0), (1, 1, 1, 6, "8.00", 270.0, 302.0), (1, 1, 1, 7, "lejos", 900.0, 910.0)]
    df = spark.createDataFrame(w, "doc_id long, page long, line long, pos long, text string, x0 double, x1 double")
    got = {(r.line, r.idx): r.texto for r in ly.cells(ly.place_words(df, lay), lay).collect()}
    assert got == {(0, 0): "a b", (0, 1): "6.00", (1, 1): "8.00"}
    placed = ly.place_words(df, lay)
    assert placed.count() == 7 and placed.filter(F.col("idx").isNull()).count() == 1


def test_what_a_page_has_is_not_broadcast(spark, monkeypatch):
    """A stage table is a few compressed MB when its rows, one or more for each page of the corpus, no longer fit into the driver."""
    plans, write = [], ql.stage
    kept = lambda df: plans.append(plan(df)) or write(df)
    monkeypatch.setattr(ql, "stage", kept)
    monkeypatch.setattr(ly, "stage", kept)
    lin, lay, cells = ql.read_tables(words(spark))
    heads = lin.select(*ly.LINE).filter("line = 0").distinct()
    named = ly.relabel(lay, lin, heads)
    plans.append(plan(named))
    by_page = [line for p in plans for line in p.split("\n") if "BroadcastHashJoin [" in line and ("page#" in line or "_tramo#" in line)]
    assert len(plans) >= 7 and not by_page
    assert cells.count() == 2 * 20 * 42 and {r.header.split(" ")[0] for r in named.filter("doc_id = 1").collect()} == {"Cuenta", "Nombre", "Debe", "Haber"}
