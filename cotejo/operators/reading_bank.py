"""Reading bank statements (R20-R30) from packed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import (
    RE_BANK_ACCOUNT,
    RE_CLABE,
    RE_RFC,
    RE_SIGNED_AMOUNT,
    balance_field,
    normalize,
    statement_date,
    tight_key,
)
from cotejo.operators.layout import edge_limit, widened
from cotejo.operators.reading import LINE, PAGE_BITS, joined, money_of, texts
from cotejo.operators.scan import ordered_scan, ordered_texts
from cotejo.operators.skew import PAGES, by_page, by_seq, join_small
from cotejo.operators.verdict import AMOUNT

c = F.col
REACH = 60.0                    # points between a label and the amount under it
REF_LEFT, REF_RIGHT = 30.0, 6.0
JUMP = 12.0                     # points between a row and its continuation
OPENINGS = ("saldoanterior", "saldoinicial", "balanceinicial", "saldofinaldelperiodoanterior")


def _money(t: Column) -> Column:
    return F.trim(t).rlike(RE_SIGNED_AMOUNT)


def amounts() -> Column:
    return F.filter("w", lambda k: _money(k["text"]))


def not_amounts() -> Column:
    return F.filter("w", lambda k: ~_money(k["text"]))


def identity(lines: DataFrame) -> DataFrame:
    """Bank, RFC, CLABE, account number, period, year and currency; first hit per document."""
    t = F.transform(texts(), lambda x: F.regexp_replace(F.trim(x), ":+$", ""))
    plain = normalize(joined(c("w")))
    whole = joined(c("w"))
    runs = F.array_distinct(F.transform("w", lambda k: k["run"]))
    by_run = F.transform(runs, lambda r: joined(F.filter("w", lambda k: k["run"] == r)))
    bank = F.get(F.filter(by_run, lambda x: F.array_contains(F.split(normalize(x), " "), "banca")
                          & normalize(x).contains("institucion")), F.lit(0))
    first = lambda pat: F.get(F.filter(t, lambda x: x.rlike(pat)), F.lit(0))
    own = F.filter(texts(), lambda x: F.trim(x).rlike(RE_BANK_ACCOUNT) & ~F.trim(x).rlike(RE_CLABE))
    account = F.when(F.array_contains(F.split(plain, " "), "cuenta") & (F.size(own) > 0),
                     F.trim(F.get(own, F.size(own) - 1)))
    period = plain.contains("periodo")
    year = F.when(period, F.nullif(F.regexp_extract(whole, r"(?<!\d)((19|20)\d{2})(?!\d)", 1), F.lit("")))
    dates = F.regexp_extract_all(whole, F.lit(r"(\d{1,2}\s+[A-ZÁÉÍÓÚ]{3}\s+\d{4})"), F.lit(1))
    both = F.when(period & (F.size(dates) >= 2), F.struct(
        F.get(dates, F.lit(0)).alias("ini"), F.get(dates, F.lit(1)).alias("fin")))
    at = F.array_position(F.transform(texts(), normalize), "moneda").cast("int")
    rest = F.filter(F.slice(texts(), F.greatest(at, F.lit(0)) + 1, 2), lambda x: x.rlike(r"^\p{L}{3,}$"))
    currency = F.when((at > 0) & (F.size(rest) > 0), F.array_join(rest, " "))
    r = lines.select("doc_id", "seq", F.trim(bank).alias("banco"), first(RE_RFC).alias("rfc"), first(RE_CLABE).alias("clabe"),
                     account.alias("num_cuenta"), both.alias("per"), year.alias("anio"), currency.alias("moneda"))
    pick = lambda n: F.min_by(n, F.when(c(n).isNotNull(), c("seq")))
    g = r.groupBy("doc_id").agg(*[pick(n).alias(n) for n in ("banco", "rfc", "clabe", "num_cuenta", "per", "anio", "moneda")])
    e = F.lit("")
    return g.select("doc_id", *[F.coalesce(n, e).alias(n) for n in ("banco", "rfc", "clabe", "num_cuenta", "anio", "moneda")],
                    F.coalesce("per.ini", e).alias("periodo_ini"), F.coalesce("per.fin", e).alias("periodo_fin"))


def horizontal_summary(labels: DataFrame, lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """Balance labels on one line, their amounts on the next; nearest right edge < 60."""
    named = balance_field(labels, vocab)
    enough = named.groupBy(*LINE).agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
    named = named.join(enough.select(*LINE), LINE, "left_semi")
    below = lines.select("doc_id", "page", (c("line") - 1).alias("line"), amounts().alias("am")).filter(F.size("am") >= 3)
    j = named.join(below, LINE).withColumn("_n", F.array_min(F.transform("am", lambda k: F.struct(
        F.abs(k["x1"] - c("x_max")).alias("d"), k["pos"].alias("p"), k["text"].alias("t")))))
    return j.filter(c("_n.d") < REACH).select(*LINE, "n_etiqueta", "campo", money_of(c("_n.t")).alias("valor"))


def label_values(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each amount of a line takes the words since the previous amount as its label."""
    w = Window.partitionBy(*LINE).orderBy("x0", "pos")
    m = words.withColumn("_m", _money(c("text")))
    m = m.withColumn("_g", F.coalesce(F.sum(c("_m").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    label = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("x0", "pos", "text", "_m"))),
                                 lambda k: F.when(~k["_m"] & ~F.trim(k["text"]).rlike(r"^[\d.,]+$"), k["text"])),
                     lambda x: x.isNotNull())
    g = m.groupBy(*LINE, "_g").agg(F.array_join(label, " ").alias("etiqueta"),
                                   F.max(F.when(c("_m"), c("text"))).alias("importe")).filter(c("importe").isNotNull())
    named = balance_field(g.withColumnRenamed("_g", "n_etiqueta"), vocab)
    return named.select(*LINE, "n_etiqueta", "etiqueta", "campo", money_of(c("importe")).alias("valor"))


def first_balances(found: DataFrame) -> DataFrame:
    """R22 + R23: the first value of each field wins, one row per document."""
    key = F.struct("page", "line", "n_etiqueta")
    return found.groupBy("doc_id").agg(*[
        F.min_by("valor", F.when(c("campo") == n, key)).alias(n)
        for n in ("saldo_inicial", "depositos", "retiros", "saldo_corte")])


def account_rows(lines: DataFrame, headers: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows under an accounts header. A TOTAL row closes the table and declares the sum;
    an amount line that fits no balance column ends it.

    ``headers``: header lines. ``columns``: their columns with ``campo``, keyed by header ``seq``.
    """
    h = headers.select(*LINE, F.lit(True).alias("_h"))
    l = lines.join(h, LINE, "left").withColumn("_h", F.coalesce("_h", F.lit(False)))
    l = ordered_scan(l, ["doc_id"], "seq", latest={"cab": F.when(c("_h"), c("seq"))})
    l = l.filter(~c("_h") & c("cab").isNotNull() & (F.shiftright("cab", PAGE_BITS) == c("page"))
                 & (F.size(amounts()) > 0))
    cols = columns.withColumn("align", F.when(c("campo").isin("saldo_inicial", "saldo_corte"), "right").otherwise("left"))
    lim = edge_limit(cols.select(F.concat_ws("#", "doc_id", "cab").alias("doc_id"), "align", "x_max"))
    wide = widened(cols, ["doc_id", "cab"]).select("doc_id", "cab", "campo", "align", "x_min", "x_max")
    pack = cols.filter("align = 'right'").select("doc_id", "cab", "campo", "align", "x_min", "x_max").unionByName(wide)
    pack = pack.groupBy("doc_id", "cab").agg(F.sort_array(F.collect_list(
        F.struct("x_max", "x_min", "campo", "align"))).alias("_c"))
    pack = pack.withColumn("_k", F.concat_ws("#", "doc_id", "cab")).join(
        lim.withColumnRenamed("doc_id", "_k"), "_k", "left").drop("_k")
    l = join_small(l, pack, ["doc_id", "cab"], by_page())
    rights = F.filter("_c", lambda k: k["align"] == "right")

    def field(k: Column) -> Column:
        near = F.array_min(F.transform(rights, lambda r: F.struct(F.abs(k["x1"] - r["x_max"]).alias("d"), r["campo"].alias("f"))))
        mid = (k["x0"] + k["x1"]) / 2
        txt = F.get(F.filter("_c", lambda r: (r["align"] == "left") & mid.between(r["x_min"], r["x_max"])), F.lit(0))
        return F.when(_money(k["text"]), F.when(near["d"] < c("limite"), near["f"])).otherwise(txt["campo"])

    l = l.withColumn("_p", F.transform("w", lambda k: F.struct(field(k).alias("f"), k["text"].alias("t"))))
    of = lambda n: F.transform(F.filter("_p", lambda k: k["f"] == n), lambda k: k["t"])
    l = l.withColumn("_ini", F.get(of("saldo_inicial"), F.lit(0))).withColumn("_cor", F.get(of("saldo_corte"), F.lit(0)))
    fits = c("_ini").isNotNull() | c("_cor").isNotNull()
    total = fits & tight_key(joined(not_amounts())).startswith("total")
    l = l.withColumn("_tot", total)
    # Rows count until the first TOTAL (included) or the first line that does not fit.
    l = ordered_scan(l, ["doc_id", "cab"], "seq", before={"_end": F.when(c("_tot") | ~fits, F.lit(True))})
    l = l.filter(c("_end").isNull() & fits)
    words = F.concat(of("producto"), of("num_cuenta"))
    stop = F.array_position(F.transform(words, lambda x: ~x.rlike(r"\p{L}")), True).cast("int")
    name = F.when(stop > 0, F.slice(words, F.lit(1), stop - 1)).otherwise(words)
    nums = F.filter(words, lambda x: x.rlike(RE_BANK_ACCOUNT) & ~x.rlike(RE_CLABE))
    clabe = F.array_join(of("clabe"), "")
    return l.select(
        "doc_id", "seq", c("_tot").alias("es_total"), F.coalesce(F.get(nums, F.size(nums) - 1), F.lit("")).alias("num_cuenta"),
        F.when(clabe.rlike(RE_CLABE), clabe).otherwise("").alias("clabe"), F.trim(F.array_join(name, " ")).alias("producto"),
        money_of(c("_ini")).alias("saldo_inicial"), money_of(c("_cor")).alias("saldo_corte"))


def resolve_accounts(rows: DataFrame, ident: DataFrame, balances: DataFrame) -> DataFrame:
    """Several summary rows stand alone; otherwise one account completed from the document.
    A balance of 0.00 is a value, not a gap."""
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    blank = lambda x: F.nullif(c(x), F.lit(""))
    many = rows.join(n.filter("n > 1").select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "num_cuenta", "clabe", "producto", F.lit("").alias("moneda"), "saldo_inicial",
        F.lit(None).cast(AMOUNT).alias("depositos"), F.lit(None).cast(AMOUNT).alias("retiros"), "saldo_corte")
    one = ident.join(n.filter("n > 1").select("doc_id"), "doc_id", "left_anti").alias("i")
    r = rows.select("doc_id", *[c(x).alias(f"r_{x}") for x in ("num_cuenta", "clabe", "producto", "saldo_inicial", "saldo_corte")])
    j = one.join(r, "doc_id", "left").join(balances, "doc_id", "left")
    single = j.select(
        "doc_id", F.coalesce(blank("r_num_cuenta"), "num_cuenta").alias("num_cuenta"),
        F.coalesce(blank("r_clabe"), "clabe").alias("clabe"), F.coalesce("r_producto", F.lit("")).alias("producto"), "moneda",
        F.coalesce("r_saldo_inicial", "saldo_inicial").alias("saldo_inicial"), "depositos", "retiros",
        F.coalesce("r_saldo_corte", "saldo_corte").alias("saldo_corte"))
    return many.unionByName(single)


def section_lines(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines that open with a product name; the longest name wins, its first account counts.

    A name is a prefix of the tight line key, so a line offers one key for each length that a
    name of its document has, and both sides meet by equality.
    """
    acc = accounts.filter("producto <> ''").withColumn("_k", tight_key(c("producto"))).groupBy("doc_id", "_k").agg(
        F.min_by("num_cuenta", "seq").alias("num_cuenta"))
    lengths = acc.groupBy("doc_id").agg(F.collect_set(F.length("_k")).alias("_lens"))
    l = lines.select("doc_id", "seq", tight_key(joined(c("w"))).alias("_t"))
    l = join_small(l, lengths, "doc_id", by_seq(PAGE_BITS + PAGES))
    fits = F.filter("_lens", lambda n: n <= F.length("_t"))
    keys = l.select("doc_id", "seq", F.explode(F.transform(fits, lambda n: F.left("_t", n))).alias("_k"))
    hit = join_small(keys, acc, ["doc_id", "_k"], by_seq(PAGE_BITS + PAGES))
    return hit.groupBy("doc_id", "seq").agg(F.max_by("num_cuenta", F.length("_k")).alias("seccion"))


def move_cells(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Fields of each table line. ``lines`` carries ``cab``, the header it hangs from, and
    ``columns`` the header columns (doc_id, cab, campo, x_min, x_max).

    Leading words that open inside the date columns are dates, amounts go by right edge, words
    with a digit inside the reference column are reference, and the rest is description.
    """
    right = c("campo").isin("deposito", "retiro", "saldo")
    cols = columns.withColumn("align", F.when(right, "right").otherwise("left"))
    key = F.concat_ws("#", "doc_id", "cab")
    lim = edge_limit(cols.select(key.alias("doc_id"), "align", "x_max")).withColumnRenamed("doc_id", "_k")
    pack = cols.groupBy("doc_id", "cab").agg(F.sort_array(F.collect_list(F.struct("x_min", "x_max", "campo"))).alias("_c"))
    pack = pack.withColumn("_k", key).join(lim, "_k", "left").drop("_k")
    j = join_small(lines, pack, ["doc_id", "cab"], by_page())
    dates = F.filter("_c", lambda k: k["campo"] == "fecha")
    first, last = F.get(dates, F.lit(0))["x_max"], F.get(dates, F.size(dates) - 1)["x_max"]
    w = c("w")
    # The leading stretch ends at the first amount or the first word past its column.
    lead = lambda edge: F.coalesce(F.nullif(F.array_position(F.transform(
        w, lambda k: (k["x0"] > edge) | _money(k["text"])), True).cast("int"), F.lit(0)) - 1, F.size(w))
    n1, n2 = F.coalesce(lead(first), F.lit(0)), F.coalesce(lead(last), F.lit(0))
    j = j.withColumn("_n1", n1).withColumn("_n2", F.greatest(n1, n2))
    rest = F.slice("w", c("_n2") + 1, F.greatest(F.size("w") - c("_n2"), F.lit(0)))
    ref = F.get(F.filter("_c", lambda k: k["campo"] == "referencia"), F.lit(0))
    rights = F.filter("_c", lambda k: k["campo"].isin("deposito", "retiro", "saldo"))

    def field(k: Column) -> Column:
        near = F.array_min(F.transform(rights, lambda r: F.struct(F.abs(k["x1"] - r["x_max"]).alias("d"), r["campo"].alias("f"))))
        in_ref = k["text"].rlike(r"\d") & (k["x0"] >= ref["x_min"] - REF_LEFT) & (k["x1"] <= ref["x_max"] + REF_RIGHT)
        return F.when(_money(k["text"]), F.when(near["d"] < c("limite"), near["f"]).otherwise("")).when(
            F.coalesce(in_ref, F.lit(False)), "referencia").otherwise("descripcion")

    j = j.withColumn("_p", F.transform(rest, lambda k: F.struct(field(k).alias("f"), k["text"].alias("t"))))
    of = lambda n: F.transform(F.filter("_p", lambda k: k["f"] == n), lambda k: k["t"])
    return j.withColumn("c_fecha", F.array_join(F.transform(F.slice("w", 1, c("_n1")), lambda k: k["text"]), " ")).withColumn(
        "c_descripcion", F.array_join(of("descripcion"), " ")).withColumn("c_referencia", F.array_join(of("referencia"), " ")).select(
        "*", *[F.get(of(n), F.lit(0)).alias(f"c_{n}") for n in ("deposito", "retiro", "saldo")]).drop("_c", "limite", "_n1", "_n2", "_p")


def empty_amounts(t: Column, null_when_empty: bool = False) -> Column:
    """An empty deposit or withdrawal is zero; an empty balance stays null."""
    v = money_of(t)
    return v if null_when_empty else F.coalesce(v, F.lit(0).cast(AMOUNT))


def table_lines(lines: DataFrame, headers: DataFrame, sections: DataFrame, first_account: DataFrame) -> DataFrame:
    """R25 + R27: each line with the header it hangs from and the account that is open."""
    l = lines.join(headers.select(*LINE, F.lit(True).alias("_h")), LINE, "left").join(sections, ["doc_id", "seq"], "left")
    l = l.withColumn("_h", F.coalesce("_h", F.lit(False)) & c("seccion").isNull())
    mark = c("_h") | c("seccion").isNotNull()
    l = ordered_scan(l, ["doc_id"], "seq", latest={
        "cab": F.when(c("_h"), c("seq")), "_s": c("seccion"), "_mk": F.when(mark, c("seq"))})
    # Nothing is read on a page before its first header or section line.
    l = join_small(l.filter(F.shiftright("_mk", PAGE_BITS) == c("page")), first_account, "doc_id", by_page(), "left")
    return l.withColumn("num_cuenta", F.coalesce("_s", "primera", F.lit(""))).drop("_s", "primera")


def moves(lines: DataFrame, columns: DataFrame, meta: DataFrame, separator: str = "") -> DataFrame:
    """R27 + R28 + R30: dated rows under a header, continued by lines at most 12 pt below.

    ``lines`` comes from ``table_lines`` and carries ``top`` and ``bottom``.
    """
    body = lines.filter(~c("_h") & c("seccion").isNull() & c("cab").isNotNull())
    cells = join_small(move_cells(body, columns), meta.select("doc_id", "periodo_ini", "periodo_fin", "anio"), "doc_id", by_page(), "left")
    e = F.lit("")
    date = statement_date(c("c_fecha"), F.coalesce("periodo_ini", e), F.coalesce("periodo_fin", e), F.coalesce("anio", e))
    r = cells.withColumn("_d", date).withColumn("_row", c("_d").isNotNull())
    # The chain of lines may only be followed while every step is short: a longer gap cuts it
    # until the next dated row. Steps are measured to the line above on the same page.
    # A header or section line starts a new stretch.
    marks = lines.filter(c("_h") | c("seccion").isNotNull()).select("doc_id", "seq", "page", "top", "bottom")
    flow = r.select("doc_id", "seq", "page", "top", "bottom", "_row").unionByName(
        marks.withColumn("_row", F.lit(None).cast("boolean")))
    flow = ordered_scan(flow, ["doc_id"], "seq", lag={"_pp": c("page"), "_pb": c("bottom")})
    cut = (c("_pp") != c("page")) | (c("top") - c("_pb") > JUMP) | c("_pp").isNull()
    flow = ordered_scan(flow, ["doc_id"], "seq", latest={
        "_last": F.when(c("_row"), c("seq")), "_mk": F.when(c("_row").isNull(), c("seq")),
        "_brk": F.when(~F.coalesce("_row", F.lit(True)) & cut, c("seq"))})
    hangs = flow.filter((c("_row") == False) & c("_last").isNotNull()  # noqa: E712
                        & (c("_brk").isNull() | (c("_brk") < F.greatest("_last", "_mk")))).select("doc_id", "seq", c("_last").alias("de"))
    tail = joined(not_amounts())
    tails = ordered_texts(r.select("doc_id", "seq", tail.alias("cola")).filter("cola <> ''").join(hangs, ["doc_id", "seq"]),
                          ["doc_id", "de"], "seq", {"cola": c("cola")}, separator)
    rows = r.filter("_row").join(tails.withColumnRenamed("de", "seq"), ["doc_id", "seq"], "left")
    out = rows.select(
        "doc_id", "seq", "num_cuenta", "_d.dia", "_d.fecha",
        F.concat("c_descripcion", F.when(c("cola").isNull(), "").otherwise(F.concat(F.lit(separator), "cola"))).alias("descripcion"),
        c("c_referencia").alias("referencia"), empty_amounts(c("c_deposito")).alias("deposito"),
        empty_amounts(c("c_retiro")).alias("retiro"), empty_amounts(c("c_saldo"), True).alias("saldo"), c("page").alias("pagina"))
    return without_openings(out)


def is_opening(deposit: Column, withdrawal: Column, text: Column) -> Column:
    """R28."""
    key = tight_key(text)
    named = F.lit(False)
    for o in OPENINGS:
        named = named | key.startswith(o)
    return (deposit == 0) & (withdrawal == 0) & named


def without_openings(m: DataFrame) -> DataFrame:
    """The balance a section starts with is printed as a row but is not a move."""
    return m.filter(~is_opening(c("deposito"), c("retiro"), c("descripcion")))


def report_kind(accounts: DataFrame, moves_table: DataFrame) -> DataFrame:
    """What a document without moves is, from its own declared figures."""
    idle = accounts.join(moves_table.select("doc_id").distinct(), "doc_id", "left_anti")
    known = c("depositos").isNotNull() & c("retiros").isNotNull()
    g = idle.groupBy("doc_id").agg(
        F.count_if(known).alias("n"), F.bool_and(F.when(known, (c("depositos") == 0) & (c("retiros") == 0))).alias("ceros"))
    quiet = (c("n") > 0) & c("ceros")
    return g.select("doc_id", F.when(quiet, "sin_movimientos").otherwise("no_identificado").alias("clave"), F.when(
        quiet, "el documento no trae tabla de movimientos porque la cuenta no tuvo ninguno: su resumen declara depositos y "
        "retiros en cero").otherwise("no se encontro la tabla de movimientos y el resumen no alcanza para decir de que tipo de "
                                     "reporte se trata").alias("motivo"))
