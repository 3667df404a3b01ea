"""Document reading (R1-R17): classify lines, carry context forward, attach continuations.

Input is the packed line table: one row per printed line with its words as an array (a line
is physically bounded) and ``seq``, the reading order.  Context that crosses lines or pages
is carried by ``ordered_scan``; nothing is sorted per document in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.accounts import is_account
from cotejo.functions.text import (
    AMOUNT_DIALECTS,
    DETAIL_MARKS,
    RE_DATE_CELL,
    RE_UUID_HEAD,
    SUMMARY_MARKS,
    is_totals_row,
    month_number,
    normalize,
    parse_money,
    row_mark,
    starts_with_label,
    without_marks,
)
from cotejo.operators.scan import LEVEL_BITS, ordered_scan, ordered_texts
from cotejo.operators.skew import by_page, join_small
from cotejo.operators.verdict import AMOUNT
from cotejo.session import stage, stage_by, stage_like

c = F.col
LINE = ["doc_id", "page", "line"]
SPAN = ["doc_id", "_span"]
PAGE_BITS = 36
RE_BLOCK_ACCOUNT = r"^\d{3,}(-\d+)*$"
RE_LEDGER_ACCOUNT = r"^\d{3,}[-\d]*\d$"
RE_SECTION_ACCOUNT = r"^\d{2,}[-~][\d-]*\d"
RE_RFC_ANY = r"(?i)^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}$"
RE_UUID_TAIL = r"(?i)^[0-9A-F-]{4,}$"
SUBTOTAL_WORDS = ("total", "totales", "suma", "sumas")


def reading_order() -> Column:
    return F.shiftleft(c("page").cast("bigint"), PAGE_BITS) + c("line")


def reading_span() -> Column:
    """The span that an ``ordered_scan`` deals a line out by: its page, if that has less than a million lines."""
    return F.shiftright(reading_order(), LEVEL_BITS[0])


def pack_lines(words: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per line with its words left to right; words dealt out by line or by page already are not moved."""
    return words.groupBy(*LINE, *extra).agg(
        F.sort_array(F.collect_list(F.struct("x0", "pos", "x1", "text", "run"))).alias("w")
    ).withColumn("seq", reading_order())


def dealt_lines(lines: DataFrame, parts: int) -> DataFrame:
    """Packed lines as a stage table, dealt out by ``SPAN`` and numbered (``_n``) inside it; lines that are packed by ``_span`` do not move."""
    lines = lines if "_span" in lines.columns else lines.withColumn("_span", reading_span())
    return stage_by(lines.withColumn("_n", F.row_number().over(Window.partitionBy(*SPAN).orderBy("seq")) - 1), SPAN, parts)


def texts(w: Column | str = "w") -> Column:
    return F.transform(w, lambda k: k["text"])


def rest_from(w: Column | str, start: int) -> Column:
    """All elements from the ``start``-th (from one) on."""
    return F.slice(w, start, F.greatest(F.size(w), F.lit(0)))


def joined(w: Column) -> Column:
    return F.array_join(F.transform(w, lambda k: k["text"]), " ")


def amounts(kind: str, w: Column | str = "w") -> Column:
    return F.filter(w, lambda k: F.trim(k["text"]).rlike(AMOUNT_DIALECTS[kind]))


def not_amounts(kind: str, w: Column | str = "w") -> Column:
    return F.filter(w, lambda k: ~F.trim(k["text"]).rlike(AMOUNT_DIALECTS[kind]))


def money_of(t: Column) -> Column:
    return parse_money(t).cast(AMOUNT)


def label(n: int = 3) -> Column:
    return normalize(joined(F.slice("w", 1, n)))


def value_words(cut: float = 120.0) -> Column:
    """the words right of a field label."""
    return F.filter("w", lambda k: k["x0"] >= cut)


def main_run_text(limit: Column) -> Column:
    """The text of the left-most run, without amounts and account numbers."""
    near = F.filter("w", lambda k: k["x0"] < limit)
    first = F.array_min(F.transform(near, lambda k: F.struct(k["x0"].alias("a"), k["run"].alias("r"))))
    own = F.filter("w", lambda k: k["run"] == first["r"])
    used = F.when(F.size(own) < 2, near).otherwise(own)
    keep = F.filter(used, lambda k: ~F.trim(k["text"]).rlike(AMOUNT_DIALECTS["polizas"])
                    & ~k["text"].rlike(RE_BLOCK_ACCOUNT))
    return F.when(F.size(near) == 0, "").otherwise(joined(keep))


# --------------------------------------------------------------------- R1: trial balance
def role_rows(cells: DataFrame, roles: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells of a line under the name of their role; roles: (doc_id, campo, idx)."""
    j = join_small(cells, roles, ["doc_id", "idx"], by_page(), "left")
    g = j.groupBy(*LINE).agg(
        F.collect_list("texto").alias("celdas"),
        *[F.max(F.when(c("campo") == n, F.trim("texto"))).alias(n) for n in names])
    return g.na.fill("", list(names))


def trial_rows(rows: DataFrame, marks: DataFrame, money_roles: Sequence[str]) -> DataFrame:
    """Account rows with continued names. ``marks`` is (line key, marca).

    A name-only line belongs to the last row of ITS page; a page is a bounded window.
    """
    r = _trial_classes(rows)
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    r = r.withColumn("isla", F.sum((c("clase") == "fila").cast("int")).over(w))
    tail = r.filter((c("clase") == "cola") & (c("isla") > 0)).groupBy("doc_id", "page", "isla").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "nombre"))),
                                 lambda k: k["nombre"]), " ").alias("_cola"))
    j = (r.filter("clase = 'fila'").join(tail, ["doc_id", "page", "isla"], "left")
         .join(marks, LINE, "left"))
    return j.select(
        *LINE, "cuenta", F.trim(F.concat_ws(" ", without_marks(c("nombre")), "_cola")).alias("nombre"),
        F.upper(F.substring("naturaleza", 1, 1)).alias("naturaleza"),
        F.coalesce("marca", F.lit("")).alias("marca"),
        *[F.when(c(m) != "", money_of(c(m))).alias(m) for m in money_roles])


def _trial_classes(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "clase", F.when(is_account(c("cuenta")), "fila").when(is_totals_row(c("celdas")), "totales")
        .when(c("cuenta") != "", "encabezado").when(c("nombre") != "", "cola"))


def trial_totals(rows: DataFrame) -> DataFrame:
    """The totals line with both amounts; the last one of the document wins."""
    t = _trial_classes(rows).filter("clase = 'totales' AND debe <> '' AND haber <> ''")
    return t.groupBy("doc_id").agg(
        F.max_by(F.struct(money_of(c("debe")).alias("debe"), money_of(c("haber")).alias("haber")),
                 F.struct("page", "line")).alias("t")).select("doc_id", "t.*")


def words_marks(lines: DataFrame) -> DataFrame:
    return lines.select(*LINE, row_mark(texts()).alias("marca"))


# ------------------------------------------------------------------------ R2-R6: subledger
SUB_TEXTS = ("tipo_movimiento", "documento", "tercero", "concepto")
SUB_FIELDS = ("fecha", "folio", *SUB_TEXTS, "debe", "haber", "saldo")


def _is_money(t: Column) -> Column:
    return F.trim(t).rlike(AMOUNT_DIALECTS["auxiliar"])


def subledger_classes(lines: DataFrame) -> DataFrame:
    """What each line is. ``lines`` is packed, with role columns and ``dentro``
    (inside the table region) and ``es_encabezado`` (R7)."""
    tx, n = texts(), F.size(amounts("auxiliar"))
    dated = F.exists("w", lambda k: F.trim(k["text"]).rlike(RE_DATE_CELL))
    w0 = F.get("w", F.lit(0))
    second = F.coalesce(F.get(tx, F.lit(1)), F.lit(""))
    named = (normalize(w0["text"]) == "cuenta") & second.rlike(RE_SECTION_ACCOUNT)
    opening = label(2).isin("saldo inicial", "saldo anterior")
    sub = ~dated & F.split(normalize(joined(c("w"))), " ")[0].isin(*SUBTOTAL_WORDS) & (n > 0)
    move = F.trim("fecha").rlike(RE_DATE_CELL) & _is_money(c("debe")) & _is_money(c("haber"))
    inrow = (w0["x0"] <= 80) & w0["text"].rlike(r"^\d{3,}[-\d]*$") & ~dated & (n <= 1)
    l = lines.withColumn("_named", named).withColumn("_open", opening & ~named)
    # A balance line opens a section only when a label waits for it.
    l = ordered_scan(l, ["doc_id"], "seq", before={"_ev": F.when(c("_named"), F.struct(
        F.lit(True).alias("espera"), F.substring_index(second, "~", 1).alias("cuenta"),
        F.trim(F.concat_ws(" ", F.when(second.contains("~"), F.regexp_replace(second, "^[^~]*~", "")),
                           joined(rest_from("w", 3)))).alias("nombre"))).when(c("_open"), F.struct(
            F.lit(False).alias("espera"), F.lit("").alias("cuenta"), F.lit("").alias("nombre")))})
    last = F.get(amounts("auxiliar"), F.size(amounts("auxiliar")) - 1)["text"]
    zero = F.lit(0).cast(AMOUNT)
    labelled = c("_open") & F.coalesce(c("_ev.espera"), F.lit(False))
    kind = (F.when(c("_named"), "etiqueta").when(labelled, "seccion_etiquetada").when(sub, "subtotal")
            .when(move, "movimiento").when(inrow, "seccion_en_fila")
            .when(c("dentro") & ~c("es_encabezado") & (n == 0), "cola"))
    section = F.when(c("clase") == "seccion_etiquetada", F.struct(
        c("_ev.cuenta").alias("cuenta"), c("_ev.nombre").alias("nombre"),
        F.when(n > 0, money_of(last)).otherwise(zero).alias("inicial"))
    ).when(c("clase") == "seccion_en_fila", F.struct(
        w0["text"].alias("cuenta"), F.trim(joined(not_amounts("auxiliar", rest_from("w", 2)))).alias("nombre"),
        F.when(n > 0, money_of(F.get(amounts("auxiliar"), F.lit(0))["text"])).otherwise(zero).alias("inicial")))
    return l.withColumn("clase", kind).withColumn("seccion", section).drop("_named", "_open", "_ev")


def subledger_sections(classed: DataFrame) -> DataFrame:
    """R2 + R3: the sections, in reading order."""
    return classed.filter(c("seccion").isNotNull()).select("doc_id", "seq", "clase", "seccion.*")


def subledger_rows(classed: DataFrame) -> DataFrame:
    """Moves and subtotals under their section, with continued texts.

    A row before any section is dropped; a missing balance stays null and is marked.
    """
    row = c("clase").isin("movimiento", "subtotal")
    s = ordered_scan(classed, ["doc_id"], "seq", latest={"sec": c("seccion")})
    s = s.withColumn("_row", row & c("sec").isNotNull())
    s = ordered_scan(s, ["doc_id"], "seq", latest={"isla": F.when(c("_row"), c("seq"))})
    tails = ordered_texts(s.filter((c("clase") == "cola") & c("isla").isNotNull()), ["doc_id", "isla"], "seq",
                          {f"_{f}": F.nullif(F.trim(f), F.lit("")) for f in SUB_TEXTS})
    j = s.filter("_row").join(tails, ["doc_id", "isla"], "left")
    readable = _is_money(c("saldo"))
    zero_if_blank = lambda f: F.coalesce(money_of(c(f)), F.lit(0).cast(AMOUNT))
    return j.select(
        "doc_id", "seq", c("sec.cuenta").alias("cuenta"), c("sec.nombre").alias("nombre_cuenta"),
        c("sec.inicial").alias("saldo_inicial_cuenta"), "folio", "fecha",
        *[F.trim(F.concat_ws(" ", f, F.nullif(c(f"_{f}"), F.lit("")))).alias(f) for f in SUB_TEXTS],
        zero_if_blank("debe").alias("debe"), zero_if_blank("haber").alias("haber"),
        F.when(readable, money_of(c("saldo"))).alias("saldo"),
        (c("clase") == "subtotal").alias("es_subtotal"), c("page").alias("pagina"),
        F.when(readable, "impreso").otherwise("sin_saldo").alias("saldo_origen"))


# --------------------------------------------------------------------------- R8-R14: journal
def _has_date(w: Column | str = "w") -> Column:
    return F.exists(w, lambda k: k["text"].rlike(RE_DATE_CELL))


def journal_blocks(lines: DataFrame, account_width: float = 25.0) -> DataFrame:
    """R8 + R11: block number, CFDI zone and pending wrapped account of each line.

    ``lines`` are ``dealt_lines``, else they are made so. The scans carry flags, not words, and neither is moved again: the flags of
    a span, a page mostly, are stored as one array, and at each use of the blocks a line finds its own there by its number.

    Blocks open by label, or by a dated left text line. The second kind is swallowed while
    an account without amounts waits for them, so the waiting state is carried first.
    """
    w0 = F.get("w", F.lit(0))
    value = F.get(value_words(), F.lit(0))["text"]
    if "_n" not in lines.columns:
        lines = dealt_lines(lines, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keep = lambda l: stage_like(l, lines, SPAN)
    scan = lambda l, **what: ordered_scan(l, ["doc_id"], "seq", keep=True, dealt=True, **what)
    # What the words of a line say, read once.
    l = keep(lines.select(
        *SPAN, "seq", label().alias("_lab"), F.size(amounts("polizas")).alias("n_montos"), w0["text"].rlike(RE_BLOCK_ACCOUNT).alias("_acct"),
        F.coalesce(value.rlike(RE_DATE_CELL), F.lit(False)).alias("_fechado"),
        ((w0["x0"] <= account_width) & (F.size("w") >= 3) & _has_date()).alias("_nombra")))
    lab = c("_lab")
    l = (l.withColumn("abre", starts_with_label(lab, ("tipo de poliza", "tipo poliza")))
         .withColumn("marca_cfdi", starts_with_label(lab, ("cfdi",)))
         .withColumn("es_total", starts_with_label(lab, ("totales", "total poliza", "total")) & (c("n_montos") > 0)))
    l = l.withColumn("es_mov", ~c("es_total") & c("_acct") & (c("n_montos") >= 1))
    l = l.withColumn("campo", F.when(starts_with_label(lab, ("fecha",)) & c("_fechado"), "fecha")
                     .when(starts_with_label(lab, ("descripcion",)), "descripcion")
                     .when(starts_with_label(lab, ("folio",)), "folio"))
    l = l.withColumn("_cand", ~c("abre") & c("_nombra") & ~c("_acct") & (c("n_montos") == 0)).drop("_lab", "_fechado", "_nombra")
    # CFDI zone: from its mark to the next labelled block (named blocks do not open inside it).
    l = keep(scan(l, before={
        "_z": F.when(c("abre"), F.lit(False)).when(c("marca_cfdi"), F.lit(True)), "_open": F.when(c("abre") | c("_cand"), F.lit(True))}))
    l = l.withColumn("en_cfdi", F.coalesce("_z", F.lit(False)) & ~c("abre")).drop("_z")
    inside = c("_open").isNotNull() & ~c("en_cfdi")
    l = l.withColumn("campo", F.when(inside & ~c("abre"), c("campo")))
    plain = ~c("abre") & c("campo").isNull() & ~c("marca_cfdi") & ~c("es_total") & ~c("es_mov")
    waits = plain & inside & c("_acct") & (c("n_montos") == 0)
    l = l.withColumn("abre_envuelto", waits)
    event = F.when(waits, c("seq")).when(c("abre") | c("es_total") | c("es_mov")
                                         | (plain & (c("n_montos") > 0) & ~c("en_cfdi")), F.lit(-1).cast("bigint"))
    l = keep(scan(l, before={"_wait": event}))
    l = l.withColumn("envuelto", F.when((c("_wait") >= 0) & plain & ~waits & ~c("en_cfdi"), c("_wait")))
    l = l.withColumn("abre_nombre", c("_cand") & plain & ~c("en_cfdi") & c("envuelto").isNull())
    l = scan(l, running={"bloque": (c("abre") | c("abre_nombre")).cast("int")})
    flags = [k for k in l.columns if k not in (*SPAN, "seq", "_cand", "_open", "_wait", "_acct")]
    found = keep(l.groupBy(*SPAN).agg(F.sort_array(F.collect_list(F.struct("seq", *flags))).alias("_of")))
    own = lines.join(found.hint("shuffle_hash"), SPAN).withColumn("_o", F.get("_of", c("_n"))).filter("_o.bloque > 0")
    return own.select(*[k for k in lines.columns if k not in ("_span", "_n")], *[c(f"_o.{k}").alias(k) for k in flags],
                      F.format_string("P%05d", c("_o.bloque")).alias("poliza_id"))


def journal_entries(blocks: DataFrame, account_width: float = 25.0) -> DataFrame:
    """R8 + R9: one row per block; the last field line of each kind wins."""
    vals = value_words()
    joined_vals = joined(vals)
    tipo = F.coalesce(F.get(vals, F.lit(0))["text"], F.lit(""))
    nat = F.trim(joined(F.filter(rest_from(vals, 2), lambda k: ~k["text"].isin("(", ")"))))
    date = F.when(c("campo") == "fecha", F.get(vals, F.lit(0))["text"]).when(
        c("abre_nombre"), F.get(F.filter(texts(), lambda t: t.rlike(RE_DATE_CELL)), F.lit(0)))
    desc = F.when(c("campo") == "descripcion", joined_vals).when(
        c("abre_nombre"), main_run_text(F.lit(account_width + 100)))
    am = amounts("polizas")
    tot = F.when(c("es_total") & (c("n_montos") >= 2), F.struct(
        money_of(F.get(am, F.lit(0))["text"]).alias("debe"), money_of(F.get(am, F.lit(1))["text"]).alias("haber")))
    r = blocks.select("doc_id", "poliza_id", "seq", F.when(c("abre"), tipo).alias("tipo"),
                      F.when(c("abre"), nat).alias("nat"), date.alias("fecha"), desc.alias("desc"), tot.alias("tot"))
    pick = lambda n: F.max_by(n, F.when(c(n).isNotNull(), c("seq")))
    g = r.groupBy("doc_id", "poliza_id").agg(
        F.min("seq").alias("seq"), *[pick(n).alias(n) for n in ("tipo", "nat", "fecha", "desc", "tot")])
    e = F.lit("")
    return g.select(
        "doc_id", "seq", "poliza_id", F.coalesce("tipo", e).alias("tipo"), F.coalesce("nat", e).alias("naturaleza"),
        F.coalesce("fecha", e).alias("fecha"), F.coalesce("desc", e).alias("descripcion"),
        c("tot.debe").alias("total_debe"), c("tot.haber").alias("total_haber"), c("tot").isNotNull().alias("completa"))


def amount_anchors(blocks: DataFrame) -> DataFrame:
    """The two most supported right edges of the moves of a document.

    Edges are counted by value first; what is clustered is the handful of distinct edges.
    """
    e = blocks.filter("es_mov").select("doc_id", F.explode(amounts("polizas")).alias("a")).select(
        "doc_id", c("a.x1").alias("x"))
    h = e.groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("x")
    h = h.withColumn("_b", F.when(c("x") - F.lag("x").over(w) > 4.0, 1).otherwise(0)).withColumn("g", F.sum("_b").over(w))
    g = h.groupBy("doc_id", "g").agg(F.sum("n").alias("n"), (F.sum(c("x") * c("n")) / F.sum("n")).alias("x"))
    top = g.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(c("n").desc(), "g"))).filter("_r <= 2")
    return top.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("izq"), F.max("x").alias("der")
                                     ).filter("k = 2").drop("k")


def debit_credit(am: Column) -> tuple[Column, Column]:
    """Two amounts are debit and credit; one goes to the side of the nearer anchor."""
    size = F.size(am)
    last, prev = F.get(am, size - 1), F.get(am, size - 2)
    zero = F.lit(0).cast(AMOUNT)
    left = F.abs(last["x1"] - c("izq")) <= F.abs(last["x1"] - c("der"))
    two = size >= 2
    debit = F.when(two, prev["text"]).when(left, last["text"])
    credit = F.when(two | ~left, last["text"])
    return F.coalesce(money_of(debit), zero), F.coalesce(money_of(credit), zero)


def journal_moves(blocks: DataFrame) -> DataFrame:
    """R10 + R11: moves in one line, and moves whose name wrapped before the amounts.

    An account line that never gets amounts gives no move.
    """
    am = amounts("polizas")
    w0 = F.get("w", F.lit(0))
    name = F.trim(main_run_text(w0["x1"] + 5))
    direct = blocks.filter("es_mov").select(
        "doc_id", "poliza_id", "seq", "page", w0["text"].alias("cuenta"), name.alias("nombre_cuenta"), am.alias("am"))
    heads = blocks.filter("abre_envuelto").select(
        "doc_id", c("seq").alias("envuelto"), w0["text"].alias("cuenta"), name.alias("n0"))
    tail = F.trim(joined(not_amounts("polizas")))
    waiting, isla = blocks.filter(c("envuelto").isNotNull()), ["doc_id", "poliza_id", "envuelto"]
    ends = waiting.groupBy(*isla).agg(F.min(F.when(c("n_montos") > 0, F.struct("seq", "page", am.alias("am")))).alias("fin"))
    isle = ends.filter(c("fin").isNotNull()).join(ordered_texts(waiting, isla, "seq", {"cola": tail}), isla)
    wrapped = isle.join(heads, ["doc_id", "envuelto"]).select(
        "doc_id", "poliza_id", c("fin.seq").alias("seq"), c("fin.page").alias("page"), "cuenta",
        F.trim(F.concat_ws(" ", "n0", "cola")).alias("nombre_cuenta"), c("fin.am").alias("am"))
    every = direct.unionByName(wrapped)
    every = ordered_scan(every, ["doc_id", "poliza_id"], "seq", running={"orden": F.lit(1)})
    d, h = debit_credit(c("am"))
    return join_small(every, amount_anchors(blocks), "doc_id", by_page(), "left").select(
        "doc_id", "poliza_id", "orden", "seq", "cuenta", "nombre_cuenta", d.alias("debe"), h.alias("haber"),
        c("page").alias("pagina"))


def journal_cfdi(blocks: DataFrame) -> DataFrame:
    """Invoice rows of the CFDI zone; a lone UUID tail belongs to the row before it."""
    z = blocks.filter("en_cfdi AND NOT marca_cfdi AND NOT es_total AND NOT es_mov")
    t = texts()
    row = F.get(t, F.lit(0)).rlike(RE_DATE_CELL)
    tail = ~row & (F.size(t) == 1) & F.get(t, F.lit(0)).rlike(RE_UUID_TAIL)
    z = ordered_scan(z.withColumn("_row", row).withColumn("_tail", tail), ["doc_id"], "seq",
                     latest={"_of": F.when(c("_row"), c("seq"))})
    tails = ordered_texts(z.filter(c("_tail") & c("_of").isNotNull()), ["doc_id", "_of"], "seq", {"_t": F.get(texts(), F.lit(0))}, "")
    pick = lambda pat: F.coalesce(F.get(F.filter(texts(), lambda x: x.rlike(pat)), F.lit(0)), F.lit(""))
    r = z.filter("_row").withColumn("_u", pick(RE_UUID_HEAD)).withColumn("_r", pick(RE_RFC_ANY))
    rest = F.filter(rest_from(texts(), 2), lambda x: (x != c("_u")) & (x != c("_r")))
    r = r.withColumn("_rest", rest).join(tails, ["doc_id", "_of"], "left")
    n = F.size("_rest")
    return r.select(
        "doc_id", "seq", "poliza_id", F.get(texts(), F.lit(0)).alias("fecha"),
        F.when((n > 0) & (c("_u") != ""), F.get("_rest", F.lit(0))).otherwise("").alias("documento"),
        F.concat("_u", F.coalesce("_t", F.lit(""))).alias("uuid"), c("_r").alias("rfc"),
        F.when(n > 1, F.get("_rest", n - 1)).otherwise("").alias("tipo"))


# --------------------------------------------------------------------- R16, R17: general ledger
def ledger_lines(lines: DataFrame, left: float = 60.0, keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """The open account of each line; it survives page breaks.

    Lines look back inside their page, which is bounded; what a page opens last goes on to the pages after it, one row a
    page. ``keep`` writes the lines once: where it deals them out by page, no word moves when they meet what their page inherits.
    """
    w0 = F.get("w", F.lit(0))
    none = F.size(amounts("mayor")) == 0
    opens = (w0["x0"] <= left) & w0["text"].rlike(RE_LEDGER_ACCOUNT) & ~F.trim(w0["text"]).rlike(AMOUNT_DIALECTS["mayor"]) & none
    own = F.when(c("abre"), F.struct(c("seq").alias("id"), w0["text"].alias("cuenta")))
    upto = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = keep(lines.withColumn("abre", opens).withColumn("_own", own).withColumn("_here", F.last("_own", ignorenulls=True).over(upto)).drop("_own"))
    ends = stage(l.groupBy("doc_id", "page").agg(F.max_by("_here", "seq").alias("_last")).withColumn("_p", c("page").cast("bigint")))
    before = ordered_scan(ends, ["doc_id"], "_p", before={"_in": c("_last")}).select("doc_id", "page", "_in")
    j = l.join(stage(before).hint("shuffle_hash"), ["doc_id", "page"], "left")
    return j.withColumn("cta", F.coalesce("_here", "_in")).drop("_here", "_in").filter(c("cta").isNotNull())


def ledger_heads(ll: DataFrame) -> DataFrame:
    """Accounts with the first opening balance printed under them."""
    two = label(2)
    opening = ~c("abre") & (two.startswith("inicial") | two.startswith("saldo inicial"))
    am = amounts("mayor")
    value = F.when(F.size(am) > 0, money_of(F.get(am, F.lit(0))["text"])).otherwise(F.lit(0).cast(AMOUNT))
    first = ll.filter(opening).groupBy("doc_id", c("cta.id").alias("seq")).agg(
        F.min_by(value, "seq").alias("saldo_inicial"))
    own = ll.filter("abre").select("doc_id", "seq", c("cta.cuenta").alias("cuenta"),
                                   F.trim(joined(rest_from("w", 2))).alias("nombre_cuenta"),
                                   c("page").alias("pagina_inicio"))
    return own.join(first, ["doc_id", "seq"], "left")


def ledger_months(ll: DataFrame, anchors: DataFrame) -> DataFrame:
    """R16 + R17: month lines inside the table; every amount goes to the nearest of the sorted
    anchors (doc_id, anclas array), and the last one written wins."""
    w0 = F.get("w", F.lit(0))
    m = ll.filter(~c("abre") & c("dentro")).withColumn("orden", month_number(w0["text"])).filter("orden > 0")
    m = join_small(m, anchors, "doc_id", by_page(), "left")

    def nearest(x: Column) -> Column:
        return F.array_min(F.transform("anclas", lambda a, i: F.struct(F.abs(x - a).alias("d"), i.alias("i"))))["i"]

    placed = F.transform(amounts("mayor"), lambda k: F.struct(nearest(k["x1"]).alias("i"), k["text"].alias("t")))
    m = m.withColumn("_p", placed)

    def at(i: int) -> Column:
        own = F.filter("_p", lambda k: k["i"] == i)
        return money_of(F.get(own, F.size(own) - 1)["t"])

    zero = F.lit(0).cast(AMOUNT)
    return m.select(
        "doc_id", "seq", c("cta.cuenta").alias("cuenta"), "orden", w0["text"].alias("periodo"),
        F.coalesce(at(0), zero).alias("cargos"), F.coalesce(at(1), zero).alias("abonos"), at(2).alias("saldo"),
        at(3).alias("acum_cargos"), at(4).alias("acum_abonos"), c("page").alias("pagina"))
