"""Token cleaning over the words table: K1-K16.

Every window is keyed by (doc_id, page) or finer: a printed page is physically bounded, so
no document is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import AMOUNT_DIALECTS, RE_LOOKS_AMOUNT, reread_class

PAGE = ["doc_id", "page"]
RE_AMOUNT = r"-?\d{1,3}(?:,\d{3})*\.\d{2}"
RE_SIGN = r"^-?\$$|^-$"
MON = "[A-Za-zÁÉÍÓÚÑ]{3}"
CID = "(cid:"
BAND, EDGE = 4.0, 18.0   # points of slack between the two readings
OVERLAP = 0.5


def _tenth(c: str) -> Column:
    return F.bround(F.col(c) * 10)


_COPY = ("text", "_kx", "_kt")


def deduplicate(words: DataFrame) -> DataFrame:
    """K1: one copy of each repeated token, its first appearance.

    One shuffle by page and one sort: a token is kept when the one sorted before it differs.
    """
    keyed = words.withColumn("_kx", _tenth("x0")).withColumn("_kt", _tenth("top"))
    w = Window.partitionBy(*PAGE).orderBy(*_COPY, "pos")
    same = F.lit(True)
    for k in _COPY:
        same = same & (F.lag(k).over(w) == F.col(k))
    return keyed.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).select(*words.columns)


def repetition(words: DataFrame) -> DataFrame:
    """K2: how often the most repeated token of a page appears."""
    keyed = words.withColumn("_kx", _tenth("x0")).withColumn("_kt", _tenth("top"))
    return (keyed.groupBy(*PAGE, *_COPY).agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*PAGE).agg(F.max("_n").alias("factor")))


def split_glued_dates(words: DataFrame) -> DataFrame:
    """K3: split tokens that carry a date glued to text, where the page shows one year width."""
    t = F.col("text")
    lone = F.regexp_extract(t, rf"^\d{{1,2}}-{MON}-(\d{{2}}|\d{{4}})$", 1)
    clear = F.regexp_extract(t, rf"^\d{{1,2}}-{MON}-(\d{{2}}|\d{{4}})\D", 1)
    width = F.nullif(F.length(F.when(lone != "", lone).otherwise(clear)), F.lit(0))
    seen = words.groupBy(*PAGE).agg(F.min(width).alias("_lo"), F.max(width).alias("_hi"))
    j = words.join(seen.filter("_lo = _hi").select(*PAGE, F.col("_lo").alias("_w")), PAGE, "left")
    pat = lambda n: rf"^(\d{{1,2}}-{MON}-\d{{{n}}})(\S.*)$"
    pick = lambda i: F.when(F.col("_w") == 2, F.regexp_extract(t, pat(2), i)).when(
        F.col("_w") == 4, F.regexp_extract(t, pat(4), i)).otherwise("")
    j = j.withColumn("_date", pick(1)).withColumn("_tail", pick(2))
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * F.length("_date") / F.length(t)
    part = lambda n, tx, a, b: F.struct(F.lit(n).alias("parte"), tx.alias("text"),
                                        a.alias("x0"), b.alias("x1"))
    pieces = F.when(F.col("_date") != "", F.array(
        part(0, F.col("_date"), F.col("x0"), cut), part(1, F.col("_tail"), cut, F.col("x1")))
    ).otherwise(F.array(part(0, t, F.col("x0"), F.col("x1"))))
    rest = [c for c in words.columns if c not in ("text", "x0", "x1")]
    return j.select(*rest, F.explode(pieces).alias("p")).select(*rest, "p.*")


def join_signs(words: DataFrame, line: str = "line") -> DataFrame:
    """K4: a run of sign tokens goes onto the amount that follows it; before anything else,
    or at the end of the line, it is dropped."""
    t = F.trim("text")
    sign = t.rlike(RE_SIGN)
    amount = t.rlike(AMOUNT_DIALECTS["estado_cuenta"])
    w = Window.partitionBy(*PAGE, line).orderBy("x0", "pos")
    # Words up to and including the next non-sign word share an island.
    isle = F.coalesce(F.sum(F.when(sign, 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = words.withColumn("_isle", isle).withColumn("_sign", sign)
    inside = Window.partitionBy(*PAGE, line, "_isle").orderBy("x0", "pos").rowsBetween(
        Window.unboundedPreceding, -1)
    prefix = F.array_join(F.collect_list(F.when(F.col("_sign"), t)).over(inside), "")
    out = j.withColumn("_pre", prefix).filter(~F.col("_sign"))
    return out.withColumn("text", F.when(amount & (F.col("_pre") != ""), F.concat("_pre", "text"))
                          .otherwise(F.col("text"))).drop("_isle", "_sign", "_pre")


def glyph_runs(chars: DataFrame) -> DataFrame:
    """K5: a new run starts where x steps back behind the previous glyph."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    back = F.col("x0") < F.lag("x1").over(w) - 0.5
    return chars.withColumn("_b", F.when(back, 1).otherwise(0)).withColumn(
        "run", F.sum("_b").over(w) + 1).drop("_b")


def glyph_words(chars: DataFrame, gap: float = 1.2) -> DataFrame:
    """K6: words inside a run, broken at white space and at horizontal gaps."""
    runs = glyph_runs(chars)
    w = Window.partitionBy(*PAGE, "run").orderBy("pos")
    space = F.col("ch").rlike(r"^[\s\p{Z}]$")
    r = runs.withColumn("_s", space)
    new = (F.lag("_s").over(w).isNull() | F.lag("_s").over(w)
           | (F.col("x0") - F.lag("x1").over(w) > gap))
    r = r.withColumn("_n", F.when(new, 1).otherwise(0))
    r = r.withColumn("_g", F.sum("_n").over(w)).filter(~F.col("_s"))
    g = r.groupBy(*PAGE, "run", "_g").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))),
                                 lambda s: s["ch"]), "").alias("text"),
        F.min_by("x0", "pos").alias("x0"), F.max_by("x1", "pos").alias("x1"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return g.drop("_g")


def split_amounts(words: DataFrame) -> DataFrame:
    """K7: text glued before amounts, or two amounts in a row, become separate words."""
    t = F.col("text")
    found = F.regexp_extract_all(t, F.lit(f"({RE_AMOUNT})"), F.lit(1))
    ends = t.rlike(f"{RE_AMOUNT}$")
    clean = t.rlike(f"^{RE_AMOUNT}$")
    # Amounts are fenced with a separator that no printed word contains.
    fenced = F.regexp_replace(t, f"({RE_AMOUNT})", "\u0001$1\u0001")
    pieces = F.filter(F.split(fenced, "\u0001"), lambda p: p != "")
    out = F.when(ends & ~clean & (F.size(found) > 0), pieces).otherwise(F.array(t))
    rest = [c for c in words.columns if c != "text"]
    return words.select(*rest, F.posexplode(out).alias("parte", "text"))


def is_contaminated(t: Column) -> Column:
    """K9: holds an amount without being one (two of them, or letters around)."""
    n = F.size(F.regexp_extract_all(t, F.lit(f"({RE_AMOUNT})"), F.lit(1)))
    return ~t.rlike(f"^{RE_AMOUNT}$") & ((n > 1) | ((n > 0) & t.rlike(r"\p{L}")))


def cid_fraction(words: DataFrame) -> DataFrame:
    """K8."""
    return words.groupBy("doc_id").agg(F.avg(
        F.when(F.col("text").contains(CID), 1.0).otherwise(0.0)).alias("fraccion"))


def contaminated(words: DataFrame) -> DataFrame:
    return words.filter(is_contaminated(F.col("text")))


def _overlap(words: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE, "_t").orderBy("x0", "pos")
    nxt = F.lead("x0").over(w)
    return words.withColumn("_t", F.bround("top")).withColumn(
        "traslapa", F.coalesce(nxt < F.col("x1") - OVERLAP, F.lit(False))).drop("_t")


def overlapping(words: DataFrame) -> DataFrame:
    """Words stepped on by the next one of their row, per page."""
    return _overlap(words).groupBy(*PAGE).agg(F.count_if("traslapa").alias("traslapadas"))


def first_pages(words: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages of each document.

    Distinct pages are ranked (a group limit under the shuffle), then joined back.
    """
    pages = words.select(*PAGE).distinct()
    top = pages.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    return words.join(top.filter(F.col("_r") <= n).select(*PAGE), PAGE, "left_semi")


# Named signals, each one aggregate over words flagged by ``_overlap``.
def default_signals() -> dict[str, Column]:
    cid = F.col("text").contains(CID)
    return {
        "tokens_contaminados": F.count_if(is_contaminated(F.col("text"))),
        "palabras_traslapadas": F.count_if("traslapa"),
        "palabras": F.count(F.lit(1)),
        "fraccion_traslape": F.count_if("traslapa") / F.count(F.lit(1)),
        "fraccion_cid": F.count_if(cid) / F.count(F.lit(1)),
    }


def signals(words: DataFrame, n: int | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Every signal in one aggregate, over all pages or the first ``n`` of each document;
    ``extra`` adds named ones (U2)."""
    every = {**default_signals(), **(extra or {})}
    return _overlap(words if n is None else first_pages(words, n)).groupBy("doc_id").agg(
        *[c.alias(k) for k, c in every.items()])


def decide(sig: DataFrame, ocr_available: bool = True, overlap_limit: float = 0.02,
           cid_limit: float = 0.5) -> DataFrame:
    """How to read each document, and why. The glyph map is judged first."""
    f = F.col
    cid = f("fraccion_cid") >= cid_limit
    pct = F.format_string("%.1f%% de la muestra viene en CID sin mapa ToUnicode", f("fraccion_cid") * 100)
    ocr = "ocr" if ocr_available else "pdf_text"
    tail = (": el PDF no trae la tabla que traduce glifos a letras, asi que se relee por OCR"
            if ocr_available else " y pedia OCR, pero no esta instalado: el documento va a salir ilegible")
    dirty, over = f("tokens_contaminados") > 0, f("fraccion_traslape") > overlap_limit
    return sig.select(
        "doc_id",
        F.when(cid, ocr).when(dirty | over, "pdf_chars").otherwise("pdf_text").alias("estrategia"),
        F.when(cid, F.concat(pct, F.lit(tail)))
        .when(dirty, F.format_string("%d token(s) contaminado(s): una sola palabra mezcla glifos de "
                                     "dos corridas distintas", "tokens_contaminados"))
        .when(over, F.format_string("%.3f de las palabras se traslapan: hay texto encimado",
                                    "fraccion_traslape"))
        .otherwise("texto nativo limpio en la muestra").alias("motivo"))


def cid_pages(words: DataFrame) -> DataFrame:
    """K13."""
    return (words.groupBy(*PAGE).agg(F.count_if(F.col("text").contains(CID)).alias("tokens"))
            .filter("tokens > 0"))


def reread_cells(cells: DataFrame, second: DataFrame) -> DataFrame:
    """What the second reading holds at an unreadable cell, first in page order.

    ``cells``: doc_id, page, cell, top, x_min, x_max. The band predicates are applied inside
    the page equi-join, so the pairs of a page are the only candidates.
    """
    s = second.filter(F.col("text").rlike(RE_LOOKS_AMOUNT)).select(
        *PAGE, F.col("pos").alias("_p"), F.col("top").alias("_t"), F.col("x1").alias("_x"), "text")
    j = cells.join(s, PAGE).filter(
        (F.abs(F.col("_t") - F.col("top")) <= BAND)
        & F.col("_x").between(F.col("x_min") - EDGE, F.col("x_max") + EDGE))
    g = j.groupBy(*PAGE, "cell").agg(F.min_by("text", "_p").alias("leido"))
    return g.withColumn("clase", reread_class(F.col("leido")))


def reread_cid(words: DataFrame, second: DataFrame) -> DataFrame:
    """CID tokens whose place the second reading shows legible."""
    bad = words.filter(F.col("text").contains(CID))
    s = second.filter(~F.col("text").contains(CID) & (F.trim("text") != "")).select(
        *PAGE, F.col("top").alias("_t"), F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    return bad.join(s, (bad.doc_id == s.doc_id) & (bad.page == s.page)
                    & (F.abs(s["_t"] - bad.top) <= BAND)
                    & (s["_b"] >= bad.x0) & (bad.x1 >= s["_a"]), "left_semi")


def reread_summary(cells: DataFrame, matched: DataFrame) -> DataFrame:
    """Pages, unreadable, recovered, truncated and the sentence that says so."""
    j = cells.join(matched.select(*PAGE, "cell", "clase"), [*PAGE, "cell"], "left")
    g = j.groupBy("doc_id").agg(
        F.count_distinct("page").alias("paginas"), F.count(F.lit(1)).alias("ilegibles"),
        F.count_if(F.col("clase") == "recuperado").alias("recuperados"),
        F.count_if(F.col("clase") == "truncado").alias("truncados"))
    text = F.concat(
        F.format_string("%d pagina(s) reintentadas por OCR; %d de %d datos recuperados",
                        "paginas", "recuperados", "ilegibles"),
        F.when(F.col("truncados") > 0, F.format_string(
            "; %d celdas venian truncadas en la propia pagina y no se aceptaron", "truncados"))
        .otherwise(""))
    return g.withColumn("motivo", text)
