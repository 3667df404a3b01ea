"""Layout: words to lines, columns, table region, headers and cells.

Geometry is local to a printed page, so windows are keyed by (doc_id, page) and hold the
words of one page; joins between words and columns always carry that key (or ``doc_id`` for
a document layout of at most some twenty columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import AMOUNT_DIALECTS, RE_SIGNED_AMOUNT, field_by_priority, is_amount, is_dotted, normalize
from cotejo.operators.skew import by_page, join_small
from cotejo.session import join_grown, stage

PAGE = ["doc_id", "page"]
LINE = ["doc_id", "page", "line"]
c = F.col
# Fixed geometry, in points.
LINE_SLACK, TOL, MIN_SUPPORT, MIN_ZONE = 2.5, 3.0, 3, 5
PAD, FAR, LABEL_GAP = 6.0, 40.0, 8.0
MAX_GAP_LINES, MAX_HEADER, PITCH = 8, 4, 1.3


def amounts(df: DataFrame) -> Column:
    """Whether a word is an amount: as ``lines`` marked it, else from its text."""
    return c("es_monto") if "es_monto" in df.columns else is_amount(c("text"))


def meet(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Words or lines with what is known of their page: a page has one row of ``small``, so a hash of those suffices and no word is sorted."""
    return rows.join(small.hint("shuffle_hash"), PAGE, how)


def ordered_text(order: list[str], text: str = "text", sep: str = " ") -> Column:
    """Words of one group joined in order; groups are lines or cells, never documents."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_tx"))))
    return F.array_join(F.transform(packed, lambda s: s["_tx"]), sep)


# --- L1, L2 -----------------------------------------------------------------------------
def lines(words: DataFrame, slack: float = LINE_SLACK) -> DataFrame:
    """L1: words plus line number, line box, ``abre_linea`` (first of its line) and ``es_monto`` (an amount).

    In the order of their tops, a word opens a line when its centre is below everything seen so far on the page. That is
    what looking back over the latest open lines gives: a line opens below all earlier ones, so its bottom is the
    lowest, and whatever lies above that bottom lies inside the latest line, which a look-back asks first. Lines that
    begin at the same height are numbered from the left.
    """
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "pos")
    floor = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = floor.isNull() | ((c("top") + c("bottom")) / 2 > floor + slack)
    j = words.withColumn("_o", F.when(opens, 1).otherwise(0))
    j = j.withColumn("line", (F.sum("_o").over(w) - 1).cast("bigint")).drop("_o")
    box = Window.partitionBy(*LINE)
    j = j.withColumn("ltop", F.min("top").over(box)).withColumn("lbottom", F.max("bottom").over(box)).withColumn(
        "_first", F.min(F.struct("x0", "pos")).over(box))
    place = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("ltop", "_first.x0", "line"))
    return j.withColumn("line", (place - 1).cast("bigint")).withColumn("abre_linea", c("_first.pos") == c("pos")).drop("_first").withColumn("es_monto", is_amount(c("text")))


def clusters(df: DataFrame, keys: list[str], value: str, tol: float, name: str = "grupo") -> DataFrame:
    """L2: one-dimensional clusters, cut where the gap to the previous value exceeds ``tol``."""
    w = Window.partitionBy(*keys).orderBy(value)
    cut = F.when(c(value) - F.lag(value).over(w) > tol, 1).otherwise(0)
    j = df.withColumn("_c", cut)
    return j.withColumn(name, F.sum("_c").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_c")


# --- L3-L8: columns -----------------------------------------------------------------------
def account_zone(lined: DataFrame, tol: float = TOL) -> DataFrame:
    """L3: where the lines of a page open, if at least five open at the same place."""
    first = clusters(lined.filter("abre_linea").select(*PAGE, "x0", "x1"), PAGE, "x0", tol)
    best = first.groupBy(*PAGE, "grupo").agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("lo"), F.max("x0").alias("hi"))
    best = best.filter(c("n") >= MIN_ZONE).groupBy(*PAGE).agg(
        F.max_by(F.struct("lo", "hi"), F.struct(c("n"), -c("grupo"))).alias("b"))
    j = meet(first, best).filter(c("x0").between(c("b.lo") - tol, c("b.hi") + tol))
    return j.groupBy(*PAGE).agg(F.min("x0").alias("z0"), F.max("x1").alias("z1"))


def candidates(lined: DataFrame, tol: float = TOL, support: int = MIN_SUPPORT) -> DataFrame:
    """L4: amounts stacked on their right edge, texts on their left one."""
    z = account_zone(lined, tol)
    # Aligned words share their place, so counting places first leaves a few rows per page.
    amount = amounts(lined)
    j = lined.groupBy(*PAGE, "x0", "x1", amount.alias("_a"), F.when(amount, is_dotted(c("text"))).alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    j = meet(j, z, "left")
    inside = F.coalesce(c("x0").between(c("z0") - tol, c("z1") + tol), F.lit(False))
    j = j.select(*PAGE, "x0", "x1", "n", F.when(c("_a") & ~(inside & c("_d")), "right").otherwise("left").alias("align"))
    j = j.withColumn("edge", F.when(c("align") == "right", c("x1")).otherwise(c("x0")))
    key = [*PAGE, "align"]
    j = j.groupBy(*key, "edge").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    g = clusters(j, key, "edge", tol)
    peaks = g.groupBy(*key, "grupo").agg(
        F.sum("n").alias("support"), F.round(F.sum(c("edge") * c("n")) / F.sum("n"), 6).alias("anchor")
    ).filter(c("support") >= support)
    m = join_grown(peaks, j, key).filter(F.abs(c("edge") - c("anchor")) <= tol * 2)
    found = m.groupBy(*key, "grupo", "support", "anchor").agg(
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"))
    w = Window.partitionBy(*PAGE)
    ranked = F.sort_array(F.collect_list("support").over(w))  # the columns of one page
    median = F.element_at(ranked, F.floor(F.size(ranked) / 2).cast("int") + 1)
    return (found.withColumn("_m", median)
            .filter(c("support") >= F.greatest(F.lit(float(support)), c("_m") * 0.25)).drop("_m", "grupo"))


def merge_overlapping(cands: DataFrame) -> DataFrame:
    """Candidates whose extents overlap become one; the stronger alignment wins."""
    w = Window.partitionBy(*PAGE).orderBy("x_min", "x_max", "align")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    j = cands.withColumn("_n", F.when(c("x_min") < F.max("x_max").over(prior), 0).otherwise(1))
    j = j.withColumn("_g", F.sum("_n").over(w))
    inner = Window.partitionBy(*PAGE, "_g").orderBy("x_min", "x_max", "align")
    before = F.sum("support").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("_strong", before.isNull() | (c("support") > before))
    return j.groupBy(*PAGE, "_g").agg(
        F.max_by("align", F.when(c("_strong"), F.struct("x_min", "x_max", "align"))).alias("align"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.sum("support").alias("support")).drop("_g")


def numbered(cols: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("x_min", "x_max", "align")
    return cols.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def detect(cands: DataFrame) -> DataFrame:
    """L6."""
    return numbered(merge_overlapping(cands))


def amount_columns(cands: DataFrame) -> DataFrame:
    """Amount columns and their anchors, not merged with texts printed over them."""
    return numbered(cands.filter("align = 'right'"))


def text_and_amounts(cands: DataFrame) -> DataFrame:
    """Amount columns, plus detected columns that do not share a right edge with one."""
    amounts = cands.filter("align = 'right'").select(*PAGE, "align", "x_min", "x_max", "support")
    edges = amounts.select(*PAGE, F.bround("x_max", 1).alias("_e")).distinct()
    texts = join_grown(merge_overlapping(cands).withColumn("_e", F.bround("x_max", 1)), edges, [*PAGE, "_e"], "left_anti").select(
        *PAGE, "align", "x_min", "x_max", "support")
    return numbered(texts.unionByName(amounts))


# --- L9, L10: region ------------------------------------------------------------------------
def line_table(lined: DataFrame) -> DataFrame:
    """One row per line: box, number of words, whether it holds an amount."""
    return lined.groupBy(*LINE, "ltop", "lbottom").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(amounts(lined)).alias("con_monto"))


def table_region(lined: DataFrame, cands: DataFrame, tol: float = TOL, min_columns: int = 2, table: DataFrame | None = None) -> DataFrame:
    """The longest block of lines that touch two amount columns, plus its header lines. ``table`` is ``line_table(lined)``, if at hand."""
    anchors = numbered(cands.filter("align = 'right'")).select(*PAGE, "idx", "anchor")
    anchors = anchors.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("idx", "anchor"))).alias("_as"))  # the columns of one page
    nearest = F.get(F.filter("_as", lambda a: F.abs(c("x1") - a["anchor"]) <= tol * 2), F.lit(0))["idx"]
    hits = (meet(lined.filter(amounts(lined)).select(*LINE, "x1"), anchors).select(*LINE, nearest.alias("idx"))
            .groupBy(*LINE).agg(F.count_distinct("idx").alias("k")).filter(c("k") >= min_columns))
    table = line_table(lined) if table is None else table
    w = Window.partitionBy(*PAGE).orderBy("line")
    head = (c("n") >= 2) & ~c("con_monto")
    up = lambda i: F.coalesce(F.lag(head, i).over(w), F.lit(False))
    table = table.withColumn("_t1", F.lag("ltop", 1).over(w)).withColumn("_t2", F.lag("ltop", 2).over(w))
    table = table.withColumn("_start", F.when(up(1) & up(2), c("_t2")).when(up(1), c("_t1")).otherwise(c("ltop")))
    data = join_grown(table, hits.select(*LINE), LINE, "left_semi")
    d = data.withColumn("_b", F.when(c("line") - F.lag("line").over(w) <= MAX_GAP_LINES + 1, 0).otherwise(1))
    d = d.withColumn("_g", F.sum("_b").over(w))
    blocks = d.groupBy(*PAGE, "_g").agg(
        F.count(F.lit(1)).alias("len"), F.min_by("_start", "line").alias("top"),
        F.min_by("ltop", "line").alias("_first"), F.max_by("lbottom", "line").alias("bottom"))
    return blocks.groupBy(*PAGE).agg(F.max_by(
        F.struct("top", "bottom"), F.struct(c("len"), c("bottom") - c("_first"), -c("_g"))).alias("r")
    ).select(*PAGE, "r.top", "r.bottom")


def within_region(lined: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose centre lies in the region; a page without region keeps all."""
    r = regions.select(*PAGE, c("top").alias("_rt"), c("bottom").alias("_rb"))
    mid = (c("ltop") + c("lbottom")) / 2
    return meet(lined, r, "left").filter(c("_rt").isNull() | mid.between(c("_rt"), c("_rb"))).drop("_rt", "_rb")


def of_lines(lined: DataFrame, chosen: DataFrame) -> DataFrame:
    """The words of a few chosen lines of each page, with what ``chosen`` says about them."""
    more = [k for k in chosen.columns if k not in LINE]
    at = chosen.groupBy(*PAGE).agg(F.collect_list(F.struct("line", *more)).alias("_hs"))
    at = at.withColumn("_ls", F.transform("_hs", lambda h: h["line"]))
    j = meet(lined, at).filter(F.array_contains("_ls", c("line")))
    j = j.withColumn("_h", F.explode(F.filter("_hs", lambda h: h["line"] == c("line"))))
    return j.select(*lined.columns, *[c(f"_h.{k}").alias(k) for k in more])


# --- L11-L14: headers -------------------------------------------------------------------------
def header_lines(lined: DataFrame, regions: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """The header block of each page, plus (``solo_grupo``) the line above it when tight.

    Labels count while they are set tighter than the data: gap <= 1.3 x median data pitch. ``table`` is ``line_table(lined)``, if at hand.
    """
    t = line_table(lined) if table is None else table
    w = Window.partitionBy(*PAGE).orderBy("line")
    r = regions.select(*PAGE, c("top").alias("_rt"), c("bottom").alias("_rb"))
    reg = meet(t, r).filter(((c("ltop") + c("lbottom")) / 2).between(c("_rt"), c("_rb"))).drop("_rt", "_rb")
    reg = reg.withColumn("k", F.row_number().over(w)).withColumn(
        "_seen", F.sum(c("con_monto").cast("int")).over(w))
    count = reg.groupBy(*PAGE).agg(F.count_if(c("_seen") == 0).alias("nh"))
    reg = meet(reg, count.filter("nh > 0"))
    gap = reg.withColumn("_p", F.lead("ltop").over(w) - c("ltop")).filter(
        (c("k") > F.least("nh", F.lit(MAX_HEADER))) & c("_p").isNotNull())
    limit = gap.groupBy(*PAGE).agg(F.when(F.count(F.lit(1)) >= 2, F.percentile("_p", 0.5) * PITCH).alias("lim"))
    head = reg.filter((c("_seen") == 0) & (c("k") > c("nh") - MAX_HEADER))
    head = meet(head, limit, "left")
    back = Window.partitionBy(*PAGE).orderBy(c("line").desc())
    tight = (F.lag("ltop").over(back) - c("ltop") <= c("lim"))
    head = head.withColumn("_ok", (c("k") == c("nh")) | F.coalesce(tight, F.lit(False)))
    head = head.withColumn("_all", F.min(c("_ok").cast("int")).over(back)).filter("_all = 1")
    block = head.select(*LINE, F.lit(False).alias("solo_grupo"))
    # The line above only serves for grouping; its limit comes from every line below the block.
    ends = head.groupBy(*PAGE).agg(F.min("line").alias("_f"), F.max("line").alias("_e"),
                                   F.min_by("ltop", "line").alias("_ft"))
    below = meet(t, ends).filter(c("line") > c("_e"))
    below = below.withColumn("_p", F.lead("ltop").over(w) - c("ltop"))
    lim2 = below.groupBy(*PAGE).agg(F.when(F.count("_p") >= 2, F.percentile("_p", 0.5) * PITCH).alias("lim2"))
    above = meet(meet(t, ends), lim2).filter(
        (c("line") == c("_f") - 1) & (c("_ft") - c("ltop") <= c("lim2")))
    return block.unionByName(above.select(*LINE, F.lit(True).alias("solo_grupo")))


def header_words(lined: DataFrame, heads: DataFrame) -> DataFrame:
    """Header words with their group prefix; group labels themselves are left out.

    A label that overlaps two or more words of the next header line prefixes them.
    """
    w = stage(of_lines(lined, heads.select(*LINE, "solo_grupo")).select(
        *LINE, "pos", "text", "x0", "x1", "top", "solo_grupo", amounts(lined).alias("_a")))
    up = w.filter(~c("_a")).select(
        *PAGE, (c("line") + 1).alias("line"), c("pos").alias("_gp"), c("text").alias("_gt"),
        c("x0").alias("_g0"), c("x1").alias("_g1"))
    over = join_grown(w.select(*LINE, "pos", "x0", "x1"), up, LINE).filter(
        (c("x0") < c("_g1")) & (c("_g0") < c("x1")))
    groups = over.groupBy(*PAGE, "_gp").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2")
    pre = join_grown(over, groups, [*PAGE, "_gp"]).groupBy(*LINE, "pos").agg(F.max_by("_gt", "_g0").alias("prefijo"))
    named = join_grown(w.filter(~c("solo_grupo")), groups.select(*PAGE, c("_gp").alias("pos")), [*PAGE, "pos"], "left_anti")
    j = join_grown(named, pre, [*LINE, "pos"], "left")
    return j.select(*LINE, "pos", "x0", "x1", "top",
                    F.concat_ws(" ", "prefijo", "text").alias("text"))


def _distance(a: Column, lo: Column, hi: Column) -> Column:
    return F.when(a.between(lo - PAD, hi + PAD), F.lit(0.0)).otherwise(
        F.least(F.abs(a - lo), F.abs(a - hi)))


def assign_headers(words: DataFrame, cols: DataFrame) -> DataFrame:
    """Each header word to the nearest column (< 40 pt), narrower first; text per column."""
    mid = (c("x0") + c("x1")) / 2
    page = cols.groupBy(*PAGE).agg(F.collect_list(F.struct("idx", "x_min", "x_max")).alias("_cols"))
    near = F.array_min(F.transform("_cols", lambda k: F.struct(
        _distance(mid, k["x_min"], k["x_max"]).alias("_d"), (k["x_max"] - k["x_min"]).alias("_w"), k["idx"].alias("idx"))))
    best = meet(words, page).withColumn("b", F.explode(F.array(near))).filter(c("b._d") < FAR)
    heads = best.groupBy(*PAGE, c("b.idx").alias("idx")).agg(ordered_text(["top", "x0"]).alias("header"))
    return join_grown(cols, heads, [*PAGE, "idx"], "left").na.fill("", ["header"])


def document_layout(cols: DataFrame, pages: DataFrame) -> DataFrame:
    """The sample page with most columns is the base; pages with as many widen it and
    fill its empty headers; other pages are ignored. ``pages`` names the sample."""
    s = meet(cols, pages, "left_semi")
    size = s.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("k"))
    base = size.groupBy("doc_id").agg(F.max_by("page", F.struct(c("k"), -c("page"))).alias("_b"),
                                      F.max("k").alias("_k"))
    same = meet(s, size).join(base, "doc_id").filter(c("k") == c("_k"))
    own = c("page") == c("_b")
    rank = F.struct(F.when(own, 0).otherwise(1), c("page"))
    return same.groupBy("doc_id", "idx").agg(
        F.max(F.when(own, c("align"))).alias("align"), F.min("x_min").alias("x_min"),
        F.max("x_max").alias("x_max"), F.sum("support").alias("support"),
        F.coalesce(F.min_by("header", F.when(c("header") != "", rank)), F.lit("")).alias("header"))


# --- L15-L18: cells ------------------------------------------------------------------------------
def edge_limit(layout: DataFrame) -> DataFrame:
    """Half the smallest gap between amount edges of a document, 40 with a single column."""
    w = Window.partitionBy("doc_id").orderBy("x_max")  # the amount columns of one layout
    gap = layout.filter("align = 'right'").withColumn("_g", c("x_max") - F.lag("x_max").over(w))
    return gap.groupBy("doc_id").agg(F.coalesce(F.min("_g") / 2, F.lit(FAR)).alias("limite"))


def place_words(words: DataFrame, layout: DataFrame, text_in_amounts: bool = False,
                amount: Column | None = None) -> DataFrame:
    """L15 + L16: the column of each word.

    Amounts go by right edge within the limit; texts by their centre, 0 inside, < 40 outside.
    ``_align`` and ``_borde`` tell how that column is set and where it ends.
    """
    amt = amounts(words) if amount is None else amount
    lay = layout.select("doc_id", "idx", "align", "x_min", "x_max").join(edge_limit(layout), "doc_id", "left")
    has = layout.groupBy("doc_id").agg(
        F.bool_or(c("align") == "right").alias("hay_montos"), F.bool_or(c("align") != "right").alias("hay_textos"))
    # A layout is about twenty rows per document: packed once, it goes to the pages, and the words meet it there.
    col = F.struct("idx", "align", "x_min", "x_max")
    packed = lambda cond: F.sort_array(F.collect_list(F.when(cond, col)))
    text = F.when(c("hay_textos"), c("align") != "right").otherwise(F.lit(True))
    pack = lay.join(has, "doc_id").groupBy("doc_id", "hay_montos").agg(
        packed(c("align") == "right").alias("_right"), packed(text).alias("_left"), F.max("limite").alias("limite"),
        *([F.sort_array(F.collect_list(col)).alias("_cols")] if text_in_amounts else []))
    pages = join_small(words.select(*PAGE).distinct(), pack, "doc_id", by_page())
    j = meet(words.withColumn("_a", amt), pages)
    mid = (c("x0") + c("x1")) / 2
    found = lambda d, k: F.struct(d.alias("d"), k["idx"].alias("idx"), k["align"].alias("align"), k["x_max"].alias("edge"))
    by_edge = F.array_min(F.transform("_right", lambda k: found(F.abs(c("x1") - k["x_max"]), k)))
    by_mid = F.array_min(F.transform("_left", lambda k: found(_distance(mid, k["x_min"], k["x_max"]), k)))
    number = c("_a") & c("hay_montos")
    placed = F.when(number, by_edge).otherwise(by_mid)
    if text_in_amounts:
        holds = F.filter("_cols", lambda k: mid.between(k["x_min"] - PAD, k["x_max"] + PAD))
        narrow = F.array_min(F.transform(holds, lambda k: found(k["x_max"] - k["x_min"], k)))
        orphan = ~number & ~F.exists("_left", lambda k: mid.between(k["x_min"] - PAD, k["x_max"] + PAD)) & (F.size(holds) > 0)
        placed = F.when(orphan, F.struct(F.lit(-1.0).alias("d"), narrow["idx"].alias("idx"), narrow["align"].alias("align"),
                                         narrow["edge"].alias("edge"))).otherwise(placed)
    # exploded, so that the nearest is sought once, whoever asks for parts of it
    j = j.withColumn("_p", F.explode(F.array(placed)))
    near = c("_p.d") < F.when(number, c("limite")).otherwise(F.lit(FAR))
    keep = [k for k in words.columns if k != "idx"]
    return j.select(*keep, F.when(near, c("_p.idx")).alias("idx"), F.when(near, c("_p.align")).alias("_align"), F.when(near, c("_p.edge")).alias("_borde"))


def cells(placed: DataFrame, layout: DataFrame) -> DataFrame:
    """Texts joined by x; an amount column keeps the one word closest to its edge."""
    j = placed.filter(c("idx").isNotNull())
    if "_borde" not in j.columns:
        j = join_small(j, layout.select("doc_id", "idx", c("align").alias("_align"), c("x_max").alias("_borde")), ["doc_id", "idx"], by_page())
    right = F.coalesce(c("_align") == "right", F.lit(False))
    # The words of one cell in order: one sort, and no row leaves the page it is dealt out by.
    w = Window.partitionBy(*LINE, "idx").orderBy(F.when(right, F.abs(c("x1") - c("_borde"))), "x0", "pos")
    every = F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = j.select(*LINE, "idx", "text", right.alias("_r"), F.row_number().over(w).alias("_n"), every.alias("_all")).filter("_n = 1")
    return first.select(*LINE, "idx", F.when(c("_r"), c("text")).otherwise(F.array_join("_all", " ")).alias("texto"))


def rows_of_cells(cell_table: DataFrame) -> DataFrame:
    """One row per line with a map column -> text."""
    return cell_table.groupBy(*LINE).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("idx", "texto")))).alias("celdas"))


# --- L19-L22: statement headers ---------------------------------------------------------------
def widened(cols: DataFrame, keys: list[str]) -> DataFrame:
    """Text columns reach to the middle of the gap on each side; a lone one is unbounded."""
    w = Window.partitionBy(*keys).orderBy("x_min")
    inf = F.lit(float("inf"))
    lo = F.coalesce((F.lag("x_max").over(w) + c("x_min")) / 2, -inf)
    hi = F.coalesce((c("x_max") + F.lead("x_min").over(w)) / 2, inf)
    n = F.sum((c("align") != "right").cast("int")).over(Window.partitionBy(*keys))
    j = cols.select("*", lo.alias("_lo"), hi.alias("_hi"), n.alias("_n")).filter("align <> 'right'")
    return j.withColumn("x_min", F.when(c("_n") == 1, -inf).otherwise(c("_lo"))).withColumn(
        "x_max", F.when(c("_n") == 1, inf).otherwise(c("_hi"))).drop("_lo", "_hi", "_n")


def labels(lined: DataFrame, gap: float = LABEL_GAP) -> DataFrame:
    """Words of a line closer than ``gap`` make one label."""
    w = Window.partitionBy(*LINE).orderBy("x0", "pos")
    j = lined.withColumn("_n", F.when(c("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0))
    j = j.withColumn("_g", F.sum("_n").over(w))
    return j.groupBy(*LINE, "_g").agg(
        ordered_text(["x0", "pos"]).alias("etiqueta"), F.min("x0").alias("x_min"),
        F.max("x1").alias("x_max")).withColumnRenamed("_g", "n_etiqueta")


def label_fields(label_table: DataFrame, vocab: DataFrame) -> DataFrame:
    """The field of each label; a label with none takes that of the label above it.

    Labels that name a field are few and written once; only their lines and those below them are read further.
    """
    named = stage(field_by_priority(label_table, vocab))
    keys = label_table.columns
    near = named.select(*LINE).union(named.select(*PAGE, c("line") + 1)).distinct()
    own = label_table.join(near, LINE, "left_semi").join(named.select(*LINE, "n_etiqueta", "campo"), [*LINE, "n_etiqueta"], "left")
    above = named.select(*PAGE, (c("line") + 1).alias("line"), c("n_etiqueta").alias("_an"), c("x_min").alias("_a0"),
                         c("x_max").alias("_a1"), c("campo").alias("_ac"), c("etiqueta").alias("_at"))
    lent = (own.filter(c("campo").isNull()).join(above, LINE)
            .filter((c("_a1") >= c("x_min")) & (c("x_max") >= c("_a0")))
            .groupBy(*LINE, "n_etiqueta").agg(F.min_by(F.struct("_ac", "_at"), "_an").alias("p")))
    j = own.join(lent, [*LINE, "n_etiqueta"], "left")
    return j.select(*[k for k in keys if k != "etiqueta"],
                    F.concat_ws(" ", "p._at", "etiqueta").alias("etiqueta"),
                    F.coalesce("campo", "p._ac").alias("campo")).filter(c("campo").isNotNull())


def statement_headers(lined: DataFrame, fields: DataFrame, kind: str = "tabla") -> DataFrame:
    """Lines that serve as a header of the moves table (or of the accounts table).

    The fields of a line are a handful of names, so the collected set is bounded.
    """
    amount = F.trim("text").rlike(RE_SIGNED_AMOUNT)
    free = lined.groupBy(*LINE).agg(F.bool_or(amount).alias("m")).filter(~c("m")).select(*LINE)
    s = fields.groupBy(*LINE).agg(F.collect_set("campo").alias("s"))
    has = lambda *n: F.arrays_overlap("s", F.array(*[F.lit(x) for x in n]))
    if kind == "tabla":
        ok = has("fecha") & has("saldo") & has("deposito", "retiro")
    else:
        ok = (F.size("s") >= 3) & has("producto", "num_cuenta") & has("saldo_inicial", "saldo_corte")
    return s.filter(ok).select(*LINE).join(free, LINE, "left_semi")


def first_header(heads: DataFrame) -> DataFrame:
    """The first header of each document, in reading order."""
    return heads.groupBy("doc_id").agg(F.min(F.struct("page", "line")).alias("h")).select("doc_id", "h.*")


# --- L23, L24 -----------------------------------------------------------------------------------
def fingerprint(layout: DataFrame, shapes: DataFrame) -> DataFrame:
    """Header tokens, number of amount columns and account shape, hashed."""
    tok = layout.select("doc_id", F.explode(F.split(normalize(c("header")), " ")).alias("t")).filter("t <> ''")
    toks = tok.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("t")), "|").alias("tk"))
    n = layout.groupBy("doc_id").agg(F.count_if(c("align") == "right").alias("n"))
    j = n.join(toks, "doc_id", "left").join(shapes, "doc_id", "left")
    raw = F.concat_ws("#", F.coalesce("tk", F.lit("")), c("n").cast("string"), F.coalesce("forma", F.lit("?")))
    return j.select("doc_id", F.substring(F.sha2(raw, 256), 1, 16).alias("huella"))


def header_like(lined: DataFrame, vocab: DataFrame, kind: str = "auxiliar") -> DataFrame:
    """Lines without amounts whose words name at least two fields."""
    t = F.trim("text")
    free = lined.groupBy(*LINE).agg(F.bool_or(t.rlike(AMOUNT_DIALECTS[kind])).alias("m")).filter(~c("m"))
    tok = lined.select(*LINE, F.explode(F.split(normalize(c("text")), " ")).alias("sinonimo"))
    named = tok.join(vocab.select("campo", "sinonimo"), "sinonimo").groupBy(*LINE).agg(
        F.count_distinct("campo").alias("k")).filter("k >= 2")
    return join_grown(free.select(*LINE), named.select(*LINE), LINE, "left_semi")


def relabel(layout: DataFrame, lined: DataFrame, heads: DataFrame) -> DataFrame:
    """Headers taken from header-like lines anywhere in the sample, in top order."""
    named = stage(of_lines(lined, heads.select(*LINE)))
    w = place_words(named, layout)
    tops = named.select(*LINE, "ltop").distinct()
    cell = join_grown(cells(w, layout), tops, LINE)
    new = cell.groupBy("doc_id", "idx").agg(ordered_text(["ltop", "texto"], "texto").alias("nuevo"))
    j = layout.join(new, ["doc_id", "idx"], "left")
    return j.withColumn("header", F.coalesce(F.nullif(F.trim("nuevo"), F.lit("")), "header")).drop("nuevo")
