"""Named queries of layout and mapping, on the printed pages of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.functions.accounts import number_shape
from cotejo.operators import layout as ly
from cotejo.operators import mapping as mp

from cotejo.plans.queries_text import norm_sql
from cotejo.plans.registry import query, view
from cotejo.session import stage, stage_by

c = F.col
_memo: dict[tuple, object] = {}


def stored(name, staged=False):
    """A stage table, or a tuple of them, written once per corpus; ``staged``: the function has written it."""
    def wrap(fn):
        def get(t):
            key = (t.spark.sparkContext.applicationId, t.folder, name)
            if key not in _memo:
                made = fn(t)
                _memo[key] = made if isinstance(made, tuple) or staged else stage(made)
            return _memo[key]
        return get
    return wrap


def parts_of(words):
    """In how many parts to deal words out: about a million in each, and as many parts as a shuffle has at least."""
    return max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.count() // 1_000_000 + 1)


def stored_lines(words):
    """The words of every page with their lines, dealt out by page."""
    parts = parts_of(words)
    return stage_by(ly.lines(words.repartition(parts, *ly.PAGE)), ly.PAGE, parts)


def read_tables(words):
    """Words to ``(lines, layout, cells)``, each a stage table."""
    lin = stored_lines(words)
    table = stage(ly.line_table(lin))
    zone = stage(ly.table_region(lin, ly.candidates(lin), table=table))
    inside = ly.within_region(lin, zone)
    cols = stage(ly.text_and_amounts(stage(ly.candidates(inside))))
    named = stage(ly.assign_headers(ly.header_words(lin, ly.header_lines(lin, zone, table)), cols))
    lay = stage(ly.document_layout(named, table.select("doc_id", "page").distinct()))
    return lin, lay, stage(ly.cells(ly.place_words(inside, lay), lay))


@stored("lined", staged=True)
def lined(t):
    return stored_lines(t.words)


@stored("line_rows")
def line_rows(t):
    """One row a line."""
    return ly.line_table(lined(t))


@stored("cands")
def cands(t):
    return ly.candidates(lined(t))


@stored("regions")
def regions(t):
    return ly.table_region(lined(t), cands(t), table=line_rows(t))


@stored("heads")
def heads_of(t):
    return ly.header_lines(lined(t), regions(t), line_rows(t))


@stored("columns")
def columns(t):
    """Labelled columns of every page, measured inside its region."""
    inside = ly.within_region(lined(t), regions(t))
    cols = stage(ly.text_and_amounts(stage(ly.candidates(inside))))
    return ly.assign_headers(ly.header_words(lined(t), heads_of(t)), cols)


def pages_of(t):
    return line_rows(t).select("doc_id", "page").distinct()


@stored("layout")
def layout(t):
    return ly.document_layout(columns(t), pages_of(t))


@stored("celdas")
def cell_table(t):
    inside = ly.within_region(lined(t), regions(t))
    return ly.cells(ly.place_words(inside, layout(t)), layout(t))


# ------------------------------------------------------------------- checking views
view("lin_o", """SELECT *, COALESCE((top + bottom) / 2 > MAX(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, x0, pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2.5, TRUE) AS o FROM words""")
view("lin_n", """SELECT * EXCLUDE (o), COUNT(*) FILTER (WHERE o) OVER (PARTITION BY doc_id, page ORDER BY top, x0, pos) - 1 AS line FROM lin_o""")
view("lin", r"""SELECT *, MIN(top) OVER l AS ltop, MAX(bottom) OVER l AS lbottom, (regexp_matches(text, '\d') AND NOT
  regexp_full_match(text, '\d{3,}(-\d+)*') AND regexp_full_match(text, '[\d.,\-$()%/:]+')) AS am
  FROM lin_n WINDOW l AS (PARTITION BY doc_id, page, line)""")
query("L1_lines", """SELECT doc_id, page, line, COUNT(*) AS n, MIN(ltop) AS ltop, MAX(lbottom) AS lbottom, MIN(pos) AS menor FROM lin GROUP BY ALL""")(
    lambda t: lined(t).groupBy("doc_id", "page", "line").agg(
        F.count(F.lit(1)).alias("n"), F.min("ltop").alias("ltop"), F.max("lbottom").alias("lbottom"), F.min("pos").alias("menor")))
query("L2_clusters", """
g AS (SELECT *, SUM(CASE WHEN d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x1) AS grupo FROM
  (SELECT *, x1 - LAG(x1) OVER (PARTITION BY doc_id, page ORDER BY x1) AS d FROM words))
SELECT doc_id, page, CAST(grupo AS BIGINT) AS grupo, COUNT(*) AS n, MIN(x1) AS desde, MAX(x1) AS hasta FROM g GROUP BY ALL""")(
    lambda t: ly.clusters(t.words, ly.PAGE, "x1", 3.0).groupBy("doc_id", "page", "grupo").agg(
        F.count(F.lit(1)).alias("n"), F.min("x1").alias("desde"), F.max("x1").alias("hasta")))
view("zona_f", "SELECT doc_id, page, line, arg_min(x0, x0 * 1e6 + pos) AS x0, arg_min(x1, x0 * 1e6 + pos) AS x1 FROM lin GROUP BY ALL")
view("zona_g", """SELECT *, SUM(CASE WHEN d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0) AS g FROM
  (SELECT *, x0 - LAG(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) AS d FROM zona_f)""")
view("zona_b", """SELECT * FROM (SELECT doc_id, page, g, COUNT(*) AS n, MIN(x0) AS lo, MAX(x0) AS hi,
  ROW_NUMBER() OVER (PARTITION BY doc_id, page ORDER BY COUNT(*) DESC, g) AS rn FROM zona_g GROUP BY doc_id, page, g) WHERE rn = 1 AND n >= 5""")
view("zona", """SELECT f.doc_id, f.page, MIN(f.x0) AS z0, MAX(f.x1) AS z1 FROM zona_f f JOIN zona_b b ON b.doc_id = f.doc_id
  AND b.page = f.page AND f.x0 BETWEEN lo - 3 AND hi + 3 GROUP BY ALL""")
query("L3_account_zone", "SELECT * FROM zona")(lambda t: ly.account_zone(lined(t)))


def cand_views(p: str, source: str) -> None:
    """L4 to L6 over the word table ``source``; every page of the corpus has its zone."""
    view(f"{p}_w", f"""SELECT doc_id, page, x0, x1, CASE WHEN am THEN 'right' ELSE 'left' END AS align,
      CASE WHEN am THEN x1 ELSE x0 END AS e FROM {source}""")
    view(f"{p}_g", f"""SELECT *, SUM(CASE WHEN d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, align ORDER BY e) AS g FROM
      (SELECT *, e - LAG(e) OVER (PARTITION BY doc_id, page, align ORDER BY e) AS d FROM {p}_w)""")
    view(f"{p}_k", f"SELECT doc_id, page, align, g, COUNT(*) AS support, round(AVG(e), 6) AS anchor FROM {p}_g GROUP BY ALL HAVING COUNT(*) >= 3")
    view(f"{p}_m", f"""SELECT k.doc_id, k.page, k.align, k.support, k.anchor, MIN(x0) AS x_min, MAX(x1) AS x_max FROM {p}_k k JOIN {p}_w w
      ON w.doc_id = k.doc_id AND w.page = k.page AND w.align = k.align AND abs(e - anchor) <= 6 GROUP BY ALL""")
    view(f"{p}_c", f"""SELECT m.* FROM {p}_m m JOIN (SELECT doc_id, page, list_sort(list(support))[COUNT(*) // 2 + 1] AS md FROM {p}_m GROUP BY ALL) q
      ON q.doc_id = m.doc_id AND q.page = m.page WHERE support >= greatest(3, md * 0.25)""")
    view(f"{p}_i", f"""SELECT *, SUM(CASE WHEN pm IS NULL OR x_min >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x_min, x_max, align) AS isla FROM
      (SELECT *, MAX(x_max) OVER (PARTITION BY doc_id, page ORDER BY x_min, x_max, align ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {p}_c)""")
    view(f"{p}_s", f"""SELECT *, COALESCE(support > SUM(support) OVER (PARTITION BY doc_id, page, isla ORDER BY x_min, x_max, align
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fuerte FROM {p}_i""")
    view(f"{p}_u", f"""SELECT doc_id, page, isla, last(align ORDER BY x_min, x_max, align) FILTER (WHERE fuerte) AS align, MIN(x_min) AS x_min,
      MAX(x_max) AS x_max, CAST(SUM(support) AS BIGINT) AS support FROM {p}_s GROUP BY ALL""")


cand_views("cd", "lin")
query("L4_candidates", "SELECT * FROM cd_c")(lambda t: cands(t))
query("L5_merge_overlapping", "SELECT doc_id, page, align, x_min, x_max, support FROM cd_u")(
    lambda t: ly.merge_overlapping(cands(t)))
_IDX = "CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, page ORDER BY x_min, x_max, align) - 1 AS BIGINT) AS idx"
query("L6_detect", f"SELECT doc_id, page, align, x_min, x_max, support, {_IDX} FROM cd_u")(
    lambda t: ly.detect(cands(t)).withColumn("idx", c("idx").cast("bigint")))
query("L7_amount_columns", f"SELECT doc_id, page, align, support, anchor, x_min, x_max, {_IDX} FROM cd_c WHERE align = 'right'")(
    lambda t: ly.amount_columns(cands(t)).withColumn("idx", c("idx").cast("bigint")))


def union_sql(p: str) -> str:
    return f"""SELECT *, {_IDX} FROM (SELECT doc_id, page, align, x_min, x_max, support FROM {p}_c WHERE align = 'right'
      UNION ALL SELECT doc_id, page, align, x_min, x_max, support FROM {p}_u u WHERE NOT EXISTS (SELECT 1 FROM {p}_c k
      WHERE k.align = 'right' AND k.doc_id = u.doc_id AND k.page = u.page AND round_even(k.x_max, 1) = round_even(u.x_max, 1)))"""


query("L8_text_and_amounts", union_sql("cd"))(
    lambda t: ly.text_and_amounts(cands(t)).withColumn("idx", c("idx").cast("bigint")))
view("rg_l", "SELECT doc_id, page, line, ltop, lbottom, COUNT(*) AS n, bool_or(am) AS m FROM lin GROUP BY ALL")
view("rg_h", """SELECT doc_id, page, line FROM (SELECT l.doc_id, l.page, l.line, l.pos, MIN(a.x_min) AS a FROM lin l JOIN cd_c a
  ON a.doc_id = l.doc_id AND a.page = l.page AND a.align = 'right' AND l.am AND abs(l.x1 - a.anchor) <= 6 GROUP BY ALL)
  GROUP BY ALL HAVING COUNT(DISTINCT a) >= 2""")
view("rg_b", """SELECT *, SUM(CASE WHEN d <= 9 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS b FROM
  (SELECT h.*, ltop, lbottom, COALESCE(h.line - LAG(h.line) OVER (PARTITION BY h.doc_id, h.page ORDER BY h.line), 99) AS d
   FROM rg_h h JOIN rg_l l ON l.doc_id = h.doc_id AND l.page = h.page AND l.line = h.line)""")
view("rg_x", """SELECT * FROM (SELECT doc_id, page, b, MIN(line) AS l0, MIN(ltop) AS t0, MAX(lbottom) AS bottom, ROW_NUMBER() OVER (PARTITION BY doc_id, page
  ORDER BY COUNT(*) DESC, MAX(lbottom) - MIN(ltop) DESC, b) AS rn FROM rg_b GROUP BY doc_id, page, b) WHERE rn = 1""")
view("rg", """SELECT x.doc_id, x.page, CASE WHEN p.ltop IS NULL THEN t0 WHEN q.ltop IS NULL THEN p.ltop ELSE q.ltop END AS top, bottom FROM rg_x x
  LEFT JOIN rg_l p ON p.doc_id = x.doc_id AND p.page = x.page AND p.line = l0 - 1 AND p.n >= 2 AND NOT p.m
  LEFT JOIN rg_l q ON q.doc_id = x.doc_id AND q.page = x.page AND q.line = l0 - 2 AND q.n >= 2 AND NOT q.m""")
query("L9_table_region", "SELECT * FROM rg")(lambda t: regions(t))
view("linr", """SELECT l.* FROM lin l LEFT JOIN rg r ON r.doc_id = l.doc_id AND r.page = l.page
  WHERE r.top IS NULL OR (l.ltop + l.lbottom) / 2 BETWEEN r.top AND r.bottom""")
query("L10_lines_within", """SELECT doc_id, page, COUNT(DISTINCT line) AS lineas, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos FROM linr GROUP BY ALL""")(
    lambda t: ly.within_region(lined(t), regions(t)).groupBy("doc_id", "page").agg(
        F.count_distinct("line").alias("lineas"), F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos")))
cand_views("ci", "linr")
# Header block: amount-free lines that open the region, while tighter than the data.
view("hd_l", """SELECT *, ROW_NUMBER() OVER w AS k, SUM(CASE WHEN m THEN 1 ELSE 0 END) OVER w AS seen FROM (SELECT doc_id, page, line, ltop,
  bool_or(am) AS m FROM linr l WHERE EXISTS (SELECT 1 FROM rg r WHERE r.doc_id = l.doc_id AND r.page = l.page) GROUP BY ALL)
  WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)""")
view("hd_n", "SELECT doc_id, page, COUNT(*) FILTER (WHERE seen = 0) AS nh FROM hd_l GROUP BY ALL")
view("hd_p", """SELECT doc_id, page, CASE WHEN COUNT(p) >= 2 THEN quantile_cont(p, 0.5) * 1.3 END AS lim FROM (SELECT l.doc_id, l.page,
  LEAD(ltop) OVER (PARTITION BY l.doc_id, l.page ORDER BY line) - ltop AS p, k, nh FROM hd_l l JOIN hd_n n ON n.doc_id = l.doc_id AND n.page = l.page)
  WHERE k > least(nh, 4) GROUP BY ALL""")
view("hd_t", """SELECT l.doc_id, l.page, l.line, l.ltop, k, nh, k = nh OR COALESCE(LEAD(ltop) OVER (PARTITION BY l.doc_id, l.page ORDER BY line) - ltop <= lim, FALSE) AS ok
  FROM hd_l l JOIN hd_n n ON n.doc_id = l.doc_id AND n.page = l.page LEFT JOIN hd_p p ON p.doc_id = l.doc_id AND p.page = l.page
  WHERE seen = 0 AND k > nh - 4""")
view("hd", """SELECT doc_id, page, line, ltop FROM hd_t a WHERE NOT EXISTS (SELECT 1 FROM hd_t b WHERE b.doc_id = a.doc_id AND b.page = a.page
  AND b.line >= a.line AND NOT b.ok)""")
query("L11_header_lines", "SELECT doc_id, page, line, FALSE AS solo_grupo FROM hd")(
    lambda t: heads_of(t))
# Group labels: an invented banner above two labels of the header line, on some pages.
view("hw_src", """SELECT doc_id, page, line, pos, text, x0, x1, top, ltop FROM lin
  UNION ALL SELECT doc_id, page, line - 1, 7, 'Acumulados', 320.0, 405.0, top - 9, ltop - 9 FROM lin WHERE text = 'Debe' AND page % 2 = 1""")


def _bannered(t):
    w = lined(t)
    b = w.filter("text = 'Debe' AND page % 2 = 1").select(
        *[{"line": c("line") - 1, "pos": F.lit(7).cast("bigint"), "text": F.lit("Acumulados"), "x0": F.lit(320.0),
           "x1": F.lit(405.0), "top": c("top") - 9, "ltop": c("ltop") - 9}.get(k, c(k)).alias(k) for k in w.columns])
    return w.unionByName(b.select([c(k).cast(w.schema[k].dataType).alias(k) for k in w.columns]))


query("L12_grouped_headers", """
SELECT w.doc_id, w.page, w.line, w.pos, CASE WHEN page % 2 = 1 AND text IN ('Debe', 'Haber') THEN 'Acumulados ' || text ELSE text END AS text
FROM hw_src w WHERE text <> 'Acumulados' AND EXISTS (SELECT 1 FROM hd h WHERE h.doc_id = w.doc_id AND h.page = w.page AND h.line = w.line)""")(
    lambda t: ly.header_words(_bannered(t), heads_of(t)).select("doc_id", "page", "line", "pos", "text"))
view("cols0", union_sql("ci"))
view("asg", """SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, page, line, pos ORDER BY d, w, idx) AS rn FROM (SELECT l.doc_id, l.page, l.line, l.pos, l.top, l.x0, l.text, k.idx,
  k.x_max - k.x_min AS w, CASE WHEN (l.x0 + l.x1) / 2 BETWEEN k.x_min - 6 AND k.x_max + 6 THEN 0.0 ELSE least(abs((l.x0 + l.x1) / 2 - k.x_min), abs((l.x0 + l.x1) / 2 - k.x_max)) END AS d
  FROM lin l JOIN hd h ON h.doc_id = l.doc_id AND h.page = l.page AND h.line = l.line JOIN cols0 k ON k.doc_id = l.doc_id AND k.page = l.page)""")
view("cols", """SELECT k.*, COALESCE(header, '') AS header FROM cols0 k LEFT JOIN (SELECT doc_id, page, idx, string_agg(text, ' ' ORDER BY top, x0) AS header
  FROM asg WHERE rn = 1 AND d < 40 GROUP BY ALL) a ON a.doc_id = k.doc_id AND a.page = k.page AND a.idx = k.idx""")
query("L13_assign_headers", "SELECT * FROM cols")(lambda t: columns(t).withColumn("idx", c("idx").cast("bigint")))
view("smp", "SELECT DISTINCT doc_id, page FROM words")
view("lay_n", "SELECT c.doc_id, c.page, COUNT(*) AS k FROM cols c JOIN smp s ON s.doc_id = c.doc_id AND s.page = c.page GROUP BY ALL")
view("lay_b", "SELECT doc_id, arg_min(page, page - k * 1e9) AS b, MAX(k) AS k FROM lay_n GROUP BY doc_id")
view("lay", """SELECT c.doc_id, c.idx, MAX(align) FILTER (WHERE c.page = b.b) AS align, MIN(x_min) AS x_min, MAX(x_max) AS x_max, CAST(SUM(support) AS BIGINT) AS support,
  COALESCE(arg_min(header, CASE WHEN c.page = b.b THEN -1 ELSE c.page END) FILTER (WHERE header <> ''), '') AS header
  FROM cols c JOIN lay_n n ON n.doc_id = c.doc_id AND n.page = c.page JOIN lay_b b ON b.doc_id = c.doc_id AND b.k = n.k GROUP BY ALL""")
query("L14_document_layout", "SELECT * FROM lay")(lambda t: layout(t).withColumn("idx", c("idx").cast("bigint")))
view("lim", """SELECT doc_id, COALESCE(MIN(g) / 2, 40) AS lim FROM (SELECT doc_id, x_max - LAG(x_max) OVER (PARTITION BY doc_id ORDER BY x_max) AS g
  FROM lay WHERE align = 'right') GROUP BY doc_id""")


def placed_views(p: str, amount: str, tie: str) -> None:
    view(f"{p}_p", f"""SELECT * FROM (SELECT l.*, k.idx, k.align AS al, k.x_max AS kx, {amount} AS a, CASE WHEN {amount} THEN abs(l.x1 - k.x_max)
      WHEN (l.x0 + l.x1) / 2 BETWEEN k.x_min - 6 AND k.x_max + 6 THEN 0.0 ELSE least(abs((l.x0 + l.x1) / 2 - k.x_min), abs((l.x0 + l.x1) / 2 - k.x_max)) END AS d,
      lim FROM linr l JOIN lay k ON k.doc_id = l.doc_id AND ({amount}) = (k.align = 'right') JOIN lim m ON m.doc_id = l.doc_id)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, page, pos ORDER BY d, {tie}) = 1""")


placed_views("pl", "l.am", "idx")
query("L15_L16_place_words", """
SELECT doc_id, page, idx, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos FROM (SELECT doc_id, page, pos, CASE WHEN d < CASE WHEN a THEN lim ELSE 40 END THEN idx END AS idx FROM pl_p) GROUP BY ALL""")(
    lambda t: ly.place_words(ly.within_region(lined(t), regions(t)), layout(t)).groupBy(
        "doc_id", "page", c("idx").cast("bigint").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos")))
query("L16_place_words_contained", """
k AS (SELECT p.doc_id, p.page, p.pos, p.am, p.idx AS i0, p.d AS d0, lim, MIN(CASE WHEN y.align <> 'right' AND (p.x0 + p.x1) / 2 BETWEEN y.x_min - 6 AND y.x_max + 6 THEN 0 END) AS tin,
  arg_min(y.idx, (y.x_max - y.x_min) * 100 + y.idx) FILTER (WHERE (p.x0 + p.x1) / 2 BETWEEN y.x_min - 6 AND y.x_max + 6) AS nar FROM pl_p p JOIN lay y ON y.doc_id = p.doc_id GROUP BY ALL)
SELECT doc_id, page, idx, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS pos FROM (SELECT *, CASE WHEN NOT am AND tin IS NULL AND nar IS NOT NULL THEN nar
  WHEN d0 < CASE WHEN am THEN lim ELSE 40 END THEN i0 END AS idx FROM k) GROUP BY ALL""")(
    lambda t: ly.place_words(ly.within_region(lined(t), regions(t)), layout(t), text_in_amounts=True).groupBy(
        "doc_id", "page", c("idx").cast("bigint").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos")))
view("cel", """SELECT doc_id, page, line, idx, CASE WHEN al = 'right' THEN arg_min(text, abs(x1 - kx) * 1e6 + pos) ELSE string_agg(text, ' ' ORDER BY x0, pos) END AS texto
  FROM pl_p WHERE d < CASE WHEN a THEN lim ELSE 40 END GROUP BY doc_id, page, line, idx, al""")
query("L17_cells", "SELECT * FROM cel")(lambda t: cell_table(t).withColumn("idx", c("idx").cast("bigint")))
query("L18_rows_of_cells", """SELECT doc_id, page, line, string_agg(CAST(idx AS STRING) || '=' || texto, '|' ORDER BY idx) AS fila, COUNT(*) AS n FROM cel GROUP BY ALL""")(
    lambda t: ly.rows_of_cells(cell_table(t)).select(
        "doc_id", "page", "line", F.array_join(F.transform(F.map_entries("celdas"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), "|").alias("fila"),
        F.size("celdas").cast("bigint").alias("n")))
query("L19_widened_columns", """
o AS (SELECT *, LAG(x_max) OVER w AS pv, LEAD(x_min) OVER w AS nx, COUNT(*) FILTER (WHERE align <> 'right') OVER (PARTITION BY doc_id) AS nt FROM lay WINDOW w AS (PARTITION BY doc_id ORDER BY x_min))
SELECT doc_id, idx, CASE WHEN nt = 1 OR pv IS NULL THEN '-Infinity' ELSE CAST(round((pv + x_min) / 2, 3) AS STRING) END AS desde,
  CASE WHEN nt = 1 OR nx IS NULL THEN 'Infinity' ELSE CAST(round((x_max + nx) / 2, 3) AS STRING) END AS hasta FROM o WHERE align <> 'right'""")(
    lambda t: ly.widened(layout(t), ["doc_id"]).select(
        "doc_id", c("idx").cast("bigint").alias("idx"), F.round("x_min", 3).cast("string").alias("desde"), F.round("x_max", 3).cast("string").alias("hasta")))
view("lab_g", """SELECT *, SUM(CASE WHEN d > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line ORDER BY x0, pos) AS g FROM
  (SELECT *, x0 - LAG(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0, pos) AS d FROM lin)""")
view("lab", """SELECT doc_id, page, line, CAST(g AS BIGINT) AS n_etiqueta, string_agg(text, ' ' ORDER BY x0, pos) AS etiqueta, MIN(x0) AS x_min, MAX(x1) AS x_max FROM lab_g GROUP BY ALL""")
query("L20_labels", """SELECT doc_id, page, COUNT(*) AS n, MIN(etiqueta) AS menor, MAX(etiqueta) AS mayor, CAST(round(SUM(x_min + x_max), 3) AS DOUBLE) AS x
FROM lab GROUP BY doc_id, page""")(
    lambda t: ly.labels(lined(t)).groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n"), F.min("etiqueta").alias("menor"), F.max("etiqueta").alias("mayor"),
        F.round(F.sum(c("x_min") + c("x_max")), 3).alias("x")))
# Statement headers: the printed header speaks bank vocabulary on even documents.
_SWAP = {"Cuenta": "Fecha", "Nombre": "Concepto", "Debe": "Retiro", "Haber": "Deposito", "Inicial": "Liquidacion", "Final": "Operacion"}
view("ban", "SELECT doc_id, page, line, pos, x0, x1, top, bottom, ltop, lbottom, CASE WHEN doc_id % 2 = 0 THEN CASE text " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in _SWAP.items()) + " ELSE text END ELSE text END AS text FROM lin")


def bank_lines(t):
    new = c("text")
    for a, b in _SWAP.items():
        new = F.when(c("text") == a, b).otherwise(new)
    return lined(t).drop("es_monto").withColumn("text", F.when(c("doc_id") % 2 == 0, new).otherwise(c("text")))


view("blab_g", """SELECT *, SUM(CASE WHEN d > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line ORDER BY x0, pos) AS g FROM
  (SELECT *, x0 - LAG(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0, pos) AS d FROM ban)""")
view("blab", f"""SELECT *, {norm_sql('etiqueta')} AS nn FROM (SELECT doc_id, page, line, CAST(g AS BIGINT) AS n_etiqueta, string_agg(text, ' ' ORDER BY x0, pos) AS etiqueta,
  MIN(x0) AS x_min, MAX(x1) AS x_max FROM blab_g GROUP BY ALL)""")
view("bfld", """SELECT b.doc_id, b.page, b.line, n_etiqueta, etiqueta, x_min, x_max, arg_min(campo, prioridad) AS campo FROM blab b JOIN vocab_tabla v
  ON strpos(nn, sinonimo) > 0 OR strpos(replace(nn, ' ', ''), replace(sinonimo, ' ', '')) > 0 GROUP BY ALL""")
view("binh", """SELECT b.doc_id, b.page, b.line, b.n_etiqueta, b.x_min, b.x_max, CASE WHEN f.campo IS NULL THEN u.etiqueta || ' ' || b.etiqueta ELSE b.etiqueta END AS etiqueta,
  COALESCE(f.campo, u.campo) AS campo, ROW_NUMBER() OVER (PARTITION BY b.doc_id, b.page, b.line, b.n_etiqueta ORDER BY u.n_etiqueta) AS rn
  FROM blab b LEFT JOIN bfld f ON f.doc_id = b.doc_id AND f.page = b.page AND f.line = b.line AND f.n_etiqueta = b.n_etiqueta
  LEFT JOIN bfld u ON f.campo IS NULL AND u.doc_id = b.doc_id AND u.page = b.page AND u.line = b.line - 1 AND u.x_max >= b.x_min AND b.x_max >= u.x_min""")
view("bcol", "SELECT doc_id, page, line, n_etiqueta, x_min, x_max, etiqueta, campo FROM binh WHERE rn = 1 AND campo IS NOT NULL")
query("L21_label_fields", "SELECT * FROM bcol")(lambda t: bank_fields(t))


@stored("bank_fields")
def bank_fields(t):
    return ly.label_fields(ly.labels(bank_lines(t)), t.vocab_tabla)


view("bgood", """SELECT doc_id, page, line FROM bcol GROUP BY doc_id, page, line HAVING bool_or(campo = 'fecha') AND bool_or(campo = 'saldo')
  AND bool_or(campo IN ('deposito', 'retiro'))""")
view("bmoney", r"SELECT DISTINCT doc_id, page, line FROM ban w WHERE regexp_full_match(w.text, '\$?-?[\d,]*\.\d{2}-?')")
view("bhead", "SELECT * FROM bgood EXCEPT SELECT * FROM bmoney")
query("L22_statement_headers", "SELECT * FROM bhead")(lambda t: ly.statement_headers(bank_lines(t), bank_fields(t)))
query("L22_first_header", """SELECT doc_id, page, line FROM bhead QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY page, line) = 1""")(
    lambda t: ly.first_header(ly.statement_headers(bank_lines(t), bank_fields(t))))
view("fp_t", f"""SELECT doc_id, string_agg(DISTINCT tk, '|' ORDER BY tk) AS tk FROM (SELECT doc_id, unnest(string_split({norm_sql('header')}, ' ')) AS tk FROM lay) WHERE tk <> '' GROUP BY doc_id""")
query("L23_fingerprints", """
SELECT n.doc_id, left(sha256(COALESCE(tk, '') || '#' || CAST(n AS STRING) || '#sep'), 16) AS huella FROM (SELECT doc_id, COUNT(*) FILTER (WHERE align = 'right') AS n
FROM lay GROUP BY doc_id) n LEFT JOIN fp_t t ON t.doc_id = n.doc_id""")(
    lambda t: ly.fingerprint(layout(t), number_shape(t.words.filter("pos % 8 = 0").select("doc_id", c("text").alias("cuenta")))))
view("hl", f"""SELECT doc_id, page, line FROM (SELECT x.doc_id, x.page, x.line FROM lin x JOIN vocab_auxiliar v ON v.sinonimo = {norm_sql('x.text')}
  GROUP BY x.doc_id, x.page, x.line HAVING COUNT(DISTINCT campo) >= 2) EXCEPT SELECT doc_id, page, line FROM lin WHERE am""")
query("R7_header_like_lines", "SELECT * FROM hl")(lambda t: ly.header_like(lined(t), t.vocab_auxiliar))
query("L24_relabel", """
h AS (SELECT * FROM (SELECT l.doc_id, l.line, l.page, l.ltop, l.text, l.x0, k.idx, ROW_NUMBER() OVER (PARTITION BY l.doc_id, l.page, l.pos ORDER BY
  CASE WHEN (l.x0 + l.x1) / 2 BETWEEN k.x_min - 6 AND k.x_max + 6 THEN 0.0 ELSE least(abs((l.x0 + l.x1) / 2 - k.x_min), abs((l.x0 + l.x1) / 2 - k.x_max)) END, idx) AS rn,
  CASE WHEN (l.x0 + l.x1) / 2 BETWEEN k.x_min - 6 AND k.x_max + 6 THEN 0.0 ELSE least(abs((l.x0 + l.x1) / 2 - k.x_min), abs((l.x0 + l.x1) / 2 - k.x_max)) END AS d
  FROM lin l JOIN hl h ON h.doc_id = l.doc_id AND h.page = l.page AND h.line = l.line JOIN smp s ON s.doc_id = l.doc_id AND s.page = l.page
  JOIN lay k ON k.doc_id = l.doc_id AND k.align <> 'right') WHERE rn = 1 AND d < 40),
g AS (SELECT doc_id, page, line, ltop, idx, string_agg(text, ' ' ORDER BY x0) AS tx FROM h GROUP BY ALL),
n AS (SELECT doc_id, idx, string_agg(tx, ' ' ORDER BY ltop, tx) AS nuevo FROM g GROUP BY ALL)
SELECT l.doc_id, l.idx, COALESCE(nuevo, header) AS header FROM lay l LEFT JOIN n ON n.doc_id = l.doc_id AND n.idx = l.idx""")(
    lambda t: ly.relabel(layout(t), lined(t), ly.header_like(lined(t), t.vocab_auxiliar)).select(
        "doc_id", c("idx").cast("bigint").alias("idx"), "header"))

query("M2_observed_shapes", r"""
s AS (SELECT doc_id, idx, CASE WHEN regexp_full_match(trim(texto), '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}') THEN 'fecha' WHEN regexp_full_match(trim(texto), '\$?-?[\d,]*\.\d{2}') THEN 'monto'
  WHEN regexp_full_match(trim(texto), '\d{1,8}') THEN 'entero' ELSE 'texto' END AS f FROM cel WHERE trim(texto) <> '')
SELECT doc_id, idx, COUNT(*) AS celdas, CASE WHEN COUNT(*) FILTER (WHERE f = 'fecha') >= COUNT(*) * 0.8 THEN 'fecha' WHEN COUNT(*) FILTER (WHERE f = 'monto') >= COUNT(*) * 0.8 THEN 'monto'
  WHEN COUNT(*) FILTER (WHERE f = 'entero') >= COUNT(*) * 0.8 THEN 'entero' ELSE 'texto' END AS forma FROM s GROUP BY ALL""")(
    lambda t: mp.observed_shape(cell_table(t)).withColumn("idx", c("idx").cast("bigint")))
