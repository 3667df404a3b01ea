"""Text and money functions (F1-F11, F17-F28), as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns a printed cell is told apart with --------------------------
RE_NUMERIC = r"^[\d.,\-$()%/:]+$"
RE_ACCOUNT_CELL = r"^\d{3,}(-\d+)*$"
RE_DATE_CELL = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"
RE_DOTTED = r"^\d{1,6}(\.\d{1,6})+$"
RE_INTEGER_CELL = r"^\d{1,8}$"
RE_REREAD = r"^-?\d{1,3}(,\d{3})*\.\d{2}$"
RE_LOOKS_AMOUNT = r"^-?[\d,]+\.\d{1,3}$"
RE_CLABE = r"^\d{18}$"
RE_RFC = r"^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}$"
RE_UUID_HEAD = r"(?i)^[0-9A-F]{8}-[0-9A-F]{4}-"
RE_BANK_ACCOUNT = r"^\d[\d-]{6,}\d$"
# Printed amounts with two decimals, per document kind.
AMOUNT_DIALECTS = {
    "auxiliar": r"^\$?-?[\d,]*\.\d{2}$",
    "polizas": r"^\$?-?[\d,]*\.\d{2}$",
    "mayor": r"^-?[\d,]*\.\d{2}$",
    "estado_cuenta": r"^\$?-?[\d,]*\.\d{2}-?$",
}
# The last dialect once K4 has put a sign token of its own ('-$', too) before the amount.
RE_SIGNED_AMOUNT = r"^(-?\$|\$?-?)[\d,]*\.\d{2}-?$"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
          "septiembre", "octubre", "noviembre", "diciembre")
SUMMARY_MARKS = ("acum", "acumulativa", "acumulativo")
DETAIL_MARKS = ("deta", "detalle")
TOTAL_WORDS = ("totales", "total", "sumas", "suma")

def _accent_table() -> tuple[str, str]:
    """Latin letters and what they become once their marks are dropped, by rule."""
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(cp))
                       if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def parse_money(c: Column, strict: bool = False) -> Column:
    """text to DECIMAL(28,8). An empty cell is zero; anything else that is not an
    amount is null, or fails the job when ``strict``.

    Parentheses, a leading or a trailing sign negate; each pattern is applied once so that
    the expression stays inside one generated method.
    """
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")  # tabs and hard spaces too
    body = F.translate(F.regexp_replace(s, r"^\((.*)\)$", "$1"), "$, ", "")
    digits = F.regexp_replace(body, "^-(.*)$|^(.*)-$", "$1$2")
    sign = F.when(s.rlike(r"^\(.*\)$") | body.rlike("^-|-$"), "-").otherwise("")
    kind = "decimal(28,8)"
    # '' reads as zero: a prefixed 0 changes no number and completes '.50' and ''.
    value = F.concat(sign, F.lit("0"), digits).try_cast(kind)
    bad = F.lit(None).cast(kind)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an amount: "), c)).cast(kind)
    return F.when(c.isNull(), F.lit(None).cast(kind)).when(
        digits.rlike(r"^(\d+(\.\d+)?|\.\d+)?$"), value).otherwise(bad)


def loses_scale(c: Column) -> Column:
    """True where storing a parsed amount with two decimals would change it."""
    return c != c.cast("decimal(18,2)")


def is_dotted(c: Column) -> Column:
    """A dotted number: an amount elsewhere, text inside the account column."""
    return F.trim(c).rlike(RE_DOTTED)


def is_amount(c: Column, in_account_column: Column | bool = False) -> Column:
    """amount tokens are right-aligned; account numbers and dates are not amounts.
    A dotted number inside the account column is text."""
    s = F.trim(c)
    inside = F.lit(in_account_column) if isinstance(in_account_column, bool) else in_account_column
    return (s.rlike(r"\d") & ~s.rlike(RE_ACCOUNT_CELL) & ~s.rlike(RE_DATE_CELL)
            & ~(inside & s.rlike(RE_DOTTED)) & s.rlike(RE_NUMERIC))


def is_printed_amount(c: Column, kind: str) -> Column:
    """F3."""
    return F.trim(c).rlike(AMOUNT_DIALECTS[kind])


def normalize(c: Column) -> Column:
    """lower case, no accents, punctuation to spaces, single spaces."""
    plain = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{M}+", "")
    words = F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " ")
    return F.trim(words)


def tight_key(c: Column) -> Column:
    """F6."""
    return F.replace(normalize(c), F.lit(" "), F.lit(""))


def cell_shape(c: Column) -> Column:
    """date, amount, integer or text; first match wins."""
    s = F.trim(c)
    return (F.when(s.rlike(RE_DATE_CELL), "fecha")
            .when(s.rlike(AMOUNT_DIALECTS["auxiliar"]), "monto")
            .when(s.rlike(RE_INTEGER_CELL), "entero").otherwise("texto"))


def _lookup(key: Column, table: dict, default: Column) -> Column:
    """A literal map, so the key is computed once however many entries there are."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def month_number(c: Column) -> Column:
    """F8: month name to 1..12, 0 if it is not one."""
    return _lookup(normalize(c), {m: i for i, m in enumerate(MONTHS, 1)}, F.lit(0))


def month_code(c: Column) -> Column:
    """F8: abbreviation to '01'..'12', '' if unknown."""
    return _lookup(F.substring(normalize(c), 1, 3),
                   {m[:3]: f"{i:02d}" for i, m in enumerate(MONTHS, 1)}, F.lit(""))


def statement_date(c: Column, start: Column, end: Column, year: Column) -> Column:
    """struct(dia, fecha) from the four printed forms; null when it is no date.

    ``start``/``end`` read '01 ABR 2025'; ``year`` is the declared year or ''.
    """
    t = F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    mon = "([A-ZÁÉÍÓÚ]{3})"
    p_ini, p_fin = F.split(start, " "), F.split(end, " ")
    whole = (F.size(p_ini) == 3) & (F.size(p_fin) == 3)
    declared = F.when(year != "", year).when(F.size(p_ini) == 3, F.get(p_ini, F.lit(2))).otherwise("")
    two = lambda d: F.lpad(d, 2, "0")

    def build(day: Column, month: Column, yr: Column) -> Column:
        return F.when(month != "", F.struct(
            day.alias("dia"), F.when(yr != "", F.concat(two(day), F.lit("/"), month, F.lit("/"), yr))
            .otherwise("").alias("fecha")))

    bare = F.regexp_extract(t, r"^(\d{1,2})$", 1)
    same = whole & (F.get(p_ini, F.lit(1)) == F.get(p_fin, F.lit(1))) & (
        F.get(p_ini, F.lit(2)) == F.get(p_fin, F.lit(2)))
    p_mon = month_code(F.get(p_ini, F.lit(1)))
    bare_date = F.when(same & (p_mon != ""), F.concat(
        two(bare), F.lit("/"), p_mon, F.lit("/"), F.get(p_ini, F.lit(2)))).otherwise("")
    dmy = rf"^(\d{{1,2}})[-/ ]{mon}\.?[-/ ](\d{{2,4}})$"
    raw = F.regexp_extract(t, dmy, 3)
    century = F.when(F.length(declared) == 4, F.substring(declared, 1, 2)).otherwise("20")
    full = F.when(F.length(raw) == 4, raw).otherwise(F.concat(
        century, F.when(F.length(raw) < 2, F.lpad(raw, 2, "0")).otherwise(raw)))
    dm, md = rf"^(\d{{1,2}})[-/ ]{mon}\.?$", rf"^{mon}\.?[-/ ](\d{{1,2}})$"
    g = F.regexp_extract
    return (F.when(t.rlike(r"^\d{1,2}$"), F.struct(bare.alias("dia"), bare_date.alias("fecha")))
            .when(t.rlike(dmy), build(g(t, dmy, 1), month_code(g(t, dmy, 2)), full))
            .when(t.rlike(dm), build(g(t, dm, 1), month_code(g(t, dm, 2)), declared))
            .when(t.rlike(md), build(g(t, md, 2), month_code(g(t, md, 1)), declared)))


def is_clabe(c: Column) -> Column:
    return c.rlike(RE_CLABE)


def is_rfc(c: Column) -> Column:
    return c.rlike(RE_RFC)


def is_uuid_head(c: Column) -> Column:
    return c.rlike(RE_UUID_HEAD)


def is_bank_account(c: Column) -> Column:
    """a printed account number that is not a CLABE."""
    return c.rlike(RE_BANK_ACCOUNT) & ~c.rlike(RE_CLABE)


def reread_class(c: Column) -> Column:
    """recovered, truncated, or not an amount at all."""
    s = F.trim(c)
    return (F.when(s.rlike(RE_REREAD), "recuperado").when(s.rlike(RE_LOOKS_AMOUNT), "truncado"))


def row_mark(words: Column) -> Column:
    """the first summary or detail mark among the words of a row, '' if none."""
    norm = F.transform(words, normalize)
    hit = F.get(F.filter(norm, lambda w: w.isin(*SUMMARY_MARKS, *DETAIL_MARKS)), F.lit(0))
    return F.when(hit.isin(*SUMMARY_MARKS), "acumulativa").when(
        hit.isNotNull(), "detalle").otherwise("")


def without_marks(c: Column) -> Column:
    """the name without its marks."""
    words = F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "),
                     lambda w: ~normalize(w).isin(*SUMMARY_MARKS, *DETAIL_MARKS))
    return F.array_join(words, " ")


def is_totals_row(cells: Column) -> Column:
    """some cell holds a totals word as a whole word."""
    words = F.array(*[F.lit(w) for w in TOTAL_WORDS])
    return F.exists(cells, lambda c: F.arrays_overlap(F.split(normalize(c), " "), words))


def block_label(words: Column) -> Column:
    """the first three words, normalised."""
    return normalize(F.array_join(F.slice(words, 1, 3), " "))


def starts_with_label(label: Column, options: Sequence[str]) -> Column:
    """equal to an option, or the option followed by more words."""
    out = F.lit(False)
    for o in options:
        out = out | (label == o) | label.startswith(o + " ")
    return out


# --- vocabulary joins (F20-F22): the synonym tables are fixed and small ----------------
def vocabulary_scores(labels: DataFrame, vocab: DataFrame, label: str = "etiqueta") -> DataFrame:
    """3 for the exact synonym, 2 when it is contained as whole words."""
    pad = F.concat(F.lit(" "), F.col("_n"), F.lit(" "))
    hit = F.instr(pad, F.concat(F.lit(" "), F.col("sinonimo"), F.lit(" "))) > 0
    points = F.max(F.when(F.col("_n") == F.col("sinonimo"), 3).otherwise(2)).alias("puntaje")
    return _by_spelling(labels, normalize(F.col(label)), lambda seen: seen.join(vocab, hit)
                        .groupBy("_n", "campo").agg(points))


def _by_spelling(labels: DataFrame, spelling: Column, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answer the distinct spellings ``_n``, which are few, and join back by equality."""
    keyed = labels.withColumn("_n", spelling)
    found = answer(keyed.select("_n").distinct())
    extra = [c for c in found.columns if c != "_n"]
    return keyed.join(found, "_n").select(*labels.columns, *extra).distinct()


#: A letter, or a character that lower case may make one, as its tables are newer than those of patterns.
RE_MAYBE_LETTER = r"[A-Za-z\P{ASCII}]"


def field_by_priority(labels: DataFrame, vocab: DataFrame, label: str = "etiqueta") -> DataFrame:
    """the first field in priority order whose synonym occurs in the label, also tight.

    The vocabulary, some dozens of rows, is packed into one and read beside each label: most labels of a table are its
    amounts, so their distinct spellings are as many as its rows, and no label moves to be named. Where every synonym
    has a letter, a label of other ASCII characters alone is not read further.
    """
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    packed = vocab.agg(F.sort_array(F.collect_list(F.struct("prioridad", "campo", "sinonimo", tight(F.col("sinonimo")).alias("junto")))).alias("_v"),
                       F.bool_and(F.col("sinonimo").rlike(r"\p{L}")).alias("_letras"))
    near = labels.crossJoin(F.broadcast(packed)).filter(~F.col("_letras") | F.col(label).rlike(RE_MAYBE_LETTER))
    # exploded, so that a label is normalised once and not for each synonym
    said = F.transform(F.array(normalize(F.col(label))), lambda n: F.struct(n.alias("n"), tight(n).alias("j")))
    n = near.withColumn("_t", F.explode(said))
    hits = F.filter("_v", lambda v: F.col("_t.n").contains(v["sinonimo"]) | F.col("_t.j").contains(v["junto"]))
    return n.withColumn("campo", F.get(hits, F.lit(0))["campo"]).filter(F.col("campo").isNotNull()).drop("_t", "_v", "_letras")


def balance_field(labels: DataFrame, vocab: DataFrame, label: str = "etiqueta") -> DataFrame:
    """the balance named by the END of the label, longest synonym first."""
    hit = F.col("_n").endswith(F.col("sinonimo"))
    return _by_spelling(labels, tight_key(F.col(label)), lambda seen: seen.join(vocab, hit)
                        .groupBy("_n").agg(F.max_by("campo", F.length("sinonimo")).alias("campo")))


# --- masking (F23, F24) ----------------------------------------------------------------
# Words that are never masked.
KEPT_WORDS = (
    "no", "cuenta", "naturaleza", "saldo", "inicial", "final", "deudor", "acreedor", "debe", "haber",
    "folio", "fecha", "tipo", "documento", "tercero", "descripcion", "descripción", "referencia",
    "depositos", "depósitos", "retiros", "dia", "día", "concepto", "importe", "moneda", "periodo",
    "período", "pagina", "página", "de", "al", "hasta", "desde", "totales", "total", "subtotal",
    "movimiento", "conciliado", "poliza", "póliza", "polizas", "pólizas", "auxiliar", "cuentas",
    "balanza", "comprobacion", "comprobación", "impreso", "estado", "corte", "notas", "adicionales",
    "asociados", "la", "a", "y", "en", "del", "impresion", "impresión", "mxn", "usd", "contable",
    "banco", "sucursal", "telefono", "teléfono", "clave", "bancaria", "estandar", "estándar", "numero",
    "número", "informacion", "información", "general", "resumen", "comisiones", "detalle",
    "operaciones", "promedio", "diario", "minimo", "mínimo", "requerido", "cheques", "girados",
    "exentos", "ganancia", "anual", "nominal", "real", "tasa", "interes", "interés", "ordinaria",
    "rendimiento", "cobradas", "otras", "iva", "sobre", "libro", "ingreso", "egreso", "venta",
    "compra", "cfdi", "uuid", "rfc",
)
_MASK_UUID = r"(?i)^[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-?[0-9A-F]{0,12}$"
_MASK_RFC = r"(?i)^[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}$"
_MASK_CLABE = r"^\d{16,20}$"
RE_KEPT_ACCOUNT = r"^\d{3}(-\d{1,6})*$"


def pseudonym(c: Column, prefix: str, n: int, salt: str) -> Column:
    """the same text always gives the same salted name."""
    digest = F.sha2(F.concat(F.lit(salt + "|"), F.upper(c)), 256)
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, n)))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÉÍÓÚÜÑ"
_SHAPE_FROM = "0123456789" + _UPPER + _UPPER.lower()
_SHAPE_TO = "9" * 10 + "X" * len(_UPPER) + "x" * len(_UPPER)


def mask(c: Column, mode: str, salt: str = "sal", kept: Sequence[str] = KEPT_WORDS) -> Column:
    """keep the shape, hide the value. Modes: none, values, all.

    One translation hides letters and digits (for a numeric token that is digits to 9). Plain
    words, the bulk of any text, are told apart first and skip the identifier patterns.
    """
    if mode == "none":
        return c
    s = F.trim(c)
    hidden = F.translate(c, _SHAPE_FROM, _SHAPE_TO)
    ident = (F.when(s.rlike(_MASK_RFC), pseudonym(s, "RFC", 9, salt))
             .when(s.rlike(_MASK_UUID), pseudonym(s, "UUID-", 12, salt))
             .when(s.rlike(_MASK_CLABE), pseudonym(s, "CLB", 14, salt)))
    if mode == "values":
        ident = F.when(s.rlike(RE_KEPT_ACCOUNT), c).otherwise(ident)
    out = F.coalesce(F.when(s.rlike("[0-9-]"), ident), hidden)
    if mode == "values":
        out = F.when(F.btrim(F.lower(s), F.lit(".:,()")).isin(*kept), c).otherwise(out)
    return F.when(s == "", c).otherwise(out)


def leaks(masked: Column) -> Column:
    """A masked token that still holds a digit other than 9."""
    s = F.trim(masked)
    return s.rlike("[0-8]") & ~s.rlike(rf"^(RFC|UUID-|CLB)|{RE_KEPT_ACCOUNT}")


def audit_leaks(df: DataFrame, text: str, mode: str = "values", salt: str = "sal") -> DataFrame:
    """D13 over a table of tokens: mask and keep what still shows a digit.

    The masked text is exploded from a one-element array, so it is computed once and not
    repeated inside the filter.
    """
    keep = [k for k in df.columns if k != text]
    masked = df.select(*keep, F.explode(F.array(mask(F.col(text), mode, salt))).alias("m"))
    return masked.filter(leaks(F.col("m")))


def reason_template(c: Column) -> Column:
    """digits to N, a trailing list to an ellipsis."""
    plain = F.regexp_replace(c, r"\d[\d,\.]*", "N")
    return F.trim(F.regexp_replace(plain, r":\s*[^;]+$", ": …"))


def short_text(c: Column, width: int = 38) -> Column:
    """F28."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) <= width, s).otherwise(
        F.concat(F.rtrim(F.left(s, F.lit(width - 1))), F.lit("…")))


