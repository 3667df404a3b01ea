"""Account-number functions: F4, F12, F13, F15, F16, F26 and the scheme operators A1, A2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 18          # digits of the canonical key
MAX_LEVELS = 9      # of a catalogue with level markers
RE_ACCOUNT = r"^[0-9]{3,}(-[0-9]{1,6})*$"


def is_account(c: Column) -> Column:
    """F4."""
    return F.trim(c).rlike(RE_ACCOUNT)


def canonical(c: Column, width: int = WIDTH) -> Column:
    """digits only, cut and right-padded to one width."""
    return F.rpad(F.left(F.regexp_replace(c, "[^0-9]", ""), F.lit(width)), width, "0")


def canonical_without_marker(c: Column, start: Column, end: Column) -> Column:
    """the level marker is removed first; null marker columns mean there is none."""
    body = F.concat(F.left(c, start), F.substr(c, end + 1))
    return canonical(F.when(start.isNull(), c).otherwise(body))


def signed(debit: Column, credit: Column) -> Column:
    """F15."""
    return debit - credit


def nature_of_row(opening: Column, closing: Column, debe: Column, haber: Column) -> Column:
    """F16: which identity one row supports, '' when it reveals none."""
    tol = F.lit("0.01").cast("decimal(18,2)")
    move = debe - haber
    return (F.when(move == 0, "")
            .when(F.abs(opening + move - closing) <= tol, "D")
            .when(F.abs(opening - move - closing) <= tol, "A").otherwise(""))


def number_shape(df: DataFrame) -> DataFrame:
    """``sep`` / ``fijo:N`` / ``variable`` / ``?`` per document."""
    c = F.col("cuenta")
    ok = c.rlike(r"^[0-9][0-9-]{2,}$")
    g = df.groupBy("doc_id").agg(
        F.count_if(ok).alias("n"), F.bool_or(ok & c.contains("-")).alias("sep"),
        F.min(F.when(ok, F.length(c))).alias("corto"), F.max(F.when(ok, F.length(c))).alias("largo"))
    shape = (F.when(F.col("n") == 0, "?").when(F.col("sep"), "sep")
             .when(F.col("corto") == F.col("largo"),
                   F.concat(F.lit("fijo:"), F.col("corto").cast("string")))
             .otherwise("variable"))
    return g.select("doc_id", shape.alias("forma"))


def infer_schemes(df: DataFrame) -> DataFrame:
    """A1: how each document writes its account numbers.

    A suffix can only be a marker in an all-digit catalogue, so the collected suffix
    set holds at most a thousand three-digit values per document.
    """
    c = F.col("cuenta")
    digits = c.rlike("^[0-9]+$")
    seen = df.filter(F.length("cuenta") > 0)
    base = seen.groupBy("doc_id").agg(
        F.bool_or(c.contains("-")).alias("dash"), F.bool_and(digits).alias("digits"),
        F.min(F.length(c)).alias("lo"), F.max(F.length(c)).alias("hi"),
        F.collect_set(F.when(digits, F.right(c, F.lit(3)))).alias("suf"))
    k = F.size("suf")
    fixed = ~F.col("dash") & F.col("digits") & (F.col("lo") == F.col("hi"))
    marker = (fixed & (F.col("hi") > 3) & k.between(2, MAX_LEVELS)
              & (F.array_min("suf").cast("int") == 1) & (F.array_max("suf").cast("int") == k))
    base = base.select("doc_id", "dash", "digits", fixed.alias("fixed"), "hi",
                       F.coalesce(marker, F.lit(False)).alias("marker"))
    # Widths are measured on the accounts themselves, then forced to grow by level.
    body = F.expr("left(cuenta, length(cuenta) - 3)")
    # Combined before the join: a document has at most a thousand suffixes, however many rows.
    per_level = (seen.filter(digits).withColumn("nivel", F.right(c, F.lit(3)).try_cast("int"))
                 .groupBy("doc_id", "nivel")
                 .agg(F.max(F.greatest(F.lit(1), F.length(F.regexp_replace(body, "0+$", ""))))
                      .alias("w"))
                 .join(base.filter("marker").select("doc_id"), "doc_id", "left_semi"))
    grow = Window.partitionBy("doc_id").orderBy("nivel")  # at most nine rows per document
    widths = (per_level.withColumn("ancho", F.col("nivel") + F.max(F.col("w") - F.col("nivel"))
                                   .over(grow))
              .groupBy("doc_id").agg(F.transform(
                  F.sort_array(F.collect_list(F.struct("nivel", "ancho"))),
                  lambda s: s["ancho"]).alias("anchos")))
    j = base.join(widths, "doc_id", "left")
    m = F.col("marker")
    return j.select(
        "doc_id", F.when(F.col("dash"), "-").otherwise("").alias("separador"),
        F.coalesce("anchos", F.array().cast("array<int>")).alias("anchos"),
        F.when(m, F.col("hi") - 3).alias("marca_ini"), F.when(m, F.col("hi")).alias("marca_fin"),
        F.when(F.col("fixed"), F.col("hi")).otherwise(0).alias("largo"))


def _significant(c: Column) -> Column:
    return F.regexp_replace(c, "(-0+)+$", "")


def level_of(c: Column, ini: Column, fin: Column) -> Column:
    """A2, level: the marker digits, or the segments left after zero padding."""
    marked = F.greatest(F.substr(c, ini + 1, fin - ini).try_cast("int"), F.lit(1))
    return F.when(ini.isNotNull(), marked).otherwise(F.size(F.split(_significant(c), "-")))


def parent_of(c: Column, anchos: Column, ini: Column, fin: Column) -> Column:
    """A2, parent: prefix of the level above, padded back the way the catalogue pads."""
    lvl = F.substr(c, ini + 1, fin - ini).try_cast("int")
    no_parent = (lvl <= 1) | (lvl > F.size(anchos))
    kept = F.left(F.left(c, ini), F.get(anchos, lvl - 2))
    body = F.left(F.concat(kept, F.repeat(F.lit("0"), ini)), ini)
    number = F.lpad((lvl - 1).cast("string"), 3, "0")
    by_marker = F.when(no_parent, "").otherwise(F.concat(body, number))
    parts = F.split(c, "-")
    n_sig = F.size(F.split(_significant(c), "-"))
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n_sig - 1, F.lit(0))), "-")
    tail = F.array_join(F.slice(parts, F.greatest(n_sig, F.lit(1)), F.size(parts)), "-")
    padded = F.concat(head, F.lit("-"), F.regexp_replace(tail, "[^-]", "0"))
    by_dash = (F.when(n_sig <= 1, "").when(n_sig == F.size(parts), head).otherwise(padded))
    return F.when(ini.isNotNull(), by_marker).otherwise(by_dash)


def ancestors_of(c: Column, anchos: Column, ini: Column, fin: Column) -> Column:
    """All ancestors, nearest first: A2 folded over the depth of the account."""
    start = F.struct(c.alias("at"), F.array().cast("array<string>").alias("path"))

    def step(acc, _):
        up = F.coalesce(parent_of(acc["at"], anchos, ini, fin), F.lit(""))
        return F.struct(up.alias("at"),
                        F.when(up == "", acc["path"]).otherwise(F.array_append(acc["path"], up))
                        .alias("path"))

    # a dashed account has fewer ancestors than segments, a level marker counts to nine
    depth = F.greatest(F.size(F.split(c, "-")), F.lit(MAX_LEVELS))
    return F.aggregate(F.sequence(F.lit(1), depth), start, step,
                       lambda acc: acc["path"])
