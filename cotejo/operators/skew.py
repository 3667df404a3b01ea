"""Joins of rows with what is known of their document, when one document may hold most of the rows.

A join on the document alone gives a document's rows to one task. Here the rows are dealt out by document and
span (a stretch of pages, or of the reading order), and the small side is copied once for each span that its
document has. How many that are is read off the rows themselves by a map-side combined ``distinct``: an ordinary document
has one span, so it is not copied, and only a large one is. Nothing depends on sampling or on partition ids, nothing
goes through the driver, and no limit has to be guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.session import join_grown

PAGES = 6    # 64 pages in a span
ROWS = 20    # about a million numbers of the reading order in a span


def by_page(bits: int | None = None) -> Column:
    return F.shiftright(F.col("page").cast("long"), PAGES if bits is None else bits)


def by_seq(bits: int | None = None) -> Column:
    return F.shiftright(F.col("seq"), ROWS if bits is None else bits)


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | str, span: Column, how: str = "inner") -> DataFrame:
    """``big.join(small, on, how)`` for a ``small`` with few rows per key; ``how`` is inner, left or left_semi.

    No key of the join has more rows of ``big`` than one span holds. Null keys match nothing, as in any join.
    """
    on = [on] if isinstance(on, str) else list(on)
    rows = big.withColumn("_tramo", F.coalesce(span, F.lit(-1).cast("long")))
    copies = join_grown(rows.select(*on, "_tramo").distinct(), small, on)
    return rows.join(copies.hint("shuffle_hash"), [*on, "_tramo"], how).drop("_tramo")
