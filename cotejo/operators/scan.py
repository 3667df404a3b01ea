"""Ordered scans that never put a whole document in one task.

Chains (previous balance, running sum, last printed value) need row order inside
a document or an account, and one document may hold a third of all rows.  A plain
``Window.partitionBy(doc).orderBy(seq)`` would give that document to one task.

``ordered_scan`` cuts the order key into spans instead: windows run inside
``(keys, seq >> 20)``, each span hands its last state to a second level of at most
2**20 spans, that one to a third, and the carried state is joined back.  Every
window group is bounded by about a million rows whatever the skew, the result is
exact, and it does not depend on sampling or on partition ids, so a lost executor
recomputes the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = (20, 40)
TEXT_BITS = (12, 40)  # 4,096 lines of a page, then 256 pages


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    lag: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    levels: Sequence[int] = LEVEL_BITS,
    keep: bool = False,
    dealt: bool = False,
) -> DataFrame:
    """Add scan columns to ``df``; ``order`` is a unique non-negative BIGINT per ``keys``.

    ``keep`` leaves the column ``_span`` in; a scan of such a table by the same keys and order is ``dealt`` and moves no row again.

    lag      value of the previous row (null on the first row)
    running  inclusive running sum (nulls count as nothing)
    latest   last non-null value up to and including this row
    before   last non-null value strictly before this row
    """
    lag, running = dict(lag or {}), dict(running or {})
    latest, before = dict(latest or {}), dict(before or {})
    keys = list(keys)

    # One state column per request. Inputs are named first so that the expressions
    # are evaluated once and only small columns travel with the carried state.
    ins = {f"_i_{n}": c for m in (lag, running, latest, before) for n, c in m.items()}
    span = F.shiftright(F.col(order), levels[0])
    base = df.select("*", *[c.alias(n) for n, c in ins.items()], *([] if dealt else [span.alias("_span")]))
    # An input already hashed on ``keys`` would satisfy the window and keep a hot key in one
    # task, so the rows are dealt out by span first.
    if not dealt:
        base = base.repartition(*keys, "_span")

    inner = Window.partitionBy(*keys, "_span").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.lead(F.lit(True)).over(inner).isNull().alias("_end")]
    if lag:
        packed = F.struct(*[F.col(f"_i_{n}").alias(n) for n in lag])
        cols.append(F.lag(packed).over(inner).alias("_lag"))
        cols.append(packed.alias("_own"))
    for n in running:
        cols.append(F.sum(f"_i_{n}").over(upto).alias(f"_r_{n}"))
    for n in latest:
        cols.append(F.last(f"_i_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}"))
    for n in before:
        cols.append(F.last(f"_i_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}"))
        cols.append(F.last(f"_i_{n}", ignorenulls=True).over(upto).alias(f"_bt_{n}"))
    here = base.select("*", *cols)

    state = {}
    if lag:
        state["_own"] = "lag"
    state.update({f"_r_{n}": "sum" for n in running})
    state.update({f"_l_{n}": "last" for n in latest})
    state.update({f"_bt_{n}": "last" for n in before})

    tails = here.filter("_end").select(*keys, "_span", *state)
    carried = _carry(tails, keys, state, list(levels), 0)
    joined = here.join(carried, keys + ["_span"], "left")

    out = [F.col(c) for c in df.columns if c != "_span"] + ([F.col("_span")] if keep else [])
    for n in lag:
        out.append(F.when(F.col("_lag").isNotNull(), F.col(f"_lag.{n}"))
                   .otherwise(F.col(f"_c__own.{n}")).alias(n))
    for n in running:
        r, c = F.col(f"_r_{n}"), F.col(f"_c__r_{n}")
        out.append(F.when(r.isNull(), c).when(c.isNull(), r).otherwise(r + c).alias(n))
    for n in latest:
        out.append(F.coalesce(f"_l_{n}", f"_c__l_{n}").alias(n))
    for n in before:
        out.append(F.coalesce(f"_b_{n}", f"_c__bt_{n}").alias(n))
    return joined.select(*out)


def _carry(tails: DataFrame, keys: list[str], state: Mapping[str, str],
           levels: list[int], depth: int) -> DataFrame:
    """State that enters each span: the fold of all earlier spans of the same keys."""
    last_level = depth + 1 >= len(levels)
    if last_level:
        group, tails2 = keys, tails
    else:
        shift = levels[depth + 1] - levels[depth]
        tails2 = tails.withColumn("_up", F.shiftright("_span", shift))
        group = keys + ["_up"]
    w = Window.partitionBy(*group).orderBy("_span")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def fold(kind: str, col: str, frame: Window) -> Column:
        if kind == "sum":
            return F.sum(col).over(frame)
        return F.last(col, ignorenulls=True).over(frame)

    incoming = [fold(k, c, prior).alias(f"_c_{c}") for c, k in state.items()]
    if last_level:
        return tails2.select(*keys, "_span", *incoming)

    totals = [fold(k, c, upto).alias(f"_t_{c}") for c, k in state.items()]
    mid = tails2.select(*keys, "_up", "_span", *incoming, *totals,
                        F.lead(F.lit(True)).over(w).isNull().alias("_end"))
    up = mid.filter("_end").select(
        *keys, F.col("_up").alias("_span"), *[F.col(f"_t_{c}").alias(c) for c in state])
    above = _carry(up, keys, state, levels, depth + 1).withColumnRenamed("_span", "_up")
    above = above.select(*keys, "_up", *[F.col(f"_c_{c}").alias(f"_a_{c}") for c in state])
    merged = mid.join(above, keys + ["_up"], "left")
    out = []
    for c, kind in state.items():
        own, top = F.col(f"_c_{c}"), F.col(f"_a_{c}")
        if kind == "sum":
            val = F.when(own.isNull(), top).when(top.isNull(), own).otherwise(own + top)
        else:
            val = F.coalesce(own, top)
        out.append(val.alias(f"_c_{c}"))
    return merged.select(*keys, "_span", *out)


def ordered_texts(pieces: DataFrame, keys: Sequence[str], order: str, texts: Mapping[str, Column], sep: str | Mapping[str, str] = " ",
                  levels: Sequence[int] = TEXT_BITS) -> DataFrame:
    """The texts of each group joined in order, nulls left out; ``order`` is a unique non-negative BIGINT per ``keys``.

    Texts are joined inside spans of the order key first, then fragments inside wider spans, then those of a
    group: a group with a million pieces is never collected, a task holds the pieces of one span and, at the
    end, a few fragments and the text that they make. A group without any text has null.
    """
    seps = sep if isinstance(sep, Mapping) else dict.fromkeys(texts, sep)
    at = pieces.select(*keys, F.col(order).alias("_at"), *[t.alias(n) for n, t in texts.items()])
    for bits in [*levels, None]:
        span = F.lit(0).cast("long") if bits is None else F.shiftright("_at", bits - _spent(levels, bits))
        at = at.withColumn("_to", span)
        packed = [F.filter(F.sort_array(F.collect_list(F.struct("_at", F.col(n).alias("t")))), lambda s: s["t"].isNotNull()) for n in texts]
        at = at.groupBy(*keys, "_to").agg(*[
            F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda s: s["t"]), seps[n])).alias(n)
            for n, p in zip(texts, packed)]).withColumnRenamed("_to", "_at")
    return at.drop("_at")


def _spent(levels: Sequence[int], bits: int) -> int:
    """How far the levels before ``bits`` have shifted the order key already."""
    before = [b for b in levels if b < bits]
    return max(before, default=0)


def first_names(df: DataFrame, key: str, value: str, order: Sequence[str],
                k: int = 5, name: str = "nombres") -> DataFrame:
    """The first ``k`` values per key as one text.

    ``row_number <= k`` is pushed below the shuffle as a group limit, so at most
    ``k`` rows per task and key travel; no key is ever collected whole.
    """
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    packed = F.sort_array(F.collect_list(F.struct("_rn", F.col(value).alias("v"))))
    return top.groupBy(key).agg(
        F.array_join(F.transform(packed, lambda s: s["v"]), ", ").alias(name))
