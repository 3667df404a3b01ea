"""Prefix sums over rows in order, inside keys of any size.

Rows are range-sorted by key and order over all tasks, so a key that holds a third of the rows
spans many ranges and a range holds many small keys. Sums run inside a range; the sums of a
key's earlier ranges are added from a table with one row per range and key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.session import stage


def prefix_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str],
                per_key: DataFrame | None = None) -> DataFrame:
    """``rows`` with, for each ``new: old`` of ``sums``, what the earlier rows of the same keys add up to.

    ``keys`` hold no nulls; ``order`` tells the rows of a key apart or leaves only rows that may
    change places. Columns of ``per_key`` (one row per key) are attached on the way: a key
    has one row per range there, so a key of any size joins without skew. An empty table gives none.
    """
    keys = list(keys)
    # written before use: a repeated task may not draw other ranges
    placed = stage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    at = ["_range", *keys]
    spans = placed.groupBy(*at).agg(*(F.sum(old).alias(f"_in_{new}") for new, old in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(*at, *(F.coalesce(F.sum(f"_in_{new}").over(earlier), F.lit(0)).alias(f"_of_{new}") for new in sums))
    if per_key is not None:
        offsets = offsets.join(per_key, keys)
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.select("*", *(F.coalesce(F.sum(old).over(inside), F.lit(0)).alias(f"_to_{new}") for new, old in sums.items()))
    joined = running.join(offsets, at)
    out = [F.col(c) for c in rows.columns] + [(F.col(f"_to_{new}") + F.col(f"_of_{new}")).alias(new) for new in sums]
    if per_key is not None:
        out += [F.col(c) for c in per_key.columns if c not in keys]
    return joined.select(*out)
