"""Hard negatives by angular triangle filtering.

Vectors become integers, floor(256 x). Of every row the index stores the norm and the angles to a few
reference directions; rows are range-sorted by their nearest reference and the angle to it. The angle
between an anchor and a row lies between the largest difference of their angles to a reference and
the smallest sum, so its cosine lies in an interval, and times both norms the score does, too. For a
slice of rows the angles' least and greatest values bound all its scores at once; inside a slice, ordered
by angle, the rows that can reach a score form a window. Only slices and windows whose bounds
overlap the wanted scores get integer scoring. Bounds are widened beyond all rounding of angles, so
they never lose a row; scores are exact integers (float64 products below 2**53, 64-bit integers above).

A search runs twice: anchors first meet only the block of rows that holds them, which gives a floor under
the k-th best score; with the floors all anchors meet all rows, block by block, anchors streamed from shared
storage. Nothing is cut off: a floor is a score that k rows reach.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part. Shorter
vectors count as padded with zeros. Rows with equal ids are different rows; ties in score go to the smaller id, null
ids last. An anchor without positives gives no rows; an empty table gives none. Other columns do not matter. Scores have
to fit into 64 bits. References are at most ``REFERENCES`` rows chosen by hash; they steer the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.common import open_fs, shared_folder
from cotejo.session import stage

SCALE = 256.0
REFERENCES = 16
SLICE = 512          # rows whose angles are bounded together
BLOCK = 16_384       # rows that a task holds at once
ANCHORS = 512        # anchors that a block meets at once
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = -(1 << 62), 1 << 62
NO_ID = (1 << 63) - 1

INDEX = "row long, vec_id long, label long, q binary, norm double, angles binary, cell int, angle double"
HITS = "anchor_row long, slot int, anchor_id long, label long, score long, vec_id long, row long"
ARROW_HITS = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("label", pa.int64()),
                        ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])


def integer_rows(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, q`` of the rows that take part; every seventh id has its label moved on."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    return vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(x, lambda v: F.floor(F.lit(SCALE) * v).cast("long")).alias("q"))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Binary 64-bit integers, one vector a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def angles_between(q: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows and their angles to unit vectors; a zero row is at a right angle to all."""
    x = q.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    cos = (x / np.where(norm > 0, norm, 1)[:, None]) @ units.T
    return norm, np.arccos(np.clip(cos, -1, 1))


def build_index(vectors: DataFrame, references: int = REFERENCES) -> tuple[DataFrame, int]:
    """The index table, in the order of cell and angle, and the vectors' length."""
    rows = stage(integer_rows(vectors))
    dims = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 1)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "row").limit(references).select("q").collect()
    units = np.zeros((max(1, len(sample)), dims))
    for k, r in enumerate(sample):
        units[k, :len(r.q)] = r.q
    long = np.sqrt((units * units).sum(axis=1))
    units = np.where(long[:, None] > 0, units / np.where(long > 0, long, 1)[:, None], np.eye(1, dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, lists = np.zeros((b.num_rows, dims), np.int64), b.column("q")
            sizes = np.diff(lists.offsets.to_numpy())
            q[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
            norm, angles = angles_between(q, units)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("vec_id"), b.column("label"), pa.array([v.tobytes() for v in q], pa.binary()), pa.array(norm),
                pa.array([v.tobytes() for v in angles], pa.binary()), pa.array(cell, pa.int32()),
                pa.array(angles[np.arange(len(q)), cell])], names=["row", "vec_id", "label", "q", "norm", "angles", "cell", "angle"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInArrow(place, INDEX)
    return stage(placed.repartitionByRange(tasks, "cell", "angle", "row").sortWithinPartitions("cell", "angle", "row")), dims


# --- one block of rows against anchors ----------------------------------------------------

class Rows:
    """A block of index rows in slices of one cell each."""

    def __init__(self, table: pa.Table, dims: int):
        table = table.combine_chunks()
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        self.vec_id = table.column("vec_id").fill_null(NO_ID).to_numpy()
        self.q, self.norm = matrix(table.column("q"), dims), table.column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), np.float64).reshape(len(self.row), -1)
        self.angle, cell = table.column("angle").to_numpy(), table.column("cell").to_numpy()
        edges = np.flatnonzero((cell[1:] != cell[:-1]) | (self.angle[1:] < self.angle[:-1])) + 1
        self.slices = [(a, min(a + SLICE, end), int(cell[a])) for start, end in zip([0, *edges], [*edges, len(cell)])
                       for a in range(start, end, SLICE)]
        starts = [a for a, _, _ in self.slices]
        self.least = np.minimum.reduceat(self.angles, starts)
        self.most = np.maximum.reduceat(self.angles, starts)
        self.short = np.minimum.reduceat(self.norm, starts)
        self.long = np.maximum.reduceat(self.norm, starts)


class Queries:
    """Anchors and their slots: a wanted interval of scores each."""

    def __init__(self, table: pa.Table, dims: int):
        table = table.combine_chunks()
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        self.vec_id = table.column("vec_id").to_numpy()
        self.q, self.norm = matrix(table.column("q"), dims), table.column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), np.float64).reshape(len(self.row), -1)
        lists = table.column("slots").combine_chunks() if isinstance(table.column("slots"), pa.ChunkedArray) else table.column("slots")
        self.anchor = np.repeat(np.arange(len(self.row)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        self.slot = flat.field("slot").to_numpy()
        self.low, self.high = flat.field("low").to_numpy().copy(), flat.field("high").to_numpy()


def score_bounds(q: Queries, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every anchor in every slice."""
    gap = np.zeros((len(q.row), len(rows.slices)))
    far = np.full_like(gap, np.pi)
    for r in range(q.angles.shape[1]):
        theta, a, b = q.angles[:, [r]], rows.least[:, r], rows.most[:, r]
        np.maximum(gap, np.maximum(a - theta, theta - b), out=gap)
        wide = np.where(theta + b <= np.pi, theta + b, np.where(theta + a >= np.pi, 2 * np.pi - theta - a, np.pi))
        np.minimum(far, wide, out=far)
    near, away = np.cos(gap), np.cos(np.maximum(far, gap))
    slack = slack_of(q.norm[:, None], rows.long)
    most = q.norm[:, None] * np.where(near >= 0, rows.long, rows.short) * near + slack
    least = q.norm[:, None] * np.where(away >= 0, rows.short, rows.long) * away - slack
    return least, most


def slack_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than angles, cosines and norms can lose by rounding (an arc cosine near 0 loses 2**-26)."""
    return 1.0 + 1e-6 * a * b


def exact_scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    if bound < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(hits: list[np.ndarray], k: int) -> np.ndarray:
    """The first ``k`` hits of each query, by score, id and row. Columns: query, score, id, row."""
    if not hits:
        return np.zeros((0, 4), np.int64)
    all_hits = np.concatenate(hits)
    all_hits = all_hits[np.lexsort((all_hits[:, 3], all_hits[:, 2], -all_hits[:, 1], all_hits[:, 0]))]
    starts = np.flatnonzero(np.r_[True, all_hits[1:, 0] != all_hits[:-1, 0]])
    rank = np.arange(len(all_hits)) - np.repeat(starts, np.diff(np.r_[starts, len(all_hits)]))
    return all_hits[rank < k]


def search_block(q: Queries, rows: Rows, k: int, same: bool) -> np.ndarray:
    """The first ``k`` rows of this block for every slot, columns as in ``best``."""
    least, most = score_bounds(q, rows)
    order = np.argsort(-most.max(axis=0), kind="stable")  # promising slices first: floors rise early
    held, waiting = np.zeros((0, 4), np.int64), []
    top = np.full(len(q.row), LOWEST)
    np.maximum.at(top, q.anchor, q.high)
    for s in order:
        low = np.full(len(q.row), HIGHEST)
        np.minimum.at(low, q.anchor, q.low)
        a, b, cell = rows.slices[s]
        live = np.flatnonzero((most[:, s] >= low) & (least[:, s] <= top))
        if not len(live):
            continue
        # rows of the slice whose angle to their own reference lets them reach the least wanted score
        slack, reach = slack_of(q.norm[live], rows.long[s]), q.norm[live] * rows.long[s]
        cos = np.where(low[live] - slack > 0, (low[live] - slack) / np.where(reach > 0, reach, 1), -1)
        delta = np.where(cos > 1, -1.0, np.arccos(np.clip(cos, -1, 1)) + 1e-6)
        own = q.angles[live, cell]
        first = np.searchsorted(rows.angle[a:b], own - delta, "left")
        last = np.searchsorted(rows.angle[a:b], own + delta, "right")
        live, first, last = (v[last > first] for v in (live, first, last))
        if not len(live):
            continue
        a, b = a + int(first.min()), a + int(last.max())
        scores = exact_scores(q.q[live], rows.q[a:b], float(q.norm[live].max() * rows.long[s]))
        alike = q.label[live][:, None] == rows.label[a:b]
        wanted = (alike & (q.row[live][:, None] != rows.row[a:b])) if same else ~alike
        at = np.full(len(q.row), -1)
        at[live] = np.arange(len(live))
        slots = np.flatnonzero(at[q.anchor] >= 0)
        mine = at[q.anchor[slots]]
        found, column = np.nonzero(wanted[mine] & (scores[mine] >= q.low[slots][:, None]) & (scores[mine] <= q.high[slots][:, None]))
        if not len(found):
            continue
        waiting.append(np.stack([slots[found], scores[mine[found], column], rows.vec_id[a + column], rows.row[a + column]], axis=1))
        if sum(map(len, waiting)) > 4 * k * len(q.slot):
            held = best([held, *waiting], k)
            waiting = []
            raise_floors(q, held, k)
    return best([held, *waiting], k)


def raise_floors(q: Queries, held: np.ndarray, k: int) -> None:
    """A slot with ``k`` hits wants no less than the last of them."""
    many = np.bincount(held[:, 0], minlength=len(q.slot))
    least = np.full(len(q.slot), HIGHEST)
    np.minimum.at(least, held[:, 0], held[:, 1])
    q.low = np.where(many >= k, np.maximum(q.low, least), q.low)


# --- searches -----------------------------------------------------------------------------

def search(index: DataFrame, queries: DataFrame, dims: int, k: int, same: bool, own: bool) -> DataFrame:
    """``HITS``: for every slot the first ``k`` rows of each block; with ``own`` only of the block that holds the anchor.

    ``queries``: index columns and ``slots``, an array of ``slot, low, high``.
    """
    columns = ["row", "vec_id", "label", "q", "norm", "angles", "slots"]
    uri = shared_folder(index.sparkSession, "anchors")
    if not own:
        queries.select(columns).write.mode("overwrite").parquet(uri)

    def streamed() -> Iterator[Queries]:
        import pyarrow.dataset as ds

        files, path = open_fs(uri)
        for b in ds.dataset(path, filesystem=files, format="parquet").to_batches(columns=columns, batch_size=ANCHORS):
            if b.num_rows:
                yield Queries(pa.Table.from_batches([b]), dims)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            rows = Rows(table, dims)
            if own:
                anchors = table.filter(table.column("slots").is_valid())
                asked = (Queries(anchors.slice(at, ANCHORS), dims) for at in range(0, len(anchors), ANCHORS))
            else:
                asked = streamed()
            for q in asked:
                hits = search_block(q, rows, k, same)
                if len(hits):
                    anchor, ids = q.anchor[hits[:, 0]], hits[:, 2]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(q.row[anchor]), pa.array(q.slot[hits[:, 0]], pa.int32()), pa.array(q.vec_id[anchor]), pa.array(q.label[anchor]),
                        pa.array(hits[:, 1]), pa.array(ids, mask=ids == NO_ID), pa.array(hits[:, 3])], schema=ARROW_HITS)

    rows = index.join(queries.select("row", "slots"), "row", "left").sortWithinPartitions("cell", "angle", "row") if own else index
    return rows.mapInArrow(meet, HITS)


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def first_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def with_floors(queries: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``queries`` whose slots want no less than the ``k``-th hit of their own block."""
    floors = first_hits(seeds, k).where(F.col("place") == k).groupBy(F.col("anchor_row").alias("row")) \
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))
    raised = F.transform("slots", lambda s: F.struct(
        s["slot"].alias("slot"), F.greatest(s["low"], F.coalesce(F.try_element_at("floors", s["slot"]), s["low"])).alias("low"),
        s["high"].alias("high")))
    return queries.join(floors, "row", "left").withColumn("slots", raised).drop("floors")


def found(index: DataFrame, queries: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    queries = stage(queries)
    seeds = stage(search(index, queries, dims, k, same, True))
    return stage(first_hits(search(index, with_floors(queries, seeds, k), dims, k, same, False), k))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = 30, most: int = 90, references: int = REFERENCES) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels whose score lies between ``least`` and ``most`` per cent of
    the positive's."""
    index, dims = build_index(vectors, references)
    slot = "array(named_struct('slot', 0, 'low', {0}L, 'high', {1}L))".format(LOWEST, HIGHEST)
    anchors = index.where(F.col("vec_id") % every == 0)
    near = found(index, anchors.withColumn("slots", F.expr(slot)), dims, positives, True)
    low = F.ceil(F.lit(least).cast("decimal(20,0)") * F.col("score") / F.lit(100)).cast("long")
    high = F.floor(F.lit(most).cast("decimal(20,0)") * F.col("score") / F.lit(100)).cast("long")
    wanted = near.select("anchor_row", F.struct(F.col("place").cast("int").alias("slot"), low.alias("low"), high.alias("high")).alias("s")) \
        .groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list("s")).alias("slots"))
    away = found(index, anchors.join(wanted, "row"), dims, negatives, False)
    of = near.select("anchor_row", F.col("place").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"),
                     F.col("score").alias("positive_score"))
    return away.join(of, ["anchor_row", "slot"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
