"""Near-duplicates by the weighted Jaccard similarity of word-shingle bags.

A text is the bag (multiset) of its five-word shingles; words are runs of letters, digits and
underscores in lower case, and a text of one to four words is one shingle. BagMinHash draws,
for every shingle and every unit of its multiplicity, a Poisson process of points in time,
each with a signature component; the signature keeps the earliest time of each component, so
two signatures agree in a component with probability equal to the weighted Jaccard similarity.
Units are grouped hierarchically - [0,1), [1,2), [2,4), [4,8), ... - one process for each
group, its points thinned where the multiplicity ends inside the group, and processes stop
as soon as no component can change. Bands of the signature name candidates, and the bags of
every candidate pair are compared exactly.

Defined results: null reads as the empty text; texts without words equal only texts that are
the same; rows of equal text share a class; ``class_id`` is the smallest non-null ``doc_id``
of the class, null if there is none. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import whole_text
from cotejo.session import join_grown, stage

WIDTH = 5
BANDS, ROWS = 28, 6  # a pair at 0.8 shares no band once in 4,900
PROFILE = 256  # hash classes of a bag's profile
WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread bits from any distinct inputs."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Bags of shingle hashes; remembers word hashes up to a bound."""

    def __init__(self, width: int = WIDTH, limit: int = 400_000):
        self.width, self.limit = width, limit
        self.known: dict[str, int] = {}
        self.powers = mix(np.arange(1, width + 1, dtype=np.uint64) * _GOLD) | _ONE

    def hashes(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(one))
        if not k:
            return one
        n = len(one) - k + 1
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total += one[j:j + n] * self.powers[j]
        return mix(total)

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order and their multiplicities."""
        return np.unique(self.hashes(text), return_counts=True)


def signature(items: np.ndarray, counts: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The BagMinHash signature: earliest arrival time of each component."""
    groups = [(items, np.ones(len(items), np.int64), 1)]  # unit [0, 1)
    level, left, have = 0, items, counts
    while True:
        more = have > 1 << level  # units [2**level, 2**(level + 1))
        left, have = left[more], have[more]
        if not len(left):
            break
        groups.append((mix(left + _GOLD * np.arange(level + 1, level + 2, dtype=np.uint64)), have - (1 << level), 1 << level))
        level += 1
    horizon = m * (np.log(m) + 3.0) / counts.sum()
    while True:
        h = np.full(m, np.inf)
        for seeds, covered, rate in groups:
            _arrivals(h, seeds, covered, rate, horizon, m)
        if h.max() <= horizon:
            return h
        horizon *= 1.7


def _arrivals(h: np.ndarray, seeds: np.ndarray, covered: np.ndarray, rate: int,
              horizon: float, m: int) -> None:
    """Lower ``h`` by all points of the processes up to ``horizon``."""
    at, done, step = np.zeros(len(seeds)), 0, 1
    while len(seeds):
        index = np.arange(done + 1, done + step + 1, dtype=np.uint64) * _GOLD
        z = mix(seeds[:, None] + index[None, :])
        u = mix(z ^ _M2)
        gaps = -np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53) / rate
        gaps[:, 0] += at
        times = np.cumsum(gaps, axis=1)
        good = times <= horizon
        if rate > 1:  # a point lies in one unit of the group; it counts if that unit is covered
            unit = (mix(u ^ _M1) >> np.uint64(32)).astype(np.int64) * rate >> 32
            good &= unit < covered[:, None]
        component = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(h, component[good], times[good])
        alive = times[:, -1] <= horizon
        seeds, covered, at = seeds[alive], covered[alive], times[alive, -1]
        done += step
        step = max(1, min(int(rate * horizon / 2) + 4, 1 + 2_000_000 // max(1, len(seeds))))


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = h.view(np.uint64).reshape(bands, rows)
    powers = mix(np.arange(1, rows + 1, dtype=np.uint64) * _GOLD) | _ONE
    return mix((values * powers).sum(axis=1) + np.arange(bands, dtype=np.uint64) * _GOLD)


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][x], b[1][y]).sum())
    total = int(a[1].sum() + b[1].sum()) - low
    return low / total if total else 0.0


# --- the distributed part -----------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")) \
        .withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row per distinct text: node, key, smallest doc_id, band keys."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                items, counts = shingler.bag(text.as_py())
                found.append(band_keys(signature(items, counts, bands * rows), bands, rows).view(np.int64)
                             if len(items) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "key", "bands"])

    every = _keyed(docs).mapInArrow(sign, "doc_id long, key binary, bands array<long>")
    one = every.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    return stage(one.withColumn("node", F.monotonically_increasing_id()))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose bags are at least ``threshold`` alike; stored."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, bag = Shingler(width), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, bag = a[k], shingler.bag(left[k].as_py())
                if bag_similarity(bag, shingler.bag(right[k].as_py())) >= threshold:
                    keep.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[k] for k in keep], pa.int64()),
                                              "b": pa.array([b[k] for k in keep], pa.int64())})

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return stage(join_grown(join_grown(pairs, right, "b"), left, "a").select("a", "b", "left", "right")
                 .mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge; comp is the smallest node it is connected to.

    Alternates large-star and small-star steps on stored tables; nothing leaves the executors.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .distinct())
    while True:
        heads = e.select(F.col("u").alias("v")).distinct()
        if join_grown(e, heads, "v", "left_semi").isEmpty():
            # every edge hangs on a root; a node may hang on several roots until they meet
            if e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_grown(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_grown(large, least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v")))
        e = stage(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return stage(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots))


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (bucket, node, comp) of the buckets that hold more than one component; stored."""
    now = stage(join_grown(members.select("bucket", "node"), comps, "node", "left")
                .select("bucket", "node", F.coalesce("comp", "node").alias("comp")))
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return stage(join_grown(now, mixed.select("bucket"), "bucket"))


def _units(members: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Of the members' bags: their sizes and profiles, and their units that a second bag holds too.

    The second occurrence of a shingle in a bag is a unit of its own, and so on, so that bags
    become sets. A profile counts the units in each of ``PROFILE`` hash classes. Both are
    stored: (node, size, profile) and (node, unit, holders).
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            units, profiles = [], []
            for text in batch.column("text"):
                items, counts = shingler.bag(text.as_py())
                nth = np.arange(counts.sum(), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
                own = mix(np.repeat(items, counts) + nth * _GOLD)
                units.append(own.view(np.int64))
                profiles.append(np.bincount((own >> np.uint64(20)).astype(np.int64) % PROFILE, minlength=PROFILE).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(units, pa.list_(pa.int64())),
                                              pa.array(profiles, pa.list_(pa.int32()))], ["node", "units", "profile"])

    bags = stage(join_grown(texts, members.select("node").distinct(), "node", "left_semi")
                 .mapInArrow(cut, "node long, units array<long>, profile array<int>"))
    each = bags.select("node", F.explode("units").alias("unit"))
    held = each.groupBy("unit").agg(F.count("*").alias("holders")).where("holders > 1")
    return bags.select("node", F.size("units").alias("size"), "profile"), stage(join_grown(each, held, "unit"))


def _can_link(members: DataFrame, sizes: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """(node, size, profile, shared, needed) of the nodes that can be alike to some node of their buckets; stored.

    A pair at the threshold t shares t / (1 + t) of the sum of its sizes, and no node is below
    the smallest of its buckets nor below t times its partner.
    """
    least = join_grown(members, sizes, "node").groupBy("bucket").agg(F.min("size").alias("least"))
    mates = join_grown(members, least, "bucket").groupBy("node").agg(F.min("least").alias("least"))
    shared = common.groupBy("node").agg(F.count("*").alias("shared"))
    partner = F.greatest(F.col("least"), F.lit(threshold) * F.col("size"))
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size") + partner) - 1e-6)
    return stage(join_grown(join_grown(mates, sizes, "node"), shared, "node").withColumn("needed", needed)
                 .where("shared >= needed").select("node", "size", "profile", "shared", "needed"))


def _leader_pairs(members: DataFrame, able: DataFrame) -> DataFrame:
    """Each member with the member of its bucket that has the least text of its own."""
    rated = join_grown(members, able, "node").withColumn("own", 1 - F.col("shared") / F.col("size"))
    leaders = rated.groupBy("bucket").agg(F.min(F.struct("own", "node", "comp")).alias("l"))
    met = join_grown(rated, leaders, "bucket").where("comp <> l.comp")
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def _prefix_pairs(members: DataFrame, able: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components that can still be alike.

    Two bags that share ``needed`` units share one among the ``size - needed + 1`` rarest of
    either, so only these meet. Units that no other bag holds are the rarest and meet nothing.
    Two bags differ in at least as many units as their profiles differ by, and a pair at the
    threshold t differs in (1 - t) / (1 + t) of the sum of its sizes at most, so a pair is
    made only if its profiles allow it. At the first unit that two bags share, in this order, all
    others that they share come later in both, so what is left in either must be enough for them.
    """
    nodes = join_grown(members.select("node", "comp").distinct(), able, "node")
    # one row a node until the rarest are cut out; a bag's units are bounded by its text
    own = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "unit"))).alias("units"))
    first = F.slice("units", F.lit(1), (F.col("shared") - F.col("needed") + 1).cast("int"))
    rarest = join_grown(own, nodes, "node").select("node", "comp", "size", "profile", "shared", F.posexplode(first).alias("at", "u")) \
        .select(F.col("u.unit").alias("unit"), "node", "comp", "size", "profile", (F.col("shared") - F.col("at") - 1).alias("later"))
    rarest = stage(rarest)
    apart = "aggregate(zip_with(x.profile, y.profile, (p, q) -> abs(p - q)), 0, (s, d) -> s + d)"
    most = f"{(1 - threshold) / (1 + threshold)!r}D * (x.size + y.size) + 1e-6D"
    enough = f"1 + least(x.later, y.later) >= {threshold / (1 + threshold)!r}D * (x.size + y.size) - 1e-6D"
    both = join_grown(rarest.alias("x"), rarest.alias("y"), F.expr(f"x.unit = y.unit AND x.comp < y.comp AND {enough} AND {apart} <= {most}"))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH,
                           bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id`` and ``class_id``.

    Classes are the connected components of the links between texts that share a band and
    whose bags are at least ``threshold`` alike. No group is expanded into all its pairs: the
    members of a bucket first meet its smallest node. In buckets that still mix components,
    nodes with too much text of their own to be alike to any mate are done; the others meet
    the member with the least text of its own, and what then is still apart meets by the rarest
    units of its bags, which misses no pair.
    """
    nodes = signed(docs, width, bands, rows)
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    shared = stage(join_grown(buckets, heads.select("bucket", "leader"), "bucket"))
    needed = join_grown(nodes, shared.select("node").distinct(), "node", "left_semi").select("node", "key", "rep")
    texts = join_grown(_keyed(docs), needed, "key").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    texts = stage(texts.groupBy("node").agg(F.first("text").alias("text")))

    star = stage(shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    edges = verified(star, texts, threshold, width)
    final = components(edges)
    members = _mixed(shared, final)
    if not members.isEmpty():
        sizes, common = _units(members, texts, width)
        able = _can_link(members, sizes, common, threshold)
        members = _mixed(join_grown(members, able, "node", "left_semi"), final)
        led = stage(join_grown(_leader_pairs(members, able), star, ["a", "b"], "left_anti"))
        edges = edges.union(verified(led, texts, threshold, width))
        final = components(edges)
        members = _mixed(members, final)
        rest = join_grown(_prefix_pairs(members, able, common, threshold), star.union(led), ["a", "b"], "left_anti")
        edges = edges.union(verified(stage(rest), texts, threshold, width))
        final = components(edges)
    named = join_grown(nodes.select("node", "key", "rep"), final, "node", "left") \
        .withColumn("comp", F.coalesce("comp", "node"))
    lowest = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = stage(join_grown(named, lowest, "comp").select("key", "class_id"))
    return join_grown(_keyed(docs).select("doc_id", "key"), named, "key").select("doc_id", "class_id")


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each class the smallest ``doc_id`` stays.

    A ``doc_id`` that repeats with the same text counts once. Rows without an id are compared
    by equal text only: one of each text stays if no row with an id has it. All columns are kept.
    """
    classes = near_duplicate_classes(docs, **options)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    times = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_kept")).agg((F.count("*") > 1).alias("_again"))
    kept = stage(join_grown(kept, times, "_kept"))
    mine, own = join_grown(docs, kept, docs["doc_id"] == kept["_kept"]), [docs[c] for c in docs.columns]
    once = mine.where(~kept["_again"]).select(*own)
    again = mine.where(kept["_again"]).select(*own).dropDuplicates(["doc_id", "text"])
    named = docs.where("doc_id IS NOT NULL").select(F.md5(whole_text("text").cast("binary")).alias("_key"))
    unnamed = join_grown(docs.where("doc_id IS NULL").dropDuplicates(["text"]), named,
                         F.md5(whole_text("text").cast("binary")) == named["_key"], "left_anti")
    return once.unionByName(again).unionByName(unnamed)
