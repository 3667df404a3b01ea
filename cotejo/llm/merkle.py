"""Merkle manifest of a table: a hash tree per source, one tree over the sources, versions by path copying.

A node is the SHA-256 of up to three consecutive digests, written as hexadecimal text. Leaves are
the rows; a source's leaves ascend by id, and the sources ascend, null first. The trees are cut into
aligned blocks of 3**7 nodes: a block is one group of a Spark job, its root is a node of the next
tier, so a tree over any number of rows takes a few tiers and no task sees more than a block.

Versions are persistent: tampering with a leaf makes a version that shares every untouched node
and copies only the leaf's ancestors. Inside the leaf's block they are copied there; above it they
go on along the path of the block's root, which the tiers hand down from the root to the blocks.

Defined results: a null field reads ``-``; a null id sorts first and is never tampered with; repeated
rows are leaves of their own (rows with equal leaves change places without effect, equal ids are ordered by leaf); a
lone leaf is its source's root; an empty table gives no rows and has no root. Only the five named columns
count, whatever else the table holds. Whole texts are hashed, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.ranges import prefix_sums
from cotejo.session import stage

FANOUT = 3
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEYS = ["_known", "_name"]
PATH = "k long, block long, lefts array<string>, rights array<string>, subroot string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: Column) -> Column:
    """How many levels lie above ``n`` leaves until one node is left."""
    powers = F.array(*(F.lit(FANOUT ** p).cast("long") for p in range(40)))
    return F.size(F.filter(powers, lambda p: p < n))


# --- inside one block ---------------------------------------------------------------------

def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels of a block from its nodes upwards."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[k:k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return out


def siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's ancestors in their runs, from its own level upwards."""
    lefts, rights = [], []
    for row in levels[:-1]:
        run = place - place % FANOUT
        lefts.append("".join(row[run:place]))
        rights.append("".join(row[place + 1:run + FANOUT]))
        place //= FANOUT
    return lefts, rights


def copied_path(leaf: str, lefts: list[str], rights: list[str]) -> list[str]:
    """The copied ancestors of a leaf, up to the root; all else is shared."""
    out = []
    for left, right in zip(lefts, rights):
        leaf = digest(left + leaf + right)
        out.append(leaf)
    return out


def block_levels(table: pa.Table, levels: int) -> tuple[pa.Table, list[list[str]]]:
    table = table.sort_by("pos")
    tall = min(levels, table.column("height")[0].as_py()) if len(table) else 0
    return table, climb(table.column("digest").to_pylist(), tall)


# --- tiers --------------------------------------------------------------------------------

def tiers(nodes: DataFrame, tallest: int, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Tables ``k, pos, digest, height`` of a forest, from the given nodes up to one node per tree ``k``.

    ``height`` is how many levels the node's tree still has above it, at most ``tallest``.
    """
    def roots(key: tuple, table: pa.Table) -> pa.Table:
        _, up = block_levels(table, levels)
        left = max(0, table.column("height")[0].as_py() - levels)
        return pa.table({"k": [key[0].as_py()], "pos": [key[1].as_py()], "digest": [up[-1][0]], "height": pa.array([left], pa.int32())})

    out, size = [nodes], FANOUT ** levels
    while tallest > 0:
        blocks = out[-1].select("k", F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "digest", "height")
        out.append(stage(blocks.groupBy("k", "block").applyInArrow(roots, "k long, pos long, digest string, height int")))
        tallest -= levels
    return out


def paths_down(tier: list[DataFrame], top: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``PATH`` of the blocks of the lowest tier; ``top`` holds it for the trees (``block`` 0)."""
    size = FANOUT ** levels

    def down(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not len(nodes):
            return pa.table({c: pa.array([], t) for c, t in zip(("k", "block", "lefts", "rights", "subroot"), ARROW_PATH)})
        nodes, up = block_levels(nodes, levels)
        first, path = nodes.column("pos")[0].as_py(), above.to_pylist()[0]
        own = [siblings(up, p - first) for p in nodes.column("pos").to_pylist()]
        return pa.table({"k": nodes.column("k"), "block": nodes.column("pos"),
                         "lefts": pa.array([a + path["lefts"] for a, _ in own], ARROW_PATH[2]),
                         "rights": pa.array([b + path["rights"] for _, b in own], ARROW_PATH[3]),
                         "subroot": pa.array([path["subroot"]] * len(nodes), pa.string())})

    path = top
    for nodes in reversed(tier[1:-1]):
        blocks = nodes.select("k", F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "digest", "height")
        path = stage(blocks.groupBy("k", "block").cogroup(path.groupBy("k", "block")).applyInArrow(down, PATH))
    return path


ARROW_PATH = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())


# --- leaves -------------------------------------------------------------------------------

def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in FIELDS[:-1]), field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, source keys, ``digest`` and ``altered`` (the tampered leaf, null where the row stays) of every row."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNotNull().cast("int").alias("_known"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"), leaf_digest(text).alias("digest"),
        F.when(hit, leaf_digest(F.translate(text, "\n", ""))).alias("altered"), F.monotonically_increasing_id().alias("_row"))


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row's leaf with its proof, and its version after tampering.

    ``k`` and ``pos``: which source and which leaf of it; ``lefts``/``rights``: what stands beside the path, level by
    level up to the root; ``copied``: the path's nodes in the version of ``altered``, or of the leaf itself,
    the last of which is the version's root; ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.
    """
    spark, size = docs.sparkSession, FANOUT ** levels
    rows = stage(leaves(docs))
    counted = stage(rows.groupBy(*KEYS).agg(F.count("*").alias("n")))
    sources = stage(prefix_sums(counted.withColumn("_one", F.lit(1).cast("long")), [], KEYS, {"k": "_one"}).drop("_one"))
    of_sources = sources.agg(F.count("*").alias("n"), F.max(height(F.col("n"))).alias("tall")).first()
    ordered = stage(prefix_sums(rows.withColumn("_one", F.lit(1).cast("long")), KEYS, ["doc_id", "digest", "_row"], {"pos": "_one"}, sources)
                    .select("doc_id", "k", "pos", height(F.col("n")).alias("height"), "digest", "altered"))
    low = tiers(ordered.select("k", "pos", "digest", "height"), max(1, of_sources.tall or 0), levels)
    many = F.lit(of_sources.n).cast("long")
    subroots = low[-1].select(F.lit(0).cast("long").alias("k"), F.col("k").alias("pos"), "digest", height(many).alias("height"))
    high = tiers(stage(subroots), max(1, height_of(of_sources.n)), levels)
    found = high[-1].select("digest").first()
    root = found.digest if found else None
    over = spark.createDataFrame([(0, 0, [], [], "")], PATH)
    # the paths of the subroots: the sources' tree is one more tier below its root
    beside = paths_down([high[0], *high], over, levels) if of_sources.n else over
    named = beside.select(F.col("block").alias("pos"), "lefts", "rights").join(subroots.select("pos", "digest"), "pos") \
        .select(F.col("pos").alias("k"), F.lit(0).cast("long").alias("block"), "lefts", "rights", F.col("digest").alias("subroot"))
    path = paths_down(low, named, levels)

    def finish(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not len(nodes):
            return pa.table({c.name: pa.array([], c.type) for c in ARROW_OUT}, schema=ARROW_OUT)
        nodes, up = block_levels(nodes, levels)
        first, upper = nodes.column("pos")[0].as_py(), above.to_pylist()[0]
        out = {c.name: [] for c in ARROW_OUT}
        for doc, pos, leaf, altered in zip(*(nodes.column(c).to_pylist() for c in ("doc_id", "pos", "digest", "altered"))):
            lefts, rights = siblings(up, pos - first)
            lefts, rights = lefts + upper["lefts"], rights + upper["rights"]
            copied = copied_path(altered or leaf, lefts, rights)
            folded = copied[-1] if copied else altered or leaf
            values = (doc, key[0].as_py(), pos, leaf, altered, lefts, rights, copied, upper["subroot"],
                      digest("".join(a + b for a, b in zip(lefts, rights))), folded)
            for name, value in zip(out, values):
                out[name].append(value)
        return pa.table(out, schema=ARROW_OUT)

    blocks = ordered.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    done = blocks.groupBy("k", "block").cogroup(path.groupBy("k", "block")).applyInArrow(finish, OUT)
    return done.withColumn("root", F.lit(root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))


OUT = ("doc_id long, k long, pos long, leaf string, altered string, lefts array<string>, rights array<string>, copied array<string>, "
       "subroot string, proof_sha256 string, folded_root string")
ARROW_OUT = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("pos", pa.int64()), ("leaf", pa.string()), ("altered", pa.string()),
                       ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("copied", pa.list_(pa.string())),
                       ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def height_of(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def version_nodes(manifest_rows: DataFrame) -> DataFrame:
    """The copied nodes of every version: ``doc_id``, the tampered leaf's ``k`` and ``pos``, ``level`` (1 is above the leaf) and ``digest``."""
    return manifest_rows.where("altered IS NOT NULL").select(
        "doc_id", "k", "pos", F.posexplode("copied").alias("level", "digest")).withColumn("level", F.col("level") + 1)
