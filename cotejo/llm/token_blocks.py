"""Token-id files in patched frame-of-reference blocks.

A shard file holds the ids of a contiguous range of documents in ascending ``doc_id`` order:

    magic | block* | footer | trailer
    block   = u32 minimum, u16 values - 1, u8 width, u16 exceptions,
              packed low bits, u16 exception positions[], u32 exception values[]
    footer  = u64 block start[], i64 doc_id[], u8 doc_id is null[], u64 ids of the document[]
    trailer = u64 footer start, u32 blocks, u64 documents, magic

Each block subtracts its minimum and packs at the width that covers a chosen percentile of
its values; the few larger values are stored in full in an exception list. The width is the
percentile of a short ladder that makes the block smallest. Block starts are indexed, so any
id range can be read by seeking.

Empty and null texts hold only the end id. Rows that share a ``doc_id`` stay separate, ordered
by text; a null ``doc_id`` comes first. An empty table has no shards.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.common import Memory, kept, open_fs, shared_folder, whole_text
from cotejo.session import stage

MAGIC = b"PFORIDS1"
BLOCK = 4096
LADDER = (0.80, 0.90, 0.95, 0.99, 1.0)
HEAD = "<IHBH"
TRAILER = "<QIQ8s"
SHARD_SCHEMA = "path string, first_doc long, n_docs long, n_tokens long, n_bytes long"


# --- blocks -------------------------------------------------------------------------------

def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned value below 2**32."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of packed bytes."""
    rows, n = values.shape
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(rows, n, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width:].reshape(rows, n * width), axis=1)


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width:] = bits
    return np.packbits(full, axis=1).view(">u4").reshape(n).astype(np.uint32)


def encode_blocks(ids: np.ndarray, ladder: tuple[float, ...] = LADDER) -> list[bytes]:
    """Blocks of equal length, given as rows of ``ids``."""
    rows, n = ids.shape
    low = ids.min(axis=1)
    delta = ids - low[:, None]
    ordered = np.sort(delta, axis=1)
    at = np.minimum(n - 1, np.ceil(np.array(ladder) * n).astype(np.int64) - 1)
    widths = bit_length(ordered[:, at])
    over = np.stack([(delta >> widths[:, [k]].astype(np.uint32) != 0).sum(axis=1)
                     for k in range(len(ladder))], axis=1)
    cost = (widths * n + 7) // 8 + 6 * over
    width = widths[np.arange(rows), cost.argmin(axis=1)]
    out: list[bytes] = [b""] * rows
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        mask = np.uint32((1 << int(w)) - 1)
        packed = pack(delta[mine] & mask, int(w)) if w else np.zeros((len(mine), 0), np.uint8)
        for k, r in enumerate(mine):
            odd = np.flatnonzero(delta[r] > mask)
            out[r] = (struct.pack(HEAD, int(low[r]), n - 1, int(w), len(odd)) + packed[k].tobytes()
                      + odd.astype("<u2").tobytes() + delta[r, odd].astype("<u4").tobytes())
    return out


def decode_block(data: bytes) -> np.ndarray:
    low, last, width, odd = struct.unpack_from(HEAD, data)
    n, at = last + 1, struct.calcsize(HEAD)
    size = (n * width + 7) // 8
    values = unpack(data[at:at + size], n, width) if width else np.zeros(n, np.uint32)
    if odd:
        places = np.frombuffer(data, "<u2", odd, at + size)
        values[places] = np.frombuffer(data, "<u4", odd, at + size + 2 * odd)
    return values + np.uint32(low)


# --- shard files --------------------------------------------------------------------------

class ShardWriter:
    """Streams documents into one shard file; holds one group of blocks and the document index."""

    def __init__(self, out, block: int = BLOCK, ladder: tuple[float, ...] = LADDER, group: int = 64):
        self.out, self.block, self.ladder, self.group = out, block, ladder, group
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.at = len(MAGIC)
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block * self.group:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        rows = len(ids) // self.block
        for k in range(0, rows, self.group):
            upto = min(rows, k + self.group)
            part = ids[k * self.block:upto * self.block].reshape(-1, self.block)
            self._emit(encode_blocks(part, self.ladder))
        rest = ids[rows * self.block:]
        if last and len(rest):
            self._emit(encode_blocks(rest.reshape(1, -1), self.ladder))
            rest = rest[:0]
        self.waiting, self.held = [rest], len(rest)

    def _emit(self, blocks: list[bytes]) -> None:
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
            self.out.write(b)

    def close(self) -> int:
        self._flush(True)
        ids = [d for d, _ in self.docs]
        self.out.write(np.array(self.starts, "<u8").tobytes()
                       + np.array([d or 0 for d in ids], "<i8").tobytes()
                       + np.array([d is None for d in ids], "u1").tobytes()
                       + np.array([n for _, n in self.docs], "<u8").tobytes())
        self.out.write(struct.pack(TRAILER, self.at, len(self.starts), len(self.docs), MAGIC))
        return self.at + 8 * len(self.starts) + 17 * len(self.docs) + struct.calcsize(TRAILER)


class ShardReader:
    """Reads a shard by seeking: the index first, then one block at a time."""

    def __init__(self, source, size: int):
        source.seek(size - struct.calcsize(TRAILER))
        self.end, blocks, docs, magic = struct.unpack(TRAILER, source.read(struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(self.end)
        foot = source.read(size - struct.calcsize(TRAILER) - self.end)
        self.source = source
        self.starts = np.frombuffer(foot, "<u8", blocks)
        self.ids = np.frombuffer(foot, "<i8", docs, 8 * blocks)
        self.null = np.frombuffer(foot, "u1", docs, 8 * blocks + 8 * docs)
        self.sizes = np.frombuffer(foot, "<u8", docs, 8 * blocks + 9 * docs)

    def block(self, k: int) -> np.ndarray:
        upto = self.starts[k + 1] if k + 1 < len(self.starts) else self.end
        self.source.seek(int(self.starts[k]))
        return decode_block(self.source.read(int(upto - self.starts[k])))

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Document id, number of ids, and its ids in pieces of a block at most."""
        k, piece = 0, np.zeros(0, np.uint32)

        def take(n: int) -> Iterator[np.ndarray]:
            nonlocal k, piece
            while n:
                if not len(piece):
                    piece, k = self.block(k), k + 1
                now = piece[:n]
                piece = piece[len(now):]
                n -= len(now)
                yield now

        for doc, null, n in zip(self.ids, self.null, self.sizes, strict=True):
            yield (None if null else int(doc)), int(n), take(int(n))


# --- encoding -----------------------------------------------------------------------------

#: The byte-level pattern joins a space to what follows it, also to other white space, but never to
#: a character before it that is no white space: there, and only there, a text is cut.
SPLIT = re.compile(r"(?<=\S) ")
#: White space before a space: texts without any of these are cut at every space but a leading one.
WHITE_ASCII = tuple(c + " " for c in map(chr, range(128)) if c.isspace())
WHITE = tuple(c + " " for c in map(chr, range(0x3001)) if c.isspace())

LINES = 512  # words given to the library as one text


def cut_words(text: str) -> list[str]:
    """The text before the first cut, then what follows the space of each cut."""
    if text[:1] == " " or any(w in text for w in (WHITE_ASCII if text.isascii() else WHITE)):
        return SPLIT.split(text)
    return text.split(" ")


class PieceEncoder:
    """The tokenizers library behind a bounded memory of what it returned for each word.

    Texts that contain the string of an added token go to the library whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known = Memory(limit)  # by word, for the word after a space
        # a line break after a word is a token of its own, and no word without one yields its id
        line = self.lib.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and not any("\n" in a for a in self.added) else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space, each after a space: lines of one text, cut at their line breaks."""
        if self.line is None or not words:
            return self._ids([" " + w for w in words])
        ids = np.array(self.lib.encode_batch_fast([" " + "\n ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * np.flatnonzero(ids == self.line)).tolist()
        if len(at) != len(words) - 1:
            return self._ids([" " + w for w in words])
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *(k + 4 for k in at)], [*at, len(raw)], strict=True)]

    def after_space(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word after a space."""
        every = "".join(words)
        if every.isprintable() and " " not in every and "" not in words:
            return dict(zip(words, self._lines(words), strict=True))
        plain = [w for w in words if w.isprintable() and w and " " not in w]
        found = dict(zip(plain, self._lines(plain), strict=True))
        odd = [w for w in words if w not in found]
        found.update(zip(odd, self._ids([" " + w for w in odd]), strict=True))
        return found

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        cut: list[list[str]] = []
        for t in texts:
            if any(a in t for a in self.added):
                cut.append([t])
            else:
                cut.append(cut_words(t))
        heads = self._ids([ws.pop(0) for ws in cut])
        new = self.known.missing(set().union(*cut))
        for k in range(0, len(new), LINES):
            self.known.young.update(self.after_space(new[k:k + LINES]))
        look = self.known.young.__getitem__
        return [np.frombuffer(b"".join([head, *map(look, ws)]), "<u4") for head, ws in zip(heads, cut, strict=True)]


def small_batches(batch: pa.RecordBatch, names: list[str], most: int = 256):
    """Column values of a record batch as Python lists of at most ``most`` rows."""
    for k in range(0, batch.num_rows, most):
        part = batch.slice(k, most)
        yield [part.column(n).to_pylist() for n in names]


def write_token_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2,
                       block: int = BLOCK, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """Encode every text, append ``end_id`` and write shard files; one row per shard.

    ``tokenizer`` is the path of a tokenizer file with the byte-level word pattern, present on
    all executors. Shards cover disjoint ``doc_id`` ranges.
    The rows name the files that count: a repeated task writes under another name.
    """
    if not 1 <= block <= 65536:
        raise ValueError("a block holds 1 to 65,536 ids")
    folder = folder or shared_folder(docs.sparkSession, "token-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = out = None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for ids, texts in small_batches(batch, ["doc_id", "text"]):
                if writer is None:
                    fs, base = open_fs(folder)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pfor"
                    encoder = kept(("pieces", tokenizer), lambda: PieceEncoder(tokenizer))
                    out = fs.open_output_stream(f"{base}/{name}")
                    writer, first = ShardWriter(out, block, ladder), ids[0]
                for doc, found in zip(ids, encoder.batch(texts), strict=True):
                    writer.add(doc, np.concatenate([found, end]))
        if writer is not None:
            n_bytes = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "first_doc": pa.array([first], pa.int64()),
                "n_docs": [len(writer.docs)], "n_tokens": [writer.total], "n_bytes": [n_bytes]})

    rows = docs.select(F.col("doc_id").cast("long"), whole_text("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(write, SHARD_SCHEMA))


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Read shard files back: per document its place, size and checksum.

    ``start`` counts the ids of all documents before it, over all shards in order.
    """
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "path")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.withColumn("base", F.coalesce(before, F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(),
                                  batch.column("base").to_pylist(), strict=True):
                fs, name = open_fs(path)
                found: list[tuple] = []
                with fs.open_input_file(name) as source:
                    for doc, n, pieces in ShardReader(source, source.size()).documents():
                        crc = 0
                        for ids in pieces:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        found.append((doc, base, n, crc))
                        base += n
                        if len(found) == 10_000:
                            yield rows(found)
                            found = []
                if found:
                    yield rows(found)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few, their files are not
    spread = placed.select("path", "base").repartition(tasks, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
