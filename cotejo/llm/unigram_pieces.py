"""SentencePiece-style encoding and decoding: the best segmentation under a unigram model.

The text's spaces become the marker U+2581, one more marker stands before the text, and
Viterbi search picks the pieces of highest summed log score. Pieces are found by walking a
double-array trie; a character without a piece becomes its UTF-8 bytes as byte pieces.
Decoding joins the pieces, turns markers into spaces and drops the first: the exact text.

Piece files whose scores are merge ranks get log scores by Zipf's law, -log(rank + 1) less the
log of the sum. No piece joins another character to a marker after it, so a text is cut before
its markers and each worker remembers, up to a bound, the pieces of the words it has seen.

Defined results: null and empty texts have no pieces and decode to the empty text. A text that
holds U+2581 itself keeps it, as byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.llm.common import Memory, kept, whole_text

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie of strings in two arrays: child of node s by code c is base[s] + c if check agrees."""

    def __init__(self, words: list[tuple[str, int]]):
        letters = sorted({c for w, _ in words for c in w})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        words = sorted(([self.code[c] for c in w], v) for w, v in words)
        size = 4 * sum(len(w) for w, _ in words[:1]) + len(letters) + 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free = 1
        todo = [(0, 0, len(words), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo][0]) == depth:
                self.value[node] = words[lo][1]
                lo += 1
            if lo == hi:
                continue
            cuts, codes = [lo], [words[lo][0][depth]]
            for k in range(lo + 1, hi):
                if words[k][0][depth] != codes[-1]:
                    cuts.append(k)
                    codes.append(words[k][0][depth])
            cuts.append(hi)
            slot, tried, taken = max(free, codes[0] + 1), 0, 0
            while True:
                at = slot - codes[0]
                self._room(at + codes[-1])
                if all(self.check[at + c] < 0 for c in codes):
                    break
                tried, taken, slot = tried + 1, taken + (self.check[slot] >= 0), slot + 1
            if tried > 64 and taken > 0.9 * tried:  # nearly full up to here: start later next time
                free = slot
            self.base[node] = at
            for c in codes:
                self.check[at + c] = node
            for c, a, b in zip(codes, cuts, cuts[1:], strict=False):
                todo.append((at + c, a, b, depth + 1))
        # walks may look one full alphabet beyond the last node
        self._room(len(self.check) + len(letters) + 1)

    def _room(self, upto: int) -> None:
        more = upto + 1 - len(self.check)
        if more > 0:
            more += len(self.check)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class UnigramModel:
    """Pieces, their log scores, the trie over them and the two directions."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(k) for k in range(n)]
        special = [sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) for k in range(n)]
        as_byte = [sp.is_byte(k) for k in range(n)]
        normal = [k for k in range(n) if not special[k] and not as_byte[k]]
        if any(MARK in pieces[k].lstrip(MARK) for k in normal):
            raise ValueError("pieces must not join words")
        raw = np.array([sp.get_score(k) for k in range(n)])
        ranks = np.array([-raw[k] for k in normal])
        self.score = np.full(n, 0.0)
        if (ranks == np.floor(ranks)).all():
            log = -np.log(ranks + 1.0)  # merge ranks
            self.score[normal] = log - np.log(np.exp(log).sum())
        else:
            self.score[normal] = raw[normal]
        self.unknown = float(self.score[normal].min()) - UNKNOWN_PENALTY
        self.bytes = {int(pieces[k][3:5], 16): k for k in range(n) if as_byte[k]}
        if len(self.bytes) != 256:
            raise ValueError("all 256 byte pieces are needed")
        self.trie = DoubleArray([(pieces[k], k) for k in normal])
        self.text = [b""] * n
        for k in normal:
            self.text[k] = pieces[k].replace(MARK, " ").encode()
        for b, k in self.bytes.items():
            self.text[k] = bytes([b])
        self.scores = self.score.tolist()
        self.known = Memory(limit)  # by word, for the word after a marker

    def segment(self, s: str) -> list[int]:
        """The best pieces of one segment, by Viterbi over the trie."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, low = len(s), float("-inf")
        codes = [self.trie.code.get(c, 0) for c in s]
        best, start, piece = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, node, j, single = best[i], 0, i, False
            while j < n:
                c = codes[j]
                child = base[node] + c
                if not c or check[child] != node:
                    break
                node, j = child, j + 1
                v = value[node]
                if v >= 0:
                    single = single or j == i + 1
                    new = here + scores[v]
                    if new > best[j]:
                        best[j], start[j], piece[j] = new, i, v
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], start[i + 1], piece[i + 1] = here + self.unknown, i, -1
        out: list[int] = []
        while n:
            i = start[n]
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.bytes[b] for b in reversed(s[i:n].encode()))
            n = i
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if MARK in text:
            first, *rest = text.split(MARK)
            mark = np.array([self.bytes[b] for b in MARK.encode()], np.int32)
            parts = [self._marked(MARK + first.replace(" ", MARK))]
            for part in rest:
                parts += [mark, self._marked(part.replace(" ", MARK))]
            return np.concatenate(parts)
        if "  " in text or text[0] == " ":
            return self._marked(MARK + text.replace(" ", MARK))
        return self._words(text.split(" "))

    def _marked(self, s: str) -> np.ndarray:
        head = s.partition(MARK)[0]
        out = [np.array(self.segment(head), np.int32)] if head else []
        return np.concatenate([*out, self._words([m[1:] for m in SEGMENT.findall(s)])])

    def _words(self, words: list[str]) -> np.ndarray:
        """Pieces of the words, each with one marker before it."""
        for w in self.known.missing(set(words)):
            self.known.young[w] = np.array(self.segment(MARK + w), "<i4").tobytes()
        return np.frombuffer(b"".join(map(self.known.young.__getitem__, words)), "<i4")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _model(path: str) -> UnigramModel:
    return kept(("unigram", path), lambda: UnigramModel(path))


def encode_pieces(docs: DataFrame, model: str, into: str = "piece_ids") -> DataFrame:
    """All columns of ``docs`` and the piece ids of ``text``; a column of that name is replaced.

    ``model`` is the path of a piece file, present on all executors.
    """
    rows = docs.drop(into)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [unigram.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))],
                                                 [*part.schema.names, into])

    return rows.mapInArrow(encode, T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode_pieces(rows: DataFrame, model: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of the piece ids; null ids give null."""
    rows = rows.drop(into)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [None if x.values is None else unigram.decode(x.values.to_pylist()) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*part.schema.names, into])

    return rows.mapInArrow(decode, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text: pieces, their hash, and whether the text came back whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    both = decode_pieces(encode_pieces(rows, model), model)
    return both.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
                       F.xxhash64("piece_ids").alias("pieces_hash"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))
