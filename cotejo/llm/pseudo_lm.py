"""Language-model scores by masked pseudo-likelihood.

A small window network sees the tokens on both sides of a place, never the token itself, and
predicts it; a document's score is the sum of the log probabilities of all its tokens. Tokens
are hashed words and punctuation marks. The prediction has two steps: the network gives the
class of the token, the class gives the token by its share of the class in the corpus.
Classes are bins of equal square-root frequency, so that frequent tokens stand nearly alone.

Texts are cut into tokens once; counting, training and scoring read their bucket numbers. Counts are taken over all documents. Training runs over all documents too, in rounds: each
round deals with the documents of one residue of a hash of ``doc_id``; every task trains a
copy of the network on its part in numpy, and the copies are averaged by their tokens. The
counts, the tables and the network have a fixed size; nothing else reaches the driver.

Defined results: null reads as the empty text, which has no tokens, score 0 and no mean. With
no tokens in the corpus nothing is trained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import kept, whole_text
from cotejo.session import stage

BUCKETS = 1 << 17
CLASSES = 96
FREQUENT = 1024  # tokens with an input vector of their own; others share that of their class
SIDE, WIDTH, HIDDEN = 2, 12, 24
ROUNDS = 4
STEP = 4096
TOKEN = re.compile(r"\w+|[^\w\s]")


class _Known(dict):
    """Bucket by word, found when a word is first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        self[word] = bucket = xxhash.xxh64_intdigest(word) % self.buckets
        return bucket


class Tokens:
    """Bucket numbers of the tokens of texts; remembers words up to a bound."""

    def __init__(self, buckets: int = BUCKETS, limit: int = 500_000):
        self.buckets, self.limit = buckets, limit
        self.known = _Known(buckets)

    def ids(self, text: str) -> np.ndarray:
        found = TOKEN.findall(text.lower())
        known = self.known
        if len(known) > self.limit:
            known.clear()
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


class Tables:
    """What the corpus counts say: input vector, class and share inside the class of each bucket."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, frequent: int = FREQUENT):
        order = np.argsort(-counts, kind="stable")
        root = np.sqrt(counts[order].astype(np.float64))
        place = np.minimum((np.cumsum(root) - root) * classes / max(root.sum(), 1e-9), classes - 1).astype(np.int32)
        self.of_class = np.empty(len(counts), np.int32)
        self.of_class[order] = place
        smooth = counts + 0.1  # tokens outside the corpus
        total = np.bincount(self.of_class, smooth, classes)
        self.inside = (np.log(smooth) - np.log(total[self.of_class])).astype(np.float32)
        self.input = np.empty(len(counts), np.int32)
        self.input[order] = np.where(np.arange(len(counts)) < frequent, np.arange(len(counts)), frequent + place)
        self.bound = frequent + classes  # beyond the ends of a text
        prior = np.bincount(self.of_class, counts + 1e-3, classes)
        self.prior = np.log(prior / prior.sum()).astype(np.float32)


class WindowNet:
    """Input vectors of both sides, one hidden layer, softmax over classes; Adagrad."""

    def __init__(self, tables: Tables, seed: int = 11):
        rng = np.random.default_rng(seed)
        classes, inputs = len(tables.prior), 2 * SIDE * WIDTH
        self.parts = [rng.normal(0, 0.3, (tables.bound + 1, WIDTH)), rng.normal(0, inputs ** -0.5, (inputs, HIDDEN)),
                      np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, classes)), tables.prior]
        self.parts = [p.astype(np.float32) for p in self.parts]
        self.seen = [np.full_like(p, 1e-3) for p in self.parts]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> WindowNet:
        at = 0
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, w1, b1, w2, b2 = self.parts
        x = e[context].reshape(len(context), -1)
        a = np.tanh(x @ w1 + b1)
        z = a @ w2 + b2
        z -= z.max(axis=1, keepdims=True)
        return x, a, z

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, z = self.forward(context)
        return z[np.arange(len(z)), target] - np.log(np.exp(z).sum(axis=1))

    def train(self, context: np.ndarray, target: np.ndarray, rate: float = 0.1) -> None:
        _, w1, _, w2, _ = self.parts
        x, a, z = self.forward(context)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(z)), target] -= 1
        z *= 1.0 / len(z)
        da = (z @ w2.T) * (1 - a * a)
        dx = (da @ w1.T).reshape(-1, WIDTH)
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")
        rows, starts = np.unique(flat[order], return_index=True)
        self._move(0, np.add.reduceat(dx[order], starts, axis=0), rate, rows)
        for k, g in ((1, x.T @ da), (2, da.sum(axis=0)), (3, a.T @ z), (4, z.sum(axis=0))):
            self._move(k, g, rate, slice(None))

    def _move(self, k: int, g: np.ndarray, rate: float, rows) -> None:
        self.seen[k][rows] += g * g
        self.parts[k][rows] -= rate * g / np.sqrt(self.seen[k][rows])


def places(docs: list[np.ndarray], tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of the documents: context inputs, bucket, number of the document."""
    sizes = np.array([len(d) for d in docs])
    gap = np.full(SIDE, -1, np.int64)
    line = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    at = np.flatnonzero(line >= 0)
    inputs = np.where(line >= 0, tables.input[line], tables.bound)
    offsets = [o for o in range(-SIDE, SIDE + 1) if o]
    return np.stack([inputs[at + o] for o in offsets], axis=1), line[at], np.repeat(np.arange(len(docs)), sizes)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))


def tokenised(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per document its bucket numbers as little-endian 32-bit integers; counting, training and scoring read these."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(("tokens", buckets), lambda: Tokens(buckets))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [tokens.ids(t).astype("<i4").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "token_buckets": pa.array(found, pa.binary())})

    return docs if "token_buckets" in docs.columns else _texts(docs).mapInArrow(cut, "doc_id long, token_buckets binary")


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(d, "<i4") for d in column.to_pylist()]


def token_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                total += np.bincount(np.concatenate(_ids(b.column("token_buckets").slice(k, 256))), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    summed = tokenised(docs, buckets).select("token_buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts, found = np.zeros(buckets, np.int64), summed.toArrow()  # ``buckets`` rows at most
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def train_round(docs: DataFrame, tables: Tables, start: np.ndarray, part: int, rounds: int) -> np.ndarray:
    """One round: copies trained on the documents of this part, averaged by their tokens."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n = WindowNet(tables).load(start), 0
        for b in batches:
            for k in range(0, b.num_rows, 64):
                context, bucket, _ = places(_ids(b.column("token_buckets").slice(k, 64)), tables)
                target = tables.of_class[bucket]
                step = max(128, min(STEP, len(bucket) // 8))
                for j in range(0, len(bucket), step):
                    net.train(context[j:j + step], target[j:j + step])
                n += len(bucket)
        if n:
            yield weighted(net.flat().astype(np.float64) * n, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            for net, m in zip(b.column("net"), b.column("n").to_pylist(), strict=True):
                values = np.frombuffer(net.as_py(), np.float64)
                total = values if total is None else total + values
                n += m
        if n:
            yield weighted(total, n)

    def weighted(values: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"net": pa.array([values.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    schema = "net binary, n long"
    cut = tokenised(docs, len(tables.input))
    mine = cut.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == part).select("token_buckets")
    copies = stage(mine.mapInArrow(learn, schema))
    groups = max(1, int(copies.count() ** 0.5))
    found = copies.repartition(groups).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).collect()
    return np.frombuffer(bytes(found[0].net), np.float64) / found[0].n if found else start


def train_pseudo_lm(docs: DataFrame, rounds: int = ROUNDS, buckets: int = BUCKETS) -> tuple[Tables, np.ndarray] | None:
    docs = docs if "token_buckets" in docs.columns else stage(tokenised(docs, buckets))
    counts = token_counts(docs, buckets)
    if not counts.any():
        return None
    tables = Tables(counts)
    net = WindowNet(tables).flat().astype(np.float64)
    for part in range(rounds):
        net = train_round(docs, tables, net, part, rounds)
    return tables, net


def score_pseudo_lm(docs: DataFrame, model: tuple[Tables, np.ndarray] | None) -> DataFrame:
    """Per document: tokens, pseudo log-likelihood, its mean, and the mean under class frequencies alone."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_likelihood"),
                                   F.lit(None).cast("double").alias("mean_log_probability"),
                                   F.lit(None).cast("double").alias("unigram_log_probability"))
    tables, flat = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNet(tables).load(flat)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                docs_here = _ids(part.column("token_buckets"))
                sizes = np.array([len(d) for d in docs_here])
                context, bucket, doc = places(docs_here, tables)
                target, inside = tables.of_class[bucket], tables.inside[bucket].astype(np.float64)
                known = np.concatenate([net.log_probability(context[j:j + STEP], target[j:j + STEP])
                                        for j in range(0, max(1, len(bucket)), STEP)]) if len(bucket) else np.zeros(0)
                total = np.bincount(doc, known + inside, len(docs_here))
                plain = np.bincount(doc, tables.prior[target] + inside, len(docs_here))
                none = sizes == 0
                n = np.maximum(sizes, 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()),
                    "log_likelihood": pa.array(total, pa.float64()),
                    "mean_log_probability": pa.array(total / n, pa.float64(), mask=none),
                    "unigram_log_probability": pa.array(plain / n, pa.float64(), mask=none)})

    return tokenised(docs, len(tables.input)).mapInArrow(score, "doc_id long, n_tokens long, log_likelihood double, "
                                          "mean_log_probability double, unigram_log_probability double")
