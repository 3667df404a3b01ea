"""Toxicity by multiple-instance learning: documents carry labels, sentences carry the blame.

A sentence scores p = sigmoid(bias + sum of the weights of its distinct words); a document is
toxic unless every sentence is clean: score = 1 - product(1 - p), the noisy-or. The weights
are learnt from document labels alone, so the sentence scores say where the offence is.
Features of words are hashed into a fixed number of weights; only the text is an input.

Defined results: null reads as the empty text, whose score is that of a sentence without
words. Labels that are null are not used. Without any usable label every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import kept, MEMORY, whole_text, word_bytes
from cotejo.llm.sampling import fit_in_one_task, labelled_sample

DIM = 1 << 18
SAMPLE = 12_000  # labelled documents used for fitting, at most
TOKEN = re.compile(r"\w+|[.!?\n]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
BREAK = -1


class Words:
    """Words of a text, the sentence each stands in, and the hashed features of a word.

    A word's features are itself and its character sequences of four and five, ends marked,
    so that forms of a word that were never seen share most of their weights with it.
    """

    def __init__(self, dim: int = DIM, limit: int = 400_000):
        self.dim, self.limit = dim, limit
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.held = 0

    def parse(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct (sentence, word) pairs as two arrays, and the number of sentences.

        Sentences are numbered among those that hold a word; a word is its place in ``words``.
        """
        tokens = TOKEN.findall(text.lower())
        known = self.known
        for t in set(tokens).difference(known):
            if t[0] in ".!?\n":
                known[t] = BREAK
            else:
                known[t] = len(self.words)
                self.words.append(t)
                self.held += word_bytes(t)
        ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        breaks = ids == BREAK
        sentence = np.cumsum(breaks) - breaks
        pairs = np.unique(sentence[~breaks] << 32 | ids[~breaks])
        used, number = np.unique(pairs >> 32, return_inverse=True)
        return number, pairs & 0xFFFFFFFF, max(1, len(used))

    def full(self) -> bool:
        """Whether to forget; to be asked between texts, as places change."""
        if len(self.words) <= self.limit and self.held <= MEMORY:
            return False
        self.known.clear()
        self.words.clear()
        self.held = 0
        return True

    def features(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        parts = {marked[k:k + n] for n in (4, 5) for k in range(len(marked) - n + 1)} | {"=" + word}
        return np.fromiter((xxhash.xxh64_intdigest(x) % self.dim for x in sorted(parts)), np.int64, len(parts))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def sentence_scores(worth: np.ndarray, bias: float, number: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """``worth``: the summed weights of each word's features."""
    return sigmoid(bias + np.bincount(number, worth[words], n))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum()))


def fit_noisy_or(table: pa.Table, dim: int = DIM, epochs: int = 12, rate: float = 0.5, batch: int = 64,
                 decay: float = 1e-5, least: int = 8, seed: int = 7) -> bytes:
    """Weights and bias by Adagrad on the noisy-or likelihood of the document labels.

    A feature counts by its inverse document frequency, so that what is everywhere moves little;
    one of fewer than ``least`` documents keeps weight 0, as it could only learn by heart.
    """
    order = np.lexsort((table["label"].to_numpy(), table["doc_id"].to_numpy()))
    label = table["label"].to_numpy()[order].astype(np.float64)
    count = table["sentences"].to_numpy()[order]
    source, vocabulary, features = Words(dim), {}, []
    words: list[np.ndarray] = []  # of each document's (sentence, word) pairs
    number: list[np.ndarray] = []
    frequency = np.zeros(dim, np.int64)
    for k in order.tolist():
        own = []
        for w in table["words"][k].as_py():
            if w not in vocabulary:
                vocabulary[w] = len(features)
                features.append(source.features(w).astype(np.int32))
            own.append(vocabulary[w])
        if own:
            frequency[np.unique(np.concatenate([features[w] for w in own]))] += 1
        words.append(np.array(own, np.int32)[table["place"][k].values.to_numpy()])
        number.append(table["number"][k].values.to_numpy())
    flat = np.concatenate([*features, np.zeros(0, np.int32)])
    sizes = np.array([len(f) for f in features], np.int64)
    begins = np.cumsum(sizes) - sizes
    weights, bias = np.zeros(dim), -5.0
    seen, seen_bias = np.full(dim, 1e-2), 1e-2
    value = np.where(frequency >= least, np.log((1.0 + len(label)) / (1.0 + frequency)), 0.0)
    rng = np.random.default_rng(seed)
    batch = max(16, min(batch, len(label) // 100))
    for _ in range(epochs):
        turn = rng.permutation(len(label))
        for k in range(0, len(turn), batch):
            part = turn[k:k + batch]
            starts = np.concatenate([[0], np.cumsum(count[part])])
            used, word = np.unique(np.concatenate([words[i] for i in part]), return_inverse=True)
            sent = np.concatenate([number[i] + starts[j] for j, i in enumerate(part)])
            doc = np.repeat(np.arange(len(part)), count[part])
            size, here = sizes[used], np.cumsum(sizes[used]) - sizes[used]
            feature = flat[np.repeat(begins[used] - here, size) + np.arange(size.sum())]
            worth = np.add.reduceat((weights * value)[feature], here) if len(used) else np.zeros(0)
            z = bias + np.bincount(sent, worth[word], starts[-1])
            p = sigmoid(z)
            clean = np.bincount(doc, -np.logaddexp(0, z), len(part))  # log(1 - score)
            y = label[part]
            toxic = -np.expm1(clean)
            pull = np.where(y > 0, -np.exp(clean) / np.maximum(toxic, 1e-12), 1.0)
            slope = p * pull[doc]
            pulled = np.repeat(np.bincount(word, slope[sent], len(used)), size)
            grad = value * np.bincount(feature, pulled, dim) / len(part)
            grad += decay * weights * (grad != 0)
            seen += grad * grad
            weights -= rate * grad / np.sqrt(seen)
            g = slope.sum() / len(part)
            seen_bias += g * g
            bias -= 0.1 * rate * g / np.sqrt(seen_bias)
    return np.concatenate([[bias], weights * value]).astype("<f4").tobytes()


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE,
                   dim: int = DIM) -> bytes:
    """The model, from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Words(dim)
        for b in batches:
            numbers, places, words, sizes = [], [], [], []
            for t in b.column("text"):
                parser.full()
                number, used, n = parser.parse(t.as_py())
                own, place = np.unique(used, return_inverse=True)
                numbers.append(number.astype(np.int32))
                places.append(place.astype(np.int32))
                words.append([parser.words[w] for w in own.tolist()])
                sizes.append(n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "label": b.column("label"),
                "number": pa.array(numbers, pa.list_(pa.int32())), "place": pa.array(places, pa.list_(pa.int32())),
                "words": pa.array(words, pa.list_(pa.string())), "sentences": pa.array(sizes, pa.int64())})

    sample = labelled_sample(docs, labels, label, most, F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"))
    features = sample.mapInArrow(parse, "doc_id long, label int, number array<int>, place array<int>, words array<string>, sentences long")
    return fit_in_one_task(features, lambda t: fit_noisy_or(t, dim))


class Scorer:
    """Scores texts under a model; keeps the summed weights of words it has seen, up to a bound."""

    def __init__(self, model: bytes, dim: int = DIM):
        values = np.frombuffer(model, "<f4").astype(np.float64)
        self.bias, self.weights = (values[0], values[1:]) if len(values) else (-1e3, np.zeros(dim))
        self.words, self.worth, self.filled = Words(dim), np.zeros(1024), 0

    def sentences(self, text: str) -> np.ndarray:
        if self.words.full():
            self.filled = 0
        number, ids, n = self.words.parse(text)
        known = len(self.words.words)
        if known > len(self.worth):
            self.worth = np.concatenate([self.worth, np.zeros(known)])
        for k in range(self.filled, known):
            self.worth[k] = self.weights[self.words.features(self.words.words[k])].sum()
        self.filled = known
        return sentence_scores(self.worth, self.bias, number, ids, n)


def score_toxicity(docs: DataFrame, model: bytes, dim: int = DIM) -> DataFrame:
    """Per document: score, 0/1 prediction, its worst sentence as a span of characters and that score.

    The span is given for documents predicted toxic.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("toxicity", hash(model)), lambda: Scorer(model, dim))
        for b in batches:
            out = []
            for text in b.column("text"):
                text = text.as_py()
                p = scorer.sentences(text)
                total, worst = noisy_or(p), int(p.argmax())
                start, end = span_of(text, worst) if total >= 0.5 else (0, 0)
                out.append((total, int(total >= 0.5), len(p), start, end, float(p[worst])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "score", "predicted", "sentences", "worst_start", "worst_end", "worst_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, predicted int, sentences int, "
                                  "worst_start long, worst_end long, worst_score double")


def without_toxic(docs: DataFrame, model: bytes, below: float = 0.5, dim: int = DIM) -> DataFrame:
    """The documents that score less than ``below``, all columns kept."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("toxicity", hash(model)), lambda: Scorer(model, dim))
        for b in batches:
            yield b.filter(pa.array([noisy_or(scorer.sentences(t.as_py() or "")) < below for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def span_of(text: str, number: int) -> tuple[int, int]:
    """Where the sentence with words of this number stands."""
    seen = -1
    for m in SENTENCE.finditer(text):
        if re.search(r"\w", m[0]):
            seen += 1
            if seen == number:
                return m.start(), m.end()
    return 0, len(text)
