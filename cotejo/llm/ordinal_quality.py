"""Quality by ordinal regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut
the line it scores on: P(grade > k) = sigmoid(score - threshold[k]). That gives the expected
grade and the probability of reaching a grade, by which documents are selected.

Features of a word are the character trigrams and the shape of the word; of a text, how often
a word repeats the one before, how varied its words are and how many of its lines repeat.
Each is hashed; a text's score is the mean of its words' weights plus the weights of the text.

Defined results: null reads as the empty text, which has no words. Null ratings are not used;
without any rating every document gets the middle of an unknown scale: expected grade 0 and
probability 1, so that nothing is rejected. With one grade only, that grade is expected.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.common import Memory, kept, whole_text
from cotejo.llm.sampling import fit_in_one_task, labelled_sample
from cotejo.llm.toxicity_mil import sigmoid

DIM = 1 << 16
SAMPLE = 12_000  # rated documents used for fitting, at most


class Features:
    """Hashed features of words and of whole texts. Those of words of usual length are remembered, up to a bound."""

    def __init__(self, dim: int = DIM, limit: int = 200_000):
        self.dim, self.limit = dim, limit
        self.known: dict[str, np.ndarray] = {}

    def place(self, feature: str) -> int:
        return xxhash.xxh64_intdigest(feature) % self.dim

    def word(self, w: str) -> np.ndarray:
        marked = f"^{w}$"
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
        shape = re.sub(r"(.)\1+", r"\1", shape)
        return np.array([self.place("s" + shape)] + [self.place("t" + marked[k:k + 3]) for k in range(len(marked) - 2)])

    def text(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words, and the places of the text's own features."""
        words = text.split()
        n = max(1, len(words))
        again = sum(map(str.__eq__, words, words[1:])) / n
        lines = [x for x in text.split("\n") if x]
        own = [f"again{int(again * 20)}", f"varied{int(len(set(words)) / n * 20)}.{min(6, n.bit_length() // 2)}",
               f"lines{int(len(set(lines)) / max(1, len(lines)) * 10)}", f"size{n.bit_length()}"]
        return words, np.array([self.place(x) for x in own])

    def of_words(self, words: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.known.clear()
        long: dict[str, np.ndarray] = {}
        for w in set(words).difference(self.known):
            (self.known if len(w) <= 64 else long)[w] = self.word(w)
        return [self.known[w] if w in self.known else long[w] for w in words]


def fit_ordinal(table: pa.Table, dim: int = DIM, epochs: int = 120, rate: float = 0.5, decay: float = 1e-6) -> bytes:
    """Weights and thresholds by Adam on the cumulative-link likelihood."""
    grades = np.unique(table["label"].to_numpy())
    grade = np.searchsorted(grades, table["label"].to_numpy())
    idx = [x.values.to_numpy() for x in table["idx"]]
    val = np.concatenate([x.values.to_numpy() for x in table["val"]]).astype(np.float64)
    row = np.repeat(np.arange(len(idx)), [len(x) for x in idx])
    col = np.concatenate(idx).astype(np.int64)
    used, col = np.unique(col, return_inverse=True)
    cuts = len(grades) - 1
    share = np.array([(grade > k).mean() for k in range(cuts)])
    theta = -np.log(share / (1 - share))  # thresholds of a model without features
    w = np.zeros(len(used))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
    for t in range(1, epochs + 1 if cuts else 1):
        score = np.bincount(row, val * w[col], len(grade))
        # P(grade = g) = P(> g-1) - P(> g); its log has slopes in the two thresholds around g
        up = np.concatenate([np.ones((len(grade), 1)), sigmoid(score[:, None] - theta[None, :]),
                             np.zeros((len(grade), 1))], axis=1)
        here = np.arange(len(grade))
        hi, lo = up[here, grade], up[here, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = -(d_hi - d_lo) / len(grade)
        d_theta = np.array([d_hi[grade == k + 1].sum() - d_lo[grade == k].sum() for k in range(cuts)]) / len(grade)
        d_w = np.bincount(col, val * d_score[row], len(used)) + decay * w
        for x, g, m, v, step in ((w, d_w, state[0], state[1], rate), (theta, d_theta, state[2], state[3], 0.1 * rate)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        theta = np.maximum.accumulate(theta)
    full = np.zeros(dim, "<f4")
    full[used] = w
    return struct.pack("<I", len(grades)) + grades.astype("<f8").tobytes() + theta.astype("<f8").tobytes() + full.tobytes()


def unpack_model(model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grades, thresholds and weights."""
    if not model:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    n = struct.unpack_from("<I", model)[0]
    grades = np.frombuffer(model, "<f8", n, 4)
    theta = np.frombuffer(model, "<f8", n - 1, 4 + 8 * n)
    return grades, theta, np.frombuffer(model, "<f4", offset=4 + 8 * (2 * n - 1)).astype(np.float64)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, dim: int = DIM) -> bytes:
    """The model from at most ``most`` rated documents."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dim)
        for b in batches:
            idx, val = [], []
            for text in b.column("text"):
                words, own = features.text(text.as_py())
                each = features.of_words(words)
                if each:
                    sizes = np.array([len(x) for x in each])
                    place, back = np.unique(np.concatenate(each), return_inverse=True)
                    weight = np.bincount(back, np.repeat(1.0 / (sizes * len(each)), sizes))
                else:
                    place, weight = np.zeros(0, np.int64), np.zeros(0)
                idx.append(np.concatenate([place, own]).astype(np.int32))
                val.append(np.concatenate([weight, np.full(len(own), 0.25)]).astype(np.float32))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("label"),
                                              "idx": pa.array(idx, pa.list_(pa.int32())),
                                              "val": pa.array(val, pa.list_(pa.float32()))})

    sample = labelled_sample(docs, labels, label, most)
    features = sample.mapInArrow(parse, "doc_id long, label int, idx array<int>, val array<float>")
    return fit_in_one_task(features, lambda t: fit_ordinal(t, dim))


class Scorer:
    """Expected grades and tail probabilities under a model; keeps word scores up to a bound."""

    def __init__(self, model: bytes, at_least: float | None = None, dim: int = DIM):
        self.grades, self.theta, self.weights = unpack_model(model)
        self.features, self.worth = Features(dim), Memory(300_000)
        known = len(self.grades) > 0
        self.cut = int(np.searchsorted(self.grades, self.grades[-1] if at_least is None else at_least)) if known else 0

    def score(self, text: str) -> tuple[float, float]:
        if not len(self.grades):
            return 0.0, 1.0
        words, own = self.features.text(text)
        for w in self.worth.missing(set(words)):
            self.worth.young[w] = float(self.weights[self.features.word(w)].mean())
        s = sum(map(self.worth.young.__getitem__, words)) / max(1, len(words)) + 0.25 * float(self.weights[own].sum())
        above = np.concatenate([[1.0], sigmoid(s - self.theta), [0.0]])
        return float((above[:-1] - above[1:]) @ self.grades), float(above[min(self.cut, len(self.grades))])


def score_quality(docs: DataFrame, model: bytes, at_least: float | None = None, dim: int = DIM) -> DataFrame:
    """Per document the expected grade and P(grade >= ``at_least``); the highest grade by default."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("quality", hash(model), at_least), lambda: Scorer(model, at_least, dim))
        for b in batches:
            found = [scorer.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"),
                                              "expected_grade": pa.array([x[0] for x in found], pa.float64()),
                                              "tail_probability": pa.array([x[1] for x in found], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, expected_grade double, tail_probability double")


def select_quality(docs: DataFrame, model: bytes, at_least: float | None = None, probability: float = 0.5,
                   dim: int = DIM) -> DataFrame:
    """The documents that reach the grade with at least this probability, all columns kept."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("quality", hash(model), at_least), lambda: Scorer(model, at_least, dim))
        for b in batches:
            yield b.filter(pa.array([scorer.score(t.as_py() or "")[1] >= probability for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
