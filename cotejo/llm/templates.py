"""Benchmark decontamination by templates: re-parameterised questions are found too.

A text becomes a template: numbers, names and units turn into typed placeholders, all other
words into lower case; punctuation goes. A run of name words is one placeholder. Windows of
template tokens of benchmark items are hash-joined with those of documents. Windows of a pair
that share a diagonal (place in the document less place in the item) belong to one occurrence;
there the slots must agree: each slot value of the item stands for one value in the document,
and each value in the document for one of the item, as bound where either first appears. A slot
that contradicts this costs the windows that hold it, the other windows of the occurrence still
count. An item is leaked into a document if at least ``coverage`` of its windows are left.

Windows that no item holds are dropped before the join by a filter of a fixed number of bits
over all item windows; it may pass a window too many, never one too few.

Defined results: null reads as the empty text. Items of fewer than four template tokens match
nothing; items shorter than a window are compared as one window of their length. Repeated
items and documents are each answered for themselves; rows with a null id take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.bag_minhash import mix
from cotejo.llm.common import Memory, kept, whole_text
from cotejo.session import stage

WINDOW, LEAST = 8, 4
FILTER_WORDS = 1 << 17  # of 64 bits
TOKEN = re.compile(r"[^\W\d]\w*|\d+(?:[.,]\d+)*|[.!?\n%$€£¥°]")
WORD, CAPITAL, NUMBER, UNIT, SYMBOL, BREAK = range(6)
#: Words that name a unit when a number stands before them.
UNITS = frozenset("""
mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches ft foot feet yard yards
mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter
liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years mph kph kmh hz khz mhz ghz kb mb gb tb w kw watt watts v volt volts a amp amps j kj cal kcal
degree degrees celsius fahrenheit kelvin percent dollar dollars cent cents euro euros usd eur gbp
""".split())
PLACEHOLDER = {k: xxhash.xxh64_intdigest(f"<{k}>") for k in (CAPITAL, NUMBER, UNIT)}


@dataclass
class Templates:
    """Template tokens of several texts: hash, kind, place in ``raw``, number of the text; sizes by text."""

    hashes: np.ndarray
    kinds: np.ndarray
    raw: list[str]
    at: np.ndarray
    text: np.ndarray
    sizes: np.ndarray

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that lie inside one text."""
        found = windows(self.hashes, width)
        inside = np.flatnonzero(self.text[:len(found)] == self.text[width - 1:]) if len(found) else np.zeros(0, np.int64)
        return inside, found[inside]


class Canonical:
    """Templates of texts; remembers token hashes up to a bound."""

    def __init__(self, limit: int = 300_000):
        self.known = Memory(limit)

    def templates(self, texts: list[str]) -> Templates:
        """The templates of several texts, one after the other."""
        each = [TOKEN.findall(t) for t in texts]
        for raw in each:
            raw.append("\n")  # the next text starts a sentence
        raw = list(chain.from_iterable(each))
        for t in self.known.missing(set(raw)):
            self.known.young[t] = self._token(t)
        both = np.fromiter(map(self.known.young.__getitem__, raw), np.uint64, len(raw))
        h, kind = both >> np.uint64(3), (both & np.uint64(7)).astype(np.int8)
        before = np.concatenate([[BREAK], kind[:-1]]).astype(np.int8)
        after = np.concatenate([kind[1:], [BREAK]]).astype(np.int8)
        number = kind == NUMBER
        unit = ((kind == UNIT) & (before == NUMBER)) | ((kind == SYMBOL) & ((before == NUMBER) | (after == NUMBER)))
        name = (kind == CAPITAL) & (before != BREAK)
        keep = (kind != BREAK) & ((kind != SYMBOL) | unit)
        keep[1:] &= ~(name[1:] & name[:-1])
        final = np.where(name, CAPITAL, np.where(number, NUMBER, np.where(unit, UNIT, WORD)))
        for k, value in PLACEHOLDER.items():
            h[final == k] = value
        at = np.flatnonzero(keep)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in each])[at]
        return Templates(h[at], final[at], raw, at, text, np.bincount(text, minlength=len(texts)))

    @staticmethod
    def _token(t: str) -> int:
        """Hash of the word in lower case, 61 bits, and its kind in three more."""
        if t[0] in ".!?\n":
            return BREAK
        if t[0].isdigit():
            return NUMBER
        if not (t[0].isalnum() or t[0] == "_"):
            return SYMBOL
        low = t.lower()
        kind = UNIT if low in UNITS else CAPITAL if t[0].isupper() else WORD
        return xxhash.xxh64_intdigest(low) >> 3 << 3 | kind


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a template."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += h[j:j + n] * powers[j]
    return mix(total)


def slots(kinds: np.ndarray, raw: list[str], at: np.ndarray, start: int, width: int) -> list[str]:
    """The slot values of a window, in order; a run of name words is one value."""
    out = []
    for k in range(start, min(start + width, len(at))):
        if kinds[k] == WORD:
            continue
        i = int(at[k])
        value = [raw[i]]
        if kinds[k] == CAPITAL:
            upto = int(at[k + 1]) if k + 1 < len(at) else len(raw)
            value = [t for t in raw[i:upto] if t[0].isupper()]
        out.append(" ".join(value).lower())
    return out


WINDOW_SCHEMA = "id long, tokens int, width int, pos int, hash long, slots array<string>"


def template_windows(rows: DataFrame, widths: list[int] | None, window: int, least: int, wanted: bytes | None) -> DataFrame:
    """The windows of (id, text) rows: of the items' own width, or of ``widths`` where the filter passes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = kept(("templates",), Canonical)
        bits = np.frombuffer(wanted, "<u8") if wanted is not None else None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids, t = part.column("id").to_pylist(), canonical.templates(part.column("text").to_pylist())
                first = np.cumsum(t.sizes) - t.sizes
                out: list[tuple] = []
                for width in (widths if widths is not None else range(least, window + 1)):
                    if width < least:
                        continue
                    starts, found = t.windows(width)
                    if bits is not None:
                        wanted_here = passes(bits, found)
                    else:  # items: their own width only
                        size = t.sizes[t.text[starts]]
                        wanted_here = size >= width if width == window else size == width
                    for p, h in zip(starts[wanted_here].tolist(), found[wanted_here].view(np.int64).tolist(), strict=True):
                        d = int(t.text[p])
                        out.append((ids[d], int(t.sizes[d]), width, p - int(first[d]), h, slots(t.kinds, t.raw, t.at, p, width)))
                if out:
                    yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                          ["id", "tokens", "width", "pos", "hash", "slots"])

    return rows.mapInArrow(cut, WINDOW_SCHEMA)


def passes(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    size = np.uint64(64 * len(bits))
    ok = np.ones(len(found), bool)
    for shift in (np.uint64(0), np.uint64(32)):
        place = (found >> shift) % size
        ok &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def window_filter(items: DataFrame, words: int = FILTER_WORDS) -> bytes:
    """A bit filter over all item windows, of ``words`` * 64 bits whatever the number of items."""
    size = 64 * words
    # two places per window, from either half of its hash
    low = F.col("hash").bitwiseAND(size - 1)
    high = F.shiftrightunsigned("hash", 32).bitwiseAND(size - 1)
    spots = items.select(F.explode(F.array(low, high)).alias("place")).distinct()
    masks = spots.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS int))")).alias("mask"))
    bits = np.zeros(words, "<i8")
    for r in masks.collect():  # at most ``words`` rows
        bits[r.word] = r.mask
    return bits.tobytes()


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5,
                 least: int = LEAST) -> DataFrame:
    """One row per document and item leaked into it.

    ``coverage`` is the share of the item's windows found without a clash of slots; ``reparameterised``
    says whether some slot value differs.
    """
    item_rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), whole_text("text").alias("text"))
    items = stage(template_windows(item_rows, None, window, least, None))
    # widths below ``window`` only where an item is that short: at most ``window`` values
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), whole_text("text").alias("text"))
    found = stage(template_windows(rows, widths, window, least, window_filter(items)))

    right = items.select(F.col("id").alias("item_id"), F.col("tokens").alias("item_tokens"), F.col("pos").alias("item_pos"),
                         "hash", "width", F.col("slots").alias("item_slots"))
    hits = found.select(F.col("id").alias("doc_id"), "pos", "hash", "width", "slots").join(right, ["hash", "width"]) \
        .where(F.size("slots") == F.size("item_slots")) \
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "slots", "item_slots",
                (F.col("item_tokens") - F.col("width") + 1).alias("item_windows"))
    occurrence = ["doc_id", "item_id", "diagonal"]
    pair = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    both = hits.where(F.size("slots") > 0).select(*occurrence, "item_pos", F.posexplode(pair).alias("at", "s")) \
        .select(*occurrence, F.struct("item_pos", "at").alias("place"), F.explode(F.array(
            F.struct(F.lit(True).alias("of_item"), F.col("s.a").alias("value"), F.col("s.b").alias("other")),
            F.struct(F.lit(False).alias("of_item"), F.col("s.b").alias("value"), F.col("s.a").alias("other")))).alias("v")) \
        .select(*occurrence, "place", "v.*")
    torn = both.groupBy(*occurrence, "of_item", "value").agg(
        F.min("other").alias("least"), F.max("other").alias("most"), F.min_by("other", "place").alias("bound")) \
        .where("least <> most")

    def bound_of(item: bool):
        entry = F.when(F.col("of_item") == item, F.struct("value", "bound"))
        return F.map_from_entries(F.collect_list(entry))

    bound = torn.groupBy(*occurrence).agg(bound_of(True).alias("of_item"), bound_of(False).alias("of_doc"))
    clash = F.exists(pair, lambda s: F.coalesce(F.try_element_at("of_item", s["a"]) != s["b"], F.lit(False))
                     | F.coalesce(F.try_element_at("of_doc", s["b"]) != s["a"], F.lit(False)))
    seen = hits.join(bound, occurrence, "left").where(~clash).select(
        "doc_id", "item_id", "item_pos", "item_windows", F.exists(pair, lambda s: s["a"] != s["b"]).alias("differs"))
    per_place = seen.groupBy("doc_id", "item_id", "item_pos").agg(
        F.max("item_windows").alias("item_windows"), F.bool_and("differs").alias("differs"))
    result = per_place.groupBy("doc_id", "item_id").agg(
        F.count("*").cast("long").alias("windows"), F.max("item_windows").cast("long").alias("item_windows"),
        F.bool_or("differs").alias("reparameterised"))
    return result.withColumn("coverage", F.col("windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaked, all columns kept. Rows without an id stay."""
    leaked = stage(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")
