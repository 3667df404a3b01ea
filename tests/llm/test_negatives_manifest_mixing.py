import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.llm import hard_negatives as hn
from cotejo.llm import merkle, mixing
from cotejo.llm.ranges import prefix_sums

from .fixtures import CLASHING, DOCS, odd_rows, table, words

VECTORS = "vec_id long, embedding array<float>, label int"


# --- hard negatives -----------------------------------------------------------------------

def brute_negatives(rows, every=100, positives=5, negatives=10):
    """All pairs in plain Python; rows of equal ids are different rows."""
    kept = []
    for at, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        x = np.array(x, np.float32).astype(float)
        kept.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(v)) for v in x]))

    def score(a, b):
        return sum(p * q for p, q in zip(a, b))

    out = []
    for at, i, label, q in kept:
        if i is None or i % every:
            continue
        scored = sorted(((-score(q, r), math.inf if k is None else k, b, lab) for b, k, lab, r in kept), key=lambda t: t[:2])
        for s, p, *_ in [t for t in scored if t[3] == label and t[2] != at][:positives]:
            s = -s
            wanted = [t for t in scored if t[3] != label and 30 * s <= -100 * t[0] <= 90 * s][:negatives]
            out += [(i, None if p == math.inf else p, k + 1, None if t[1] == math.inf else t[1], s, -t[0]) for k, t in enumerate(wanted)]
    return sorted(map(str, out))


def vectors(spark, rows, clash=False):
    df = spark.createDataFrame(rows, VECTORS)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate([*CLASHING, "row", "q", "angle", "slots"]))) if clash else df


def mined(df, **kw):
    return sorted(str(tuple(r)) for r in hn.hard_negatives(df, **kw).collect())


def cloud(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    return [(k, [float(v) for v in (centres[k % 10] + spread * rng.normal(size=dims)).astype(np.float32)], int(rng.integers(0, 4)))
            for k in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = cloud(700, 8, 1)
    # a hot vector, ties, repeated ids and rows, shorter and zero vectors, nulls and non-finite components
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(150)]
    rows += [rows[3], rows[3], (200, rows[4][1], 1), (200, rows[4][1], 1), (None, rows[6][1], 2), (None, rows[6][1], 2)]
    rows += [(3000, [0.5, 0.25], 1), (3001, [], 1), (3100, [0.0] * 8, 2), (3200, None, 1), (3300, [1.0, None], 1),
             (3400, [float("nan")] * 8, 1), (3500, [float("inf")] * 8, 1), (3600, rows[9][1], None), (-100, rows[7][1], 3), (-7, rows[7][1], 9)]
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(vectors(spark, rows, clash=True)) == want


def test_pruning_keeps_every_row(spark, monkeypatch):
    """Tight clusters: most slices are never scored, the result stays."""
    rows = cloud(900, 6, 3, 0.05)
    want, scored, all_pairs = brute_negatives(rows), [], 900 * 9
    q = hn.build_index(vectors(spark, rows))
    monkeypatch.setattr(hn, "SLICE", 32)
    exact = hn.exact_scores
    monkeypatch.setattr(hn, "exact_scores", lambda a, b, c: scored.append(len(a) * len(b)) or exact(a, b, c))
    assert mined(vectors(spark, rows)) == want
    index = pa.Table.from_pandas(q[0].toPandas(), preserve_index=False)
    anchors = index.filter(pa.array([v % 100 == 0 for v in index.column("vec_id").to_pylist()]))
    anchors = anchors.append_column("slots", pa.array([[{"slot": 0, "low": 3 * 256 ** 2, "high": 10 ** 9}]] * len(anchors),
                                                      pa.list_(pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))))
    block, asked = hn.Rows(index, q[1]), hn.Queries(anchors, q[1])
    got = hn.search_block(asked, block, 5, False)
    full = asked.q @ block.q.T
    wanted = (asked.label[:, None] != block.label) & (full >= 3 * 256 ** 2)
    assert 0 < sum(scored) < 0.8 * all_pairs
    for a in range(len(asked.row)):
        assert sorted(got[got[:, 0] == a, 1].tolist()) == sorted(full[a][wanted[a]].tolist())[-5:]


def test_bounds_hold():
    rng = np.random.default_rng(7)
    q = np.concatenate([rng.integers(-300, 300, (200, 16)), np.zeros((1, 16), int), np.eye(16, dtype=int)])
    units = rng.normal(size=(9, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    norm, angles = hn.angles_between(q, units)
    cell = angles.argmin(axis=1)
    order = np.lexsort((angles.min(axis=1), cell))
    t = pa.table({"row": np.arange(len(q)), "vec_id": np.arange(len(q)), "label": np.arange(len(q)), "q": [v.tobytes() for v in q[order].astype(np.int64)],
                  "norm": norm[order], "angles": [v.tobytes() for v in angles[order]], "cell": cell[order].astype(np.int32),
                  "angle": angles.min(axis=1)[order]})
    slots = pa.array([[]] * len(q), pa.list_(pa.struct([("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])))
    rows, asked = hn.Rows(t, 16), hn.Queries(t.append_column("slots", slots), 16)
    least, most = hn.score_bounds(asked, rows)
    full = asked.q @ rows.q.T
    for s, (a, b, _) in enumerate(rows.slices):
        assert (full[:, a:b] <= most[:, [s]]).all() and (full[:, a:b] >= least[:, [s]]).all()


def test_large_components_stay_exact(spark):
    rows = [(k, [float(k % 5 + 1) * 1e5, float(k % 3) * 1e5 + 0.37], k % 2) for k in range(240)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)


def test_no_vectors(spark):
    assert hn.hard_negatives(vectors(spark, [])).count() == 0
    assert hn.hard_negatives(vectors(spark, [(100, None, 1), (200, [1.0], None)])).count() == 0
    assert hn.hard_negatives(vectors(spark, [(100, [1.0], 1)])).count() == 0


# --- Merkle manifest ----------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_root(nodes):
    while len(nodes) > 1:
        nodes = [sha(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0]


def plain_siblings(nodes, at):
    out = []
    while len(nodes) > 1:
        run = at - at % 3
        out.append((nodes[run:at], nodes[at + 1:run + 3]))
        nodes, at = [sha(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)], at // 3
    return out


def plain_manifest(rows):
    """The contract, row by row. Columns of a row: doc_id, text, lang, source, n_chars."""
    def leaf(r, text):
        return plain_leaf((r[0], r[3], r[2], r[4], text))

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in groups[s]), key=lambda t: t[:3]) for s in names}
    subroots = [plain_root([t[2] for t in leaves[s]]) for s in names]
    root, out = plain_root(subroots) if subroots else None, []
    for k, s in enumerate(names):
        for at, (_, _, h, r) in enumerate(leaves[s]):
            path = plain_siblings([t[2] for t in leaves[s]], at) + plain_siblings(subroots, k)
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf(r, r[1].replace("\n", "")) if bad else h
            for a, b in path:
                x = sha(*a, x, *b)
            out.append((r[0], h, subroots[k], root, sha(*(y for a, b in path for y in a + b)), x, x == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_tree(spark, levels):
    rnd = random.Random(5)
    rows = [(i, t, None, "odd", None) for i, t in odd_rows()]
    rows += [(100 + k, "a\nb\n" + words(k, 5), "en", "hot", 3) for k in range(90)]
    rows += [(300, "same\n", "en", None, 1)] * 9 + [(None, "x\n", None, None, None)] * 3
    rows += [(400 + k, None if k % 3 else "l\ni", None, f"s{k % 11} éß", k) for k in range(25)] + [(900, "alone\n", None, "z", 0)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate([*CLASHING, "k", "pos", "height", "digest", "block"])))
    got = merkle.manifest(docs, levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.select(names).collect()) == plain_manifest(rows)
    # a version copies its path and nothing else
    for r in got.where("altered IS NOT NULL").collect():
        assert len(r.copied) == len(r.lefts) == len(r.rights) and r.copied[-1] == r.folded_root
    assert merkle.version_nodes(got).where("level = 1").count() == got.where("altered IS NOT NULL").count()


def test_manifest_of_one_and_of_no_rows(spark):
    one = merkle.manifest(table(spark, [(1, "only\n")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("") and one.copied == []
    assert merkle.manifest(table(spark, [])).count() == 0


def test_long_text_is_hashed_whole(spark):
    long = "a" * 3_000_000 + "\n"
    got = {r.doc_id: r for r in merkle.manifest(table(spark, [(1, long), (2, long + "b")])).collect()}
    assert got[1].leaf == plain_leaf((1, "s", None, None, long)) and got[2].leaf == plain_leaf((2, "s", None, None, long + "b"))


# --- mixing -------------------------------------------------------------------------------

def plain_targets(sizes, share=1.5, most=2):
    """Sharing again and again until nothing is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    stopped, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        stopped |= above


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixing_rows():
    rows = [(i, t, None, "odd", None) for i, t in odd_rows()]
    rows += [(100 + k, words(k, 1 + k % 40), None, f"s{k % 7}" if k % 3 else "hot", None) for k in range(400)]
    rows += [(None, "a b c", None, None, None)] * 30 + [(7000, "x y", None, "twin", None)] * 20 + [(8000, None, None, "none", None)]
    return rows + [(8001, "hard space one", None, "ß", None)]


def test_mixing_meets_targets(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(k).alias(c) for k, c in enumerate([*CLASHING, "size", "target", "taken"])))
    got = mixing.taken_words(df).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size_of(r[1])
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(r[0]), str(r[3]), size_of(r[1])) for r in rows)
    for s, n in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {n} and all(abs(r.target - want[s]) < 1e-6 for r in mine)
        assert sum(r.taken for r in mine) == math.floor(want[s] + 0.5)
        # whole passes for all, one more up to the cut, at most one document cut
        passes = math.floor(want[s] + 0.5) // n if n else 0
        extra = [r.taken - passes * r.size for r in mine]
        assert all(0 <= e <= r.size for e, r in zip(extra, mine)) and sum(0 < e < r.size for e, r in zip(extra, mine)) <= 1
    again = mixing.taken_words(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_order_is_the_hash_order(spark):
    docs = table(spark, [(k, words(k, 10)) for k in range(60)])
    got = mixing.taken_words(docs, weights=[1], share=0.5).collect()
    keyed = sorted(got, key=lambda r: hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:16])
    assert [r.taken for r in keyed] == [10] * 30 + [0] * 30


def test_targets_stop_and_are_shared_again(spark):
    for sizes in ([10, 1000, 7, 0, 90, 2], [0, 0], [5], [1, 1, 1, 1000], [3] * 9):
        named = {f"s{k:02d}": n for k, n in enumerate(sizes)}
        rows = spark.createDataFrame([(0, s, n) for s, n in named.items()], "_last int, _name string, source_size long")
        got = {r._name: r.target for r in mixing.source_targets(rows).collect()}
        want = plain_targets(named)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_mixture_holds_the_words(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mixture(df)
    assert mixed.columns == [*df.columns, "epoch"]
    taken = {}
    for r in mixing.taken_words(df).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    held = {}
    for r in mixed.collect():
        held[r.source] = held.get(r.source, 0) + size_of(r.text)
    assert held == {s: n for s, n in taken.items() if n}


def test_no_documents_to_mix(spark):
    assert mixing.taken_words(table(spark, [])).count() == 0 and mixing.mixture(table(spark, [])).count() == 0
    long = "w " * 1_000_000
    got = mixing.taken_words(table(spark, [(1, long), (2, "x" * 3_000_000)])).collect()
    assert sorted(r.size for r in got) == [1, 1_000_000] and sum(r.taken for r in got) == round(1.5 * 1_000_001)


def test_mixing_has_no_python(spark):
    plan = mixing.taken_words(table(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_prefix_sums_cross_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    got = prefix_sums(rows, ["k"], ["o"], {"before": "v"}).collect()
    for r in got:
        assert r.before == sum(range(r.k, r.o, 3))
