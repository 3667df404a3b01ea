import collections
import hashlib
import random
import re

import numpy as np
import pytest

from cotejo.llm import bag_minhash as bm
from cotejo.llm import imatch

from .fixtures import odd_rows, table, words


def bag(text, width=5):
    found = re.findall(r"\w+", (text or "").lower())
    k = min(width, len(found))
    return collections.Counter(tuple(found[i:i + k]) for i in range(len(found) - k + 1)) if k else collections.Counter()


def brute_classes(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            low = sum((bags[a] & bags[b]).values())
            total = sum((bags[a] | bags[b]).values())
            if (rows[a][1] or "") == (rows[b][1] or "") or (total and low / total >= threshold):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, smallest[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def edited(text, edits, seed):
    rnd, out = random.Random(seed), text.split()
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(out)


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    error = []
    for _ in range(40):
        items = bm.mix(rng.integers(0, 2 ** 62, 30).astype(np.uint64))
        a, b = rng.integers(1, 12, 30), rng.integers(1, 12, 30)
        both = bm.signature(items, a) == bm.signature(items, b)
        error.append(both.mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.02


def test_multiplicity_beyond_every_group():
    one = np.array([12345], np.uint64)
    assert (bm.signature(one, np.array([5000])) == bm.signature(one, np.array([5000]))).all()
    assert 0.35 < (bm.signature(one, np.array([5000])) == bm.signature(one, np.array([2500]))).mean() < 0.65


def test_classes_equal_brute_force(spark):
    base = [words(k, 120) for k in range(6)]
    rows = odd_rows() + [(100 + k, t) for k, t in enumerate(base)]
    # one group whose members are often alike to the original and seldom to each other
    rows += [(200 + k, edited(base[0], k % 6, k)) for k in range(40)]
    rows += [(300 + k, base[1]) for k in range(20)]
    # documents that share a passage and nothing else
    rows += [(400 + k, words(900 + k, 90) + " " + base[2]) for k in range(20)]
    got = bm.near_duplicate_classes(table(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)


def test_one_of_each_class_stays(spark):
    base = words(7, 150)
    rows = [(1, base), (2, edited(base, 1, 1)), (3, base), (3, base), (4, words(8, 150)), (4, words(8, 150)), (None, base), (None, "only"),
            (None, "only"), (5, None), (6, "")]
    kept = bm.keep_one_per_class(table(spark, rows, clash=True))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, base), (4, words(8, 150)), (None, "only"), (5, None)], key=str)
    assert kept.columns == table(spark, rows, clash=True).columns


def test_no_rows(spark):
    assert bm.near_duplicate_classes(table(spark, [])).count() == 0
    assert bm.keep_one_per_class(table(spark, [])).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.comp for r in bm.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 90: 90, 95: 90, 100: 90}


def by_hand(texts, low, high):
    """Lexicon of the texts as sets of terms."""
    sets = [{w for w in re.split(r"[^\w]+|_", t.lower()) if w} for t in texts]
    df = collections.Counter(w for s in sets for w in s)
    return sets, {w for w, n in df.items() if max(1, low * len(texts)) <= n <= high * len(texts)}


@pytest.mark.parametrize("in_plan", [imatch.IN_PLAN, 1])
def test_fingerprints(spark, monkeypatch, in_plan):
    monkeypatch.setattr(imatch.with_hashes, "__defaults__", (in_plan,))
    rows = [(i, t) for i, t in odd_rows() if i is not None] + [(20 + k, words(k, 60, 80)) for k in range(20)]
    rows += [(60, words(3, 60, 80) + "!"), (61, " ".join(reversed(words(3, 60, 80).split())))]
    got = imatch.compared_fingerprints(table(spark, rows, clash=True)).collect()
    ordered = sorted(((i, t or "") for i, t in rows))
    assert len(got) == len(rows)
    sets, lexicon = by_hand([t for _, t in ordered], imatch.LOW, imatch.HIGH)
    seen = {}
    for k, (i, text) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        edit = text[:len(text) - half] + after[:half]
        sha = hashlib.sha256(edit.encode()).hexdigest()
        mine = [r for r in got if r.doc_id == i and r.n_chars == len(text) and r.edited_sha256 == sha]
        assert mine
        # the same terms inside the lexicon, the same fingerprint; other terms, another one
        key = frozenset(sets[k] & lexicon or sets[k])
        assert seen.setdefault(key, mine[0].fingerprint) == mine[0].fingerprint
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in mine)
    assert len(set(seen.values())) == len(seen)
    same = {r.doc_id: r for r in got}
    assert same[60].fingerprint == same[61].fingerprint == same[23].fingerprint
    assert same[60].near_next == 1.0 and same[23].near_next < 1.0


def test_fingerprints_of_no_rows_and_null_ids(spark):
    assert imatch.compared_fingerprints(table(spark, [])).count() == 0
    got = imatch.compared_fingerprints(table(spark, [(None, "x y"), (None, None), (1, "x y")])).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.n_chars}) == 1
    assert imatch.fingerprints(table(spark, [(1, "b a"), (2, "a  B")])).select("fingerprint").distinct().count() == 1


def test_no_table_of_the_corpus_is_broadcast(spark, monkeypatch):
    texts = {i: words(i, 60) for i in range(40)}
    rows = [(i, t) for i, t in texts.items()] + [(100 + i, edited(t, 1, i)) for i, t in texts.items()] + odd_rows()
    plans, write = [], bm.stage
    monkeypatch.setattr(bm, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    out = bm.keep_one_per_class(table(spark, rows))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and "SortMergeJoin" in "".join(plans)
    assert not [p for p in plans if "Broadcast" in p]
