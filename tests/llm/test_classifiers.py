import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cotejo.llm import ordinal_quality as oq
from cotejo.llm import pseudo_lm as lm
from cotejo.llm import toxicity_mil as mil

from .fixtures import odd_rows, table, words


def unspaced(k: int, n: int = 120) -> str:
    return "".join(random.Random(k).choices([chr(0x4E00 + c) for c in range(300)], k=n))


def test_signals_far_into_a_run_count(spark):
    rows = [(k, unspaced(k) + ("毒毒龍毒毒" if k % 2 else "") + unspaced(9000 + k, 10)) for k in range(500)]
    docs, held = table(spark, rows), [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    got = {r.doc_id: r for r in mil.score_toxicity(docs, mil.train_toxicity(docs, labels(spark, [(k, None, k % 2) for k, _ in rows]))).collect()}
    assert np.mean([got[k].predicted == k % 2 for k in held]) > 0.95
    docs = table(spark, [(k, unspaced(k) + ("%#!" * 12 if k % 2 else "好文章" * 12)) for k in range(300)])
    model = oq.train_quality(docs, labels(spark, [(k, 1 - k % 2, 0) for k in range(200)]))
    got = {r.doc_id: r for r in oq.score_quality(docs, model).collect()}
    assert np.mean([(got[k].tail_probability >= 0.5) == (k % 2 == 0) for k in range(200, 300)]) > 0.95


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=500):
    """Documents of several sentences; every fourth hides one bad word in one of them."""
    out = []
    for k in range(n):
        rnd = random.Random(k)
        sentences = [words(k * 50 + j, 12, 300).replace(".", "") for j in range(rnd.randrange(1, 8))]
        if k % 4 == 0:
            at = rnd.randrange(len(sentences))
            sentences[at] += f" vilein{rnd.choice(['a', 'o', 'us', 'ium'])} indeed"
        out.append((k, ". ".join(sentences) + "."))
    return out


@pytest.fixture(scope="module")
def toxic(spark):
    rows = corpus()
    docs = table(spark, rows)
    marks = labels(spark, [(i, None, int(i % 4 == 0)) for i, _ in rows] + [(1, None, None), (None, None, 1)])
    return rows, docs, mil.train_toxicity(docs, marks)


def test_held_out_toxicity_and_its_sentence(spark, toxic):
    rows, docs, model = toxic
    got = {r.doc_id: r for r in mil.score_toxicity(docs, model).collect()}
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == (i % 4 == 0) for i, _ in held)
    assert right / len(held) > 0.95
    for i, t in held:
        if got[i].predicted and i % 4 == 0:
            assert "vilein" in t[got[i].worst_start:got[i].worst_end]
    kept = {r.doc_id for r in mil.without_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_noisy_or_slope_is_the_derivative():
    z = np.array([-2.0, 0.3, -1.0])

    def loss(z):
        return -np.log(mil.noisy_or(mil.sigmoid(z)))

    p = mil.sigmoid(z)
    clean = -np.logaddexp(0, z).sum()
    slope = -p * np.exp(clean) / -np.expm1(clean)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert slope[k] == pytest.approx((loss(z + step) - loss(z - step)) / 2e-6, rel=1e-4)


def test_sentences_number_the_spans():
    text = "One here.\n\n... Two there! Three"
    spans = [text[a:b].strip(" .!?\n") for a, b in (mil.span_of(text, k) for k in range(3))]
    assert spans == ["One here", "Two there", "Three"]
    number, ids, n = mil.Words().parse(text)
    assert n == 3 and len(number) == len(ids) == 5


def test_odd_rows_have_scores(spark, toxic):
    docs = table(spark, odd_rows(), clash=True)
    got = mil.score_toxicity(docs, toxic[2]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert mil.without_toxic(docs, toxic[2]).columns == docs.columns
    assert mil.score_toxicity(table(spark, []), toxic[2]).count() == 0


def test_toxicity_without_labels(spark):
    model = mil.train_toxicity(table(spark, odd_rows()), labels(spark, []))
    assert model == b"" and {r.score for r in mil.score_toxicity(table(spark, odd_rows()), model).collect()} == {0.0}


def graded(n=400):
    """Four grades: the share of shouted words falls with the grade."""
    out = []
    for k in range(n):
        g = k % 4
        rnd = random.Random(k)
        out.append((k, " ".join(w.upper() + "!!" if rnd.random() < (3 - g) / 3.5 else w for w in words(k, 80).split()), g))
    return out


def test_grades_in_order(spark):
    rows = graded()
    docs = table(spark, [(i, t) for i, t, _ in rows])
    model = oq.train_quality(docs, labels(spark, [(i, g, 0) for i, _, g in rows[:300]] + [(399, None, 0)]))
    grades, theta, _ = oq.unpack_model(model)
    assert grades.tolist() == [0, 1, 2, 3] and (np.diff(theta) >= 0).all()
    got = {r.doc_id: r for r in oq.score_quality(docs, model, at_least=2).collect()}
    test = rows[300:]
    assert np.mean([abs(got[i].expected_grade - g) for i, _, g in test]) < 0.5
    assert np.mean([(got[i].tail_probability >= 0.5) == (g >= 2) for i, _, g in test]) > 0.9
    kept = {r.doc_id for r in oq.select_quality(docs, model, at_least=2).collect()}
    assert kept == {i for i, r in got.items() if r.tail_probability >= 0.5}


def test_quality_of_odd_rows(spark):
    rows = graded(80)
    docs = table(spark, odd_rows(), clash=True)
    for marks in ([(i, g, 0) for i, _, g in rows], [(i, 1, 0) for i, _, _ in rows], []):
        model = oq.train_quality(table(spark, [(i, t) for i, t, _ in rows]), labels(spark, marks))
        got = oq.score_quality(docs, model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.tail_probability <= 1 for r in got)
        assert oq.select_quality(docs, model).columns == docs.columns
    assert oq.score_quality(table(spark, []), model).count() == 0


def test_ordinal_slopes():
    """The fit must beat the model without features on its own likelihood."""
    data = pa.table({"doc_id": range(60), "label": [k % 3 for k in range(60)],
                     "idx": pa.array([[k % 3] for k in range(60)], pa.list_(pa.int32())),
                     "val": pa.array([[1.0]] * 60, pa.list_(pa.float32()))})
    _, theta, w = oq.unpack_model(oq.fit_ordinal(data, dim=8))
    assert w[0] < theta[0] < w[1] < theta[1] < w[2]


def language(n=600):
    """Two vocabularies; a text keeps to one of them, so neighbours tell the vocabulary."""
    return [(k, " ".join(("ab"[k % 2]) + w for w in words(k, 60, 30).split())) for k in range(n)]


def test_neighbours_help_prediction(spark):
    docs = table(spark, language())
    model = lm.train_pseudo_lm(docs, rounds=3)
    got = {r.doc_id: r for r in lm.score_pseudo_lm(docs, model).collect()}
    assert np.mean([r.mean_log_probability - r.unigram_log_probability for r in got.values()]) > 0.3
    mixed = [(i, " ".join(w if j % 2 else "ba"[i % 2] + w[1:] for j, w in enumerate(t.split()))) for i, t in language(40)]
    worse = {r.doc_id: r for r in lm.score_pseudo_lm(table(spark, mixed), model).collect()}
    assert np.mean([got[i].mean_log_probability - worse[i].mean_log_probability for i, _ in mixed]) > 0.2


def test_network_slopes():
    counts = np.arange(1, 65)
    tables = lm.Tables(counts, classes=6, frequent=20)
    net = lm.WindowNet(tables)
    net.parts = [p.astype(np.float64) for p in net.parts]
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, tables.bound + 1, (9, 4)), rng.integers(0, 6, 9)
    slopes = {}
    net._move = lambda k, g, rate, rows: slopes.update({k: (rows, g)})
    net.train(context, target)
    for k in range(5):
        rows, g = slopes[k]
        full = np.zeros_like(net.parts[k])
        full[rows] = g
        at = np.unravel_index(np.abs(full).argmax(), full.shape)
        kept, values = net.parts[k][at], []
        for step in (1e-5, -1e-5):
            net.parts[k][at] = kept + step
            values.append(-net.log_probability(context, target).mean())
        net.parts[k][at] = kept
        assert full[at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3)


def test_a_token_is_never_its_own_context():
    tables = lm.Tables(np.ones(16, np.int64), classes=4, frequent=16)
    context, bucket, doc = lm.places([np.array([3, 5, 7]), np.zeros(0, np.int64), np.array([9])], tables)
    assert bucket.tolist() == [3, 5, 7, 9] and doc.tolist() == [0, 0, 0, 2]
    b, i = tables.bound, tables.input
    assert context.tolist() == [[b, b, i[5], i[7]], [b, i[3], i[7], b], [i[3], i[5], b, b], [b, b, b, b]]


def test_language_model_of_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    got = lm.score_pseudo_lm(docs, lm.train_pseudo_lm(docs, rounds=2)).collect()
    assert len(got) == len(odd_rows())
    assert all((r.n_tokens == 0) == (r.mean_log_probability is None) and r.log_likelihood <= 0 for r in got)
    empty = table(spark, [(1, None), (2, "")])
    assert [r.log_likelihood for r in lm.score_pseudo_lm(empty, lm.train_pseudo_lm(empty)).collect()] == [0.0, 0.0]
    assert lm.score_pseudo_lm(table(spark, []), lm.train_pseudo_lm(table(spark, []))).count() == 0


def test_likelihoods_read_tokens_that_were_cut_once(spark):
    docs = table(spark, [(k, words(k, 40, 50)) for k in range(40)] + [(40, None)])
    cut = lm.tokenised(docs)
    assert "text" not in cut.columns
    model = lm.train_pseudo_lm(cut, rounds=1)
    whole, again = ({r.doc_id: r for r in lm.score_pseudo_lm(d, model).collect()} for d in (docs, cut))
    assert whole == again and whole[40].n_tokens == 0 and whole[0].n_tokens == len(lm.TOKEN.findall(words(0, 40, 50)))
