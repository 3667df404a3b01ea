import io
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cotejo.llm import token_blocks as tb
from cotejo.llm import unigram_pieces as up

from .fixtures import odd_rows, table, words

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (2, 4096)])
@pytest.mark.parametrize("top", [1, 2, 300, 70_000, 2 ** 32])
def test_blocks_come_back(shape, top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, shape).astype(np.uint32)
    ids[0, 0] = top - 1  # an outlier for the exception list
    for row, block in zip(ids, tb.encode_blocks(ids), strict=True):
        assert np.array_equal(tb.decode_block(block), row)


def test_outliers_are_exceptions():
    ids = np.full((1, 4096), 5, np.uint32)
    ids[0, 17] = 50_000
    (block,) = tb.encode_blocks(ids)
    assert len(block) < 20 and np.array_equal(tb.decode_block(block), ids[0])


def test_shard_file_seeks():
    out = io.BytesIO()
    writer = tb.ShardWriter(out, block=8, group=2)
    docs = [(None, 3), (-5, 0), (7, 100), (7, 1)]
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 60_000, n).astype(np.uint32) for _, n in docs]
    for (d, _), x in zip(docs, ids, strict=True):
        writer.add(d, x)
    size = writer.close()
    assert size == len(out.getvalue())
    reader = tb.ShardReader(out, size)
    back = [(d, n, np.concatenate([*p, np.zeros(0, np.uint32)])) for d, n, p in reader.documents()]
    assert [(d, n) for d, n, _ in back] == docs
    assert all(np.array_equal(a, b) for (_, _, a), b in zip(back, ids, strict=True))
    assert np.array_equal(reader.block(3), np.concatenate(ids)[24:32])


def test_encoder_equals_the_library():
    lib = Tokenizer.from_file(BPE)
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a \nb", "a\n b", "a   \n\n  b c", "it's 3.5 kg", "x <|endoftext|> y", "\t\t a"]
    texts += [t or "" for _, t in odd_rows()]
    for encoder in (tb.PieceEncoder(BPE), tb.PieceEncoder(BPE, limit=1)):
        for _ in range(2):
            assert [x.tolist() for x in encoder.batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_white_space_of_all_kinds_equals_the_library():
    lib = Tokenizer.from_file(BPE)
    texts = ["".join(x) for n in range(7) for x in itertools.product("a \u00a0\t\n", repeat=n)]
    texts += [f"word{'\u00a0 ' * n}word{' \u3000' * n} x\x1c \x1c y" for n in range(6)]
    whole = lib.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in tb.PieceEncoder(BPE).batch(texts)] == [e.ids for e in whole]


def test_token_files(spark):
    rows = odd_rows() + [(100 - k, words(k, 50)) for k in range(60)]
    lib = Tokenizer.from_file(BPE)
    got = tb.read_token_shards(tb.write_token_shards(table(spark, rows, clash=True), BPE)).collect()
    expected, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert tb.read_token_shards(tb.write_token_shards(table(spark, []), BPE)).count() == 0


def test_segmentation_is_best_under_the_model():
    """Against the library's own unigram search over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = up.UnigramModel(PIECES)
    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):
        p.score = model.score[k]
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def worth(ids):
        return sum(model.scores[k] for k in ids)

    for text in [t or "" for _, t in odd_rows()] + ["x" * 300, "a☃b☃☃ ç", "  lead"]:
        mine, theirs = model.encode(text).tolist(), lib.encode(text)
        assert worth(mine) == pytest.approx(worth(theirs), rel=1e-5)
        assert [k for k in mine if k in model.bytes.values()] == [k for k in theirs if k in model.bytes.values()]


def test_trie_finds_exactly_its_words():
    trie = up.DoubleArray([("a", 0), ("ab", 1), ("b漢", 2), ("abc", 3)])

    def find(w):
        node = 0
        for c in w:
            code = trie.code.get(c, 0)
            child = trie.base[node] + code
            if not code or trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    assert [find(w) for w in ("a", "ab", "b漢", "abc", "b", "c", "abcd", "")] == [0, 1, 2, 3, -1, -1, -1, -1]


def test_pieces_round_trip(spark):
    rows = odd_rows() + [(50, "▁"), (51, "a▁ b▁▁")]
    got = up.decode_pieces(up.encode_pieces(table(spark, rows, clash=True), PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {"key", "words", "lang"} <= set(got[0].asDict())
    assert all(r.round_trip for r in up.piece_digests(table(spark, rows), PIECES).collect())
    assert up.piece_digests(table(spark, []), PIECES).count() == 0


def test_words_go_to_the_library_as_lines_of_one_text():
    encoder = tb.PieceEncoder(BPE)
    odd = ["a\nb", "\n", "", " x", "x ", "᠎", "x᠎y᠎", " z", "\x1f", "tab\t", " ", "​", "\x00", "it's", "don't.", "12ab",
           "#!?", "ñandú", "漢字", "🙂", "é", "..."]
    every = list(dict.fromkeys(odd + [a + b for a in odd for b in ("word", "7", "'s", "é")]))
    alone = {w: encoder._ids([" " + w])[0] for w in every}
    calls, library = [], encoder._ids
    encoder._ids = lambda texts: (calls.extend(texts), library(texts))[1]
    assert encoder.after_space(every) == alone
    plain = [w for w in every if w.isprintable() and w and " " not in w]
    assert len(plain) > 40 and len(calls) == len(every) - len(plain)
    calls.clear()
    assert encoder.after_space(plain) == {w: alone[w] for w in plain} and not calls
