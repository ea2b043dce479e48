import random

import numpy as np

from lodestone.llm import kernels as K
from lodestone.llm import lm_scoring, ngram_join, packing, substring_dedup
from lodestone.llm.bpe import encoder, vocabulary_path
from lodestone.llm.bulk_bpe import Bulk
from tests.llm import brute


def thue_morse(n, a="a", b="b"):
    """Two words of n letters that collide under every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_are_told_apart_as_bytes_are():
    r = random.Random(3)
    alphabet = ["a", "B", "é", "9", ".", " ", "\n", "\x0b"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 7, 8, 9, 64, 65, 300]))).encode() for _ in range(400)]
    for lower in (False, True):
        h, begins, starts, ends, joined = K.word_spans(texts, lower)
        want = [brute.lowered(t.decode()) if lower else brute.words(t.decode()) for t in texts]
        assert [joined[a:z] for a, z in zip(starts, ends)] == [w for ws in want for w in ws]
        assert np.diff(begins).tolist() == list(map(len, want))
        assert len({*zip(h.tolist(), (joined[a:z] for a, z in zip(starts, ends)))}) == len(set(h.tolist())) == len({w for ws in want for w in ws})
        other = np.array([r.randrange(len(h)) for _ in range(len(h))])
        assert K.agree(joined, starts, ends, other).tolist() == [joined[starts[i] : ends[i]] == joined[starts[j] : ends[j]] for i, j in enumerate(other.tolist())]


def test_pieces_are_cut_between_words(monkeypatch):
    texts = [b"ab " * 50 + b"x" * 500 + b" end", b"", b"y" * 100]
    whole = K.word_spans(texts)
    monkeypatch.setattr(K, "PIECE", 64)
    for a, b in zip(whole, K.word_spans(texts)):
        assert a == b if isinstance(a, bytes) else (a == b).all()


def test_thue_morse_words_differ(spark):
    x, y = thue_morse(2048)
    docs = spark.createDataFrame([(1, " ".join([x] * 21)), (2, " ".join([y] * 21)), (3, " ".join(f"{x}{i}" for i in range(25))), (4, " ".join(f"{y}{i}" for i in range(25)))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.repeats(docs).orderBy("id").collect()] == [20, 20, 0, 0]  # in 1 and 2 the second window repeats the first
    assert [r.component_id for r in ngram_join.join(docs).orderBy("id").collect()] == [1, 2, 3, 4]
    train = [r for r in lm_scoring.scored(docs).orderBy("id").collect()]
    assert train[2].base_score == train[3].base_score and train[0].n_tokens == 22
    own = encoder(vocabulary_path())
    got = {r.id: r.ids for r in packing.packed(docs.where("doc_id > 2"), length=1 << 18, ids_out=True).collect()}
    for i, w in ((3, x), (4, y)):
        assert got[i][:-1] == np.frombuffer(own.encode(" ".join(f"{w}{i}" for i in range(25)).encode()), "<u4").tolist()


def test_bulk_encoder_compares_bytes(monkeypatch):
    """Words of one hash are still encoded each as itself."""
    real = K.word_spans
    monkeypatch.setattr(K, "word_spans", lambda *a, **b: (np.zeros_like(real(*a, **b)[0]), *real(*a, **b)[1:]))
    own, bulk = encoder(vocabulary_path()), Bulk(vocabulary_path())
    texts = [b"the Quick brown-fox, jumped\xc3\xa9 over", b"", b"over the 12 dogs <|endoftext|> the"]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in bulk.encode(texts)] == [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts]
