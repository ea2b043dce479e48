import hashlib
import os
import random

import numpy as np

from lodestone.llm import bpe, bulk_bpe
from tests.llm import brute

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = ["", None, " ", "<|endoftext|> and <|startoftext|>x<|endoftext|>", "It's we'll they'd I'VE", "ΑΣ Σ ΣΑΣ.", "é ́a ﬁ İI", "12 3½ ²x", "日本語 テスト 😀👍🏽", "a b c​d\x1cf", "\x00\x01 \x7f", "x" * 3000, "!!!???...---", "Word. word, a| |. .", "x," * 40]


def texts():
    r = random.Random(3)
    letters = "abcdefghijABCDEFG'éßÅñ123,.!-́ 日Σ <|>"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(1500)]


def test_matches_the_library(spark):
    from tokenizers import Tokenizer

    own, theirs = bpe.encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    for t in texts():
        want = theirs.encode(t or "", add_special_tokens=False).ids
        ids = own.encode((t or "").encode())
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids) == theirs.decode(want, skip_special_tokens=False), t


def test_query_and_round_trip(spark):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(3, "twice", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = {(r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()}
    own = bpe.encoder(bpe.vocabulary_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(i, len(e) // 4, sha(e), sha(own.decode(e).encode())) for i, t, _ in rows for e in [own.encode((t or "").encode())]}
    ids = bpe.encoded(df)
    assert bpe.decoded(ids).where("text = 'twice</w>'").count() == 1
    assert bpe.encoded(df.limit(0)).count() == 0


def test_bulk_equals_scalar(monkeypatch):
    own = bpe.encoder(bpe.vocabulary_path())
    every = [(t or "").encode() for t in texts()]
    monkeypatch.setattr(bulk_bpe, "BATCH_BYTES", 4000)
    got = list(bulk_bpe.encode_all(bpe.vocabulary_path(), every))
    assert [x.tolist() for x in got] == [np.frombuffer(own.encode(t), "<u4").tolist() for t in every]
    assert list(bulk_bpe.encode_all(bpe.vocabulary_path(), [])) == [] and [len(x) for x in bulk_bpe.encode_all(bpe.vocabulary_path(), [b"", b" "])] == [0, 0]


def test_common_words_stay_in_the_bulk_memory(monkeypatch):
    monkeypatch.setattr(bulk_bpe, "KEPT", 40_000)
    own, bulk, encoded, real = bpe.encoder(bpe.vocabulary_path()), bulk_bpe.Bulk(bpe.vocabulary_path()), [], bulk_bpe.Bulk.pieces
    monkeypatch.setattr(bulk_bpe.Bulk, "pieces", lambda *a: encoded.append(real(*a)) or encoded[-1])
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(12))
    common, rare = [word() for _ in range(100)], [[word() for _ in range(100)] for _ in range(20)]
    for some in rare:
        text = " ".join(common + some).encode()
        assert bulk.encode([text])[0].tolist() == np.frombuffer(own.encode(text), "<u4").tolist()
    assert sum(len(x[1]) for x in encoded) == len({*common, *(w for some in rare for w in some)}) == 2100
    assert bulk.held <= 40_000


def test_bulk_splits_lines_of_words_as_the_library_does():
    from tokenizers import Tokenizer

    theirs, bulk = Tokenizer.from_file(bpe.vocabulary_path()), bulk_bpe.Bulk(bpe.vocabulary_path())
    every = [t or "" for t in texts()]
    for _ in range(2):  # the second time from memory
        got = bulk.encode([t.encode() for t in every])
        assert [x.tolist() for x in got] == [theirs.encode(t, add_special_tokens=False).ids for t in every]


def test_bounded_memory():
    own = bpe.Encoder(bpe.vocabulary_path())
    own.words.most = own.pieces.most = 3
    text = b" ".join(b"w%d" % (i % 7) for i in range(50))
    assert own.encode(text) == bpe.encoder(bpe.vocabulary_path()).encode(text)
    assert len(own.words) <= 3
    assert brute.words("a b") == [b"a", b"b"]
