import math
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import kernels as K
from lodestone.llm import lm_scoring
from tests.llm import brute


def test_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring.C.layout, "__defaults__", ("doc_id", "text", 3000))
    monkeypatch.setattr(lm_scoring, "SEEDS", 20)
    rows = brute.corpus(4, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = {}
    got = {r.id: r for r in lm_scoring.scored(docs, model_out=model).collect()}
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update(brute.lowered(t))
            train["END"] += 1
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        tokens = [*brute.lowered(t), "END"]
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, want, abs_tol=1e-6)
        assert r.score < 0 and math.isfinite(r.score)


def test_learns_order(spark):
    """Words of two kinds take turns: the class model must see it, and the unigram model can't."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.integers(30)}" for k in range(60))) for i in range(300)]
    got = lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 10
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 10 * len(got)


def test_exchange_finds_classes():
    b = np.zeros((9, 9), np.int64)
    for i in range(1, 9):
        for j in range(1, 9):
            b[i, j] = 50 if (i < 5) != (j < 5) else 0
    found = lm_scoring.exchange(b, 2)
    assert len(set(found[:4])) == 1 and len(set(found[4:])) == 1 and found[0] != found[4]


def test_transitions_are_distributions():
    table = np.random.default_rng(1).integers(0, 5, (12, 12)).astype(float)
    logs, _ = lm_scoring.transitions(table)
    assert np.allclose((10**logs).reshape(12, -1).sum(1), 1)


def word_classes(model):
    """{word hash: (class, count)} of all training words, from what the parts answered."""
    out = {}
    for r in model["answers"].collect():
        for h, k, n in zip(K.unpack(bytes(r.hashes)).tolist(), K.unsqueeze(bytes(r.more0), np.uint8).tolist(), K.unsqueeze(bytes(r.more1), np.uint64).tolist()):
            assert out.setdefault(h, (k, n)) == (k, n)
    return out


def test_score_by_hand(spark, monkeypatch):
    """Classes as the operator chose them; counts, transitions and scores from plain loops over the texts."""
    monkeypatch.setattr(lm_scoring.C.layout, "__defaults__", ("doc_id", "text", 3000))
    monkeypatch.setattr(lm_scoring, "SEEDS", 20)
    rows = [*brute.corpus(4, 150), (9991, "never seen words here w1 w2"), (9992, "w1 once_only w3")]
    model = {}
    got = {r.id: r for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model_out=model).collect()}
    classes = word_classes(model)
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in brute.lowered(t))
    hashes = {w: int(K.words([w])[0][0]) for i, t in rows for w in brute.lowered(t)}
    assert {hashes[w]: n for w, n in count.items()} == {h: n for h, (_, n) in classes.items()}
    unknown = len(model["table"]) - 1
    line = lambda t: [0, *(classes.get(hashes[w], (unknown, 0))[0] for w in brute.lowered(t)), 0]
    table = np.zeros_like(model["table"])
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            own = line(t)
            for p, (a, b) in enumerate(zip(own, own[1:])):
                table[a, b] += 1
                if p < len(own) - 2 and count[brute.lowered(t)[p]] == 1:
                    table[a, unknown] += 1
    assert (table == model["table"]).all()
    total = table.sum()
    share = [(table[:, k].sum() + 0.1) / (total + 0.1 * len(table)) for k in range(len(table))]
    for i, t in rows:
        want, own, words = 0.0, line(t), [*brute.lowered(t), None]
        for a, b, w in zip(own, own[1:], words):
            want += math.log10(share[b] if a == unknown else (table[a, b] + lm_scoring.WEIGHT * share[b]) / (table[a].sum() + lm_scoring.WEIGHT))
            if b not in (0, unknown):
                want += math.log10(count[w] / table[:, b].sum())
        assert math.isclose(got[i].score, want, abs_tol=1e-6)


def test_first_order_gain_finds_the_class():
    """Words of known kinds against a table: the gain picks their kind."""
    r = np.random.default_rng(3)
    p = r.dirichlet(np.full(6, 0.3), 6)
    table = np.round(p * 10_000)
    for kind in range(1, 6):
        left, right = np.round(200 * table[:, kind] / table[:, kind].sum()), np.round(200 * table[kind] / table[kind].sum())
        assert 1 + lm_scoring.gains(left[None], right[None], table).argmax() == kind


def test_rounds_over_all_words_find_kinds(spark, monkeypatch):
    """Rare words, none of them a seed, of two kinds that take turns: each kind keeps to classes of its own."""
    monkeypatch.setattr(lm_scoring, "SEEDS", 10)
    r = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{min(r.geometric(0.03), 200)}" for k in range(60))) for i in range(300)]
    model = {}
    lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model_out=model).count()
    classes, found = word_classes(model), {"a": Counter(), "b": Counter()}
    for w in {w for _, t in rows for w in t.split()}:
        if (k := classes.get(int(K.words([w.encode()])[0][0]))) and k[1] > 2:
            found[w[0]][k[0]] += 1
    wrong = sum(min(found["a"][k], found["b"][k]) for k in found["a"] | found["b"])
    assert wrong <= 0.03 * (found["a"].total() + found["b"].total())


def test_odd_tables(spark):
    assert lm_scoring.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = lm_scoring.scored(spark.createDataFrame([(None, "a"), (1, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2]
