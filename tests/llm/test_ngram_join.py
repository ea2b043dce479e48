import numpy as np
import pytest

from lodestone.llm import ngram_join
from tests.llm import brute


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 2, 60), (3, 5, 80)])
def test_matches_brute_force(spark, monkeypatch, seed, k, percent):
    monkeypatch.setattr(ngram_join.C.layout, "__defaults__", ("doc_id", "text", 3000))
    monkeypatch.setattr(ngram_join, "RARE", 2)
    rows = brute.corpus(seed, 120)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, k, percent).collect()}
    want = brute.jaccard_components(rows, k, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_linked_sets_share_a_key():
    """The index alone, over many sizes and frequencies of tokens."""
    r = np.random.default_rng(5)
    for trial in range(1500):
        percent = int(r.choice([60, 80, 85]))
        n = int(r.integers(2, 300))
        universe = np.unique(r.integers(0, 2**64 - 1, 2 * n + 50, dtype=np.uint64))
        df_of = dict(zip(universe.tolist(), r.choice([2, 3, 20, 90], len(universe)).tolist()))
        a = r.choice(universe, n, replace=False)
        drop = int(r.integers(0, max(1, n // 4) + 1))
        b = np.union1d(a[drop:], r.choice(universe, int(r.integers(0, max(1, n // 5) + 1)), replace=False))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        ka, kb = (ngram_join.keys(np.sort(x), np.array([df_of[t] for t in np.sort(x).tolist()]), percent) for x in (a, b))
        assert len(np.intersect1d(ka, kb)), (trial, n, percent)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b"), (4, "A  b"), (5, None), (6, ""), (7, "a b"), (7, "q"), (None, "a b")], "doc_id long, text string")
    got = sorted(((r.id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()), key=lambda x: x[:2])
    assert [x[:2] for x in got] == [(0, 1), (3, 1), (4, 1), (5, 0), (6, 0), (7, 1), (7, 1)]
    assert [x[2] for x in got[:5]] == [None, None, None, 5, 6] and {x[2] for x in got[5:]} == {None, 7}
