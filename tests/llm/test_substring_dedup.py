import pytest

from lodestone.llm import substring_dedup
from tests.llm import brute


@pytest.mark.parametrize("seed,words", [(1, 20), (2, 8), (3, 6)])
def test_matches_brute_force(spark, monkeypatch, seed, words):
    monkeypatch.setattr(substring_dedup.C.layout, "__defaults__", ("doc_id", "text", 3000))
    rows = brute.corpus(seed, 90)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(docs, words).collect()}
    want = brute.repeats(rows, words)
    assert got == want
    assert any(v[1] for v in want.values())


def test_spans_and_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    got = {r.id: r for r in substring_dedup.repeats(docs, texts_out=True).collect()}
    assert got[2].spans == [[1, 31]] and got[2].kept == "head tail" and got[1].spans == []


def test_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.repeats(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (6, None)], "doc_id long, text string")
    got = sorted((-1 if r.id is None else r.id, r.n_removed) for r in substring_dedup.repeats(docs).collect())
    assert got == [(-1, 0), (5, 25), (5, 25), (6, 0)]
