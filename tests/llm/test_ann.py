import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann


def exact(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-(x @ v) / (np.linalg.norm(x) * np.linalg.norm(v)), i) for i, v in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "ROWS_OF_PART", 150)
    monkeypatch.setattr(ann, "BLOCK", 300)
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16)) * (kind == "clusters")
    x = (centres[r.integers(40, size=3000)] * 2 + r.normal(size=(3000, 16))).astype(np.float32)
    x[1::3] = x[5]  # a vector that a third of all rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for g in ann.nearest(df, F.col("id") % 50 == 0).collect():
        got.setdefault(g.query_id, {})[g.rank] = (g.vec_id, g.score)
    want = exact([(i, np.float32(v)) for i, v in rows], 50, 5)
    hit = total = 0
    for q, line in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert [s for _, s in (got[q][i] for i in range(1, 6))] == sorted((s for _, s in got[q].values()), reverse=True)
        for i, s in line:
            total += 1
            hit += any(abs(s - b) < 1e-9 and a == i for a, b in got[q].values())
    assert hit / total >= 0.9, hit / total


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [0.0, 3.0]), (8, [3.0, 0.0]), (50, [-1.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, part int, score int")
    got = [(g.query_id, g.rank, g.vec_id, round(g.score, 6)) for g in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 7, 0.0), (0, 4, 50, -1.0), (50, 1, 7, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0), (50, 4, 8, -1.0)]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_partition_is_balanced():
    x = np.random.default_rng(0).normal(size=(800, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = ann.graph(x.astype(np.float32), 8)
    part = ann.balanced(x, near, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.min() >= 94 and sizes.max() <= 106
    inside = (part[near] == part[:, None]).mean()
    assert inside > 2 / 8


def test_ties_repeats_and_extremes(spark):
    """Copies of one vector tie at the last place; a query's id repeats; components whose squares overflow or vanish."""
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(0, 400)] + [(0, [0.0, 1.0, 0.0]), (1000, [1e200, 0.0, 5e199]), (1001, [1e-200, 0.0, 5e-201])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") == 1001, 5).orderBy("rank").collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(i, i + 1) for i in range(4)] + [(4, 5)] and all(abs(r.score - 1) < 1e-12 for r in got)
    big = ann.nearest(spark.createDataFrame(rows[398:], "vec_id long, embedding array<double>"), F.col("id") == 1000, 5).collect()
    assert sorted(r.vec_id for r in big) == [0, 398, 399, 1001]
    repeated = ann.nearest(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.1]), (6, [1.0, 0.0])], "vec_id long, embedding array<double>"), F.col("id") == 5, 5).collect()
    assert [r.vec_id for r in repeated] == [6]
