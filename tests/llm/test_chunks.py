import random
from collections import Counter

import numpy as np

from lodestone.llm import chunks as C
from lodestone.llm import ngram_join, substring_dedup
from tests.llm import brute


def dealt(spark, rows, chunk_bytes=2000):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plan = C.layout(docs, chunk_bytes=chunk_bytes)
    out = []
    for r in C.chunked(docs, plan).collect():
        out += [(r.chunk, int(i)) for i in C.K.unsqueeze(r.ids, np.int64)]
    assert len(out) == len(rows)
    return plan, out


def test_stray_ids_leave_chunks_even(spark):
    for ids in ([*range(1000), 1 << 62], [-(1 << 63) + 1, *range(1000), (1 << 63) - 1], [i * i * i for i in range(1000)]):
        plan, out = dealt(spark, [(i, "word " * 10) for i in ids])
        n = Counter(c for c, _ in out)
        assert plan.chunks >= 25 and len(n) >= 24 and max(n.values()) <= 3 * len(ids) / plan.chunks
        by = sorted(out, key=lambda x: x[1])
        assert [c for c, _ in by] == sorted(c for c, _ in by)


def test_hot_and_null_ids_are_spread(spark):
    for hot in (7, None):
        rows = [(i, "word " * 10) for i in range(300)] + [(hot, "same " * 10)] * 400 + [(hot, f"other {i} " * 6) for i in range(300)]
        plan, out = dealt(spark, rows)
        n = Counter(c for c, _ in out)
        assert max(n.values()) <= 3 * len(rows) / plan.chunks


def test_bytes_count_not_rows(spark):
    rows = [(i, "long " * 400 if i < 20 else "x") for i in range(1000)]
    plan, out = dealt(spark, rows)
    size = Counter()
    for c, i in out:
        size[c] += len(rows[i][1])
    assert max(size.values()) <= 6000


def test_operators_over_hot_ids(spark, monkeypatch):
    """Rows of a hot id, alike or not, in several chunks."""
    monkeypatch.setattr(C.layout, "__defaults__", ("doc_id", "text", 3000))
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(40))
    same, rows = text(), [(i, text()) for i in range(20)]
    docs = spark.createDataFrame(rows + [(50, same)] * 60, "doc_id long, text string").repartition(3)
    got = substring_dedup.repeats(docs).collect()
    assert sum(x.n_removed == 0 for x in got) == 21 and sum(x.n_removed == 40 for x in got) == 59
    found = ngram_join.join(docs, 4, 85).collect()
    assert {x.component_id for x in found if x.id == 50} == {50} and len(found) == 80


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies that differ from each other by about the threshold, so that many don't link with the smallest id."""
    monkeypatch.setattr(ngram_join, "RARE", 2)
    r = random.Random(4)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.id: (x.n_shingles, x.component_id) for x in ngram_join.join(docs, 4, 85).collect()}
    assert got == brute.jaccard_components(rows, 4, 85)
    assert 1 < len({c for _, c in got.values()}) < 160
