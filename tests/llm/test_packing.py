import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import packing
from lodestone.llm.bpe import encoder, vocabulary_path


@pytest.mark.parametrize("seed", range(6))
def test_assignment(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 2, r.randint(1, 50), r.randint(1, 300)]) for _ in range(r.randint(0, 80))]
    pieces = packing.assign(sizes, 64)
    used = defaultdict(int)
    held = defaultdict(list)
    for i, start, n, s in pieces:
        used[s] += n
        held[i] += range(start, start + n)
    assert all(sorted(held[i]) == list(range(n)) for i, n in enumerate(sizes))
    assert all(0 < u <= 64 for u in used.values())
    assert len(used) <= -(-sum(sizes) // 64) and set(used) == set(range(len(used)))


def test_lowest_cost_sequence_with_room():
    pieces = packing.assign([40, 30, 20, 10, 10], 64)
    assert [(p[0], p[3]) for p in pieces] == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 1)]  # costs so far: 65 and 70, then 76 and 70


def test_pieces_hold_each_id_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_BYTES", 20_000)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "Quick", "brown-fox", "é", "7"]) for _ in range(r.choice([0, 3, 40, 700, 9000])))) for i in range(40)]
    rows += [(40, None), (None, "x y"), (5, "again")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), length=512, ids_out=True).collect()
    own = encoder(vocabulary_path())
    want = sorted(((-1 if i is None else i), [*np.frombuffer(own.encode((t or "").encode()), "<u4").tolist(), 2]) for i, t in rows)
    sequences, whole = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        whole[-1 if p.id is None else p.id, p.doc_tokens].append((p.start, p.ids))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 512
    assert sorted((k[0], [x for _, ids in sorted(v) for x in ids]) for k, v in whole.items()) == want
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
