import random
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import sharding

SCHEMA = "doc_id long, text string, slot string, vslot int"


def check(rows, got, shards, slack):
    """Every row once, as a plain count of it says; places without gaps; shards near equal in bytes."""
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.id is None else r.id, r.size, r.text_crc32) for r in got) == want
    places, size = defaultdict(list), defaultdict(int)
    for r in got:
        places[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(places) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    if rows:
        assert max(size.values()) - min(size[s] for s in range(shards)) <= slack
    return size


@pytest.mark.parametrize("hot", ["none", "one id", "null ids", "rows alike"])
def test_law_of_bytes(spark, hot):
    r = random.Random(2)
    rows = [(i, "é" * r.randrange(200)) for i in range(3000)]
    if hot == "one id":
        rows = [(5 if k % 3 == 0 else i, f"{t}{k}") for k, (i, t) in enumerate(rows)]
    elif hot == "null ids":
        rows = [(None if k % 3 == 0 else i, f"{t}{k}") for k, (i, t) in enumerate(rows)]
    elif hot == "rows alike":
        rows = [(7, "alike" * 30) if k % 3 == 0 else x for k, x in enumerate(rows)]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], SCHEMA).repartition(5)
    placed, slot_map = sharding.sharded(df, 24, slots=1024)
    check(rows, placed.collect(), 24, 2000)
    assert slot_map.version == 1


def test_map_is_stored_and_edited(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "x" * r.randrange(300)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/map"
    first, a = sharding.sharded(df, 7, path)
    first = {(x.id): x.shard for x in first.collect()}
    second, b = sharding.sharded(df, 8, path)
    second = {(x.id): x.shard for x in second.collect()}
    assert (a.version, b.version) == (1, 2) and b.moved
    assert sharding.SlotMap.load(spark, path, 1).holder == a.holder and sharding.SlotMap.load(spark, path).holder == b.holder
    # rows travel into the new shard alone, and no more of them than its fair part needs
    moved = [i for i in first if first[i] != second[i]]
    assert {second[i] for i in moved} == {7} and len(moved) < 2 * len(rows) / 8
    third, c = sharding.sharded(df, 8, path)
    assert c.version == 3 and not c.moved and {(x.id): x.shard for x in third.collect()} == second


def test_large_record_and_odd_tables(spark):
    rows = [(i, "x" * 50) for i in range(500)] + [(1000, "y" * 200_000), (1001, None), (1001, None), (None, "")]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 4)[0].collect()
    size = check(rows, got, 4, 200_000)
    assert sorted(size.values())[-1] == 200_008
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = sharding.op2_sharding(spark, sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    largest = max(len((t or "").encode()) for _, t in rows)
    check(rows, got.withColumnRenamed("doc_id", "id").collect(), 24, 2 * largest)
    assert {(r.law, r.grown_shard, r.map_version) for r in got.select("law", "grown_shard", "map_version").distinct().collect()} == {("bytes", None, 2)}
