from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import graph, ngram_join

CONF = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def test_ids_of_one_label_do_not_meet_in_one_task(spark, monkeypatch):
    """A hub, a path, and pairs; the labels of each round are spread over the tasks, whatever the size of a component."""
    largest, real = [], graph.settle

    def settle(df, name):
        if name == "labels":
            largest.append(max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        return real(df, name)

    monkeypatch.setattr(graph, "settle", settle)
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        links = [(0, i) for i in range(1, 1600)] + [(i, i + 1) for i in range(5000, 5040)] + [(i, i + 1) for i in range(6000, 6100, 2)]
        got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {i: 0 for i in range(1600)} | {i: 5000 for i in range(5000, 5041)} | {i: i - i % 2 for i in range(6000, 6100)}
    assert got == want
    assert len(largest) > 2 and max(largest) < 800


def test_equal_sets_do_not_meet_in_one_task(spark):
    """Copies, also such that share an id or have none, look up their class in several parts."""
    rows = [(None if i < 300 else 5 if i < 600 else i, "one two three four five six") for i in range(900)] + [(i, f"a{i} b{i} c{i} d{i}") for i in range(2000, 2100)]
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(((i, 3, None) if t[0] == "o" else (i, 1, i) for i, t in rows), key=order)
    assert max(Counter(r.part for r in got).values()) < 450
