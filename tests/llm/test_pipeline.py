import corpus_pipeline as cp
from lodestone.llm import quality, secrets
from lodestone.llm.bpe import encoder, vocabulary_path
from tests.llm import brute


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = cp.documents(spark, sf)
    stage = dict(cp.STAGES)
    assert list(stage) == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    names = docs.columns

    good = stage["quality"](spark, docs, sf)
    marks = {r.id for r in quality.scored(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("kept").collect()}
    good = cp.settle(good, "t")
    assert good.columns == names and {r.doc_id for r in good.collect()} == marks

    once = cp.settle(stage["exact_dedup"](spark, good, sf), "t")
    best = {}
    for r in good.collect():
        key = " ".join([""] * (r.text[:1].isspace()) + (r.text or "").split() + [""] * (r.text[-1:].isspace()))
        best[key] = min(best.get(key, r.doc_id), r.doc_id)
    assert once.columns == names and sorted(r.doc_id for r in once.collect()) == sorted(best.values())

    near = cp.settle(stage["near_dedup"](spark, once, sf), "t")
    found = brute.jaccard_components([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert near.columns == names and {r.doc_id for r in near.collect()} == {c for _, c in found.values()}

    clean = cp.settle(stage["secrets"](spark, near, sf), "t")
    assert clean.columns == names and clean.count() == near.count()
    assert secrets.findings(clean).count() == 0

    packed = stage["packing"](spark, clean, sf).collect()
    own = encoder(vocabulary_path())
    want = {r.doc_id: len(own.encode(r.text.encode())) // 4 + 1 for r in clean.collect()}
    got = {}
    for p in packed:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


def test_empty_table(spark):
    docs = cp.documents(spark, "/root/testdata/sf0.001").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.settle(stage(spark, docs, "/root/testdata/sf0.001"), "t")
    assert docs.count() == 0


def test_near_dedup_tells_rows_with_one_id_apart(spark):
    words = lambda k, n=60: [f"{k}{i}" for i in range(n)]
    near = lambda k: " ".join([*words(k), "more"])
    rows = [(3, " ".join(words("a"))), (5, near("a")), (5, " ".join(words("b"))), (None, " ".join(words("c"))), (None, near("c")), (7, " ".join(words("d"))), (7, near("d")), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text[:1]) for r in dict(cp.STAGES)["near_dedup"](spark, docs, "").collect())
    assert got == [(0, "c"), (3, "a"), (5, "b"), (7, "d"), (8, "")]
