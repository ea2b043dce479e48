import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality


def table(spark, n=900, seed=0):
    r = random.Random(seed)
    bag = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        kind = r.random()
        w = [r.choice(bag) for _ in range(r.randint(20, 200))]
        if kind < 0.15:
            w = [x + "$$$" for x in w]
        elif kind < 0.3:
            w.insert(r.randrange(len(w)), r.choice(["Scoundrel,", "knave"]))
        docs.append((i, " ".join(w), "en", f"s{i % 5}", len(" ".join(w)), kind < 0.3))
        if i % 2:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, bad boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).join(docs, F.col("id") == F.col("doc_id")).where("doc_id % 2 = 0")
    wrong = got.where(F.col("kept") == F.col("bad")).count()
    assert wrong <= 0.03 * got.count()
    stays = quality.kept(docs, model)
    assert stays.columns == docs.columns and stays.where("doc_id % 2 = 0").count() == got.where("kept").count()


def test_views_are_calibrated(spark):
    docs, labels = table(spark, 700, 3)
    got = quality.scored(docs, quality.train(docs, labels)).join(docs, F.col("id") == F.col("doc_id")).toPandas()
    assert abs(got["quality_score"].mean() - (~got["bad"]).mean()) < 0.05
    assert abs(got["meta_score"].mean() - (~got["bad"]).mean()) < 0.1


def test_odd_tables(spark):
    docs, labels = table(spark, 60, 1)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.scored(docs, None).where("kept").count() == 60
    docs2, labels2 = table(spark, 300, 2)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "zz", "new", -4), (1, "x" * 300000, None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.scored(odd, quality.train(docs2, labels2)).collect()
    assert len(got) == 3 and all(np.isfinite(r.quality_score) for r in got)
    assert quality.scored(odd.limit(0), None).count() == 0


def test_every_sure_document_takes_part(spark):
    """The sums over all unlabelled documents equal those of one matrix."""
    docs, labels = table(spark, 4000, 5)
    labels = labels.where("doc_id < 400")
    seen = {}
    plain = quality.Model.co_train

    def watched(self, x, y, sums):
        told = [self.text_w.copy(), self.meta_w.copy()]
        seen["got"], seen["told"], seen["model"] = sums(told, told), told, (self.text, self.meta)
        plain(self, x, y, sums)

    quality.Model.co_train = watched
    try:
        quality.train(docs, labels)
    finally:
        quality.Model.co_train = plain
    rest = docs.join(labels, "doc_id", "left_anti").toPandas()
    text, meta = seen["model"]
    x = [text(*quality._features([t.encode() for t in rest["text"]])), meta(quality._meta(rest["source"], rest["lang"], rest["n_chars"]))]
    odds = [quality._odds(v, w) for v, w in zip(x, seen["told"])]
    total = 0
    for v in range(2):
        for k in range(2):
            chance = 1 / (1 + np.exp(-odds[1 - v]))
            sure = chance < 0.1 if k == 0 else chance > 0.9
            n, slope, _ = seen["got"][v, k]
            p = 1 / (1 + np.exp(-odds[v][sure]))
            assert n == sure.sum() and np.allclose(slope[:-1], x[v][sure].T @ (k - p))
            total += n
    assert total > 2000  # the sample of 3,000 passed on 450 at most


def test_repeated_labelled_ids_are_averaged(spark):
    docs, labels = table(spark, 300, 6)
    again = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(25000).drop("id")))
    model = quality.train(again, labels)
    got = quality.scored(docs, model).join(docs, F.col("id") == F.col("doc_id"))
    assert got.where(F.col("kept") == F.col("bad")).count() <= 0.05 * got.count()


def test_words_of_labelled_documents_stay_on_the_executors(spark, monkeypatch):
    """The driver gets counts of common words, not the words of each document, however many those have."""
    docs, labels = table(spark, 600, 7)
    own = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: F.concat(F.lit("own"), F.col("doc_id").cast("string"), F.lit("x"), k.cast("string"))))
    long = docs.withColumn("text", F.concat_ws(" ", "text", own))
    sizes, plain = [], type(docs).toArrow

    def watched(self):
        out = plain(self)
        sizes.append(out.nbytes)
        return out

    monkeypatch.setattr(type(docs), "toArrow", watched)
    model = quality.train(long.union(long.where("doc_id < 50")), labels)
    assert sizes and sum(sizes) < 300_000  # 2,000 words of 8 bytes from each of 300 documents are 4,800,000
    assert np.array_equal(model.text.words, quality.train(docs, labels).text.words) and len(model.text.words)
