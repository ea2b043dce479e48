"""Quality classification by co-training.

Two views of a document are learned apart: its text content (counts of byte kinds, repetition, and words that tell the
classes apart) and its page metadata (source, language, recorded size). In each of ``ROUNDS`` rounds each view scores all
unlabelled documents, and the other one learns from every one it is sure of (``SURE``). Both are calibrated on labelled documents kept
apart, and the calibrated views are combined into one probability that scores every document. A document is good when its label
says quality 1 and toxic 0.

Learning takes at most ``LABELLED`` labelled documents, picked by hash of the id, and all unlabelled ones; scoring takes every
document and whole texts. Of the labelled sample the driver gets statistics, metadata, counts of the words that ``COMMON`` documents have,
and which documents have the words picked; texts, and the words of each, stay on the executors. So do the unlabelled documents, as bits
of the views' columns; of them the driver gets sums alone (the gradient and the Hessian of each view and class), whose
size doesn't depend on the input. A class's pseudo-labels together never weigh more than its labels.

Defined results: null texts count as empty, null metadata as a value of its own; rows that repeat a labelled id are averaged
into one document for learning, with the words of all; labels that are null or contradict each other
are left out; with fewer than ``LEAST`` usable labels of either kind every document scores 1 and stays; rows that repeat
an id are scored one by one; an empty table gives an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, free_prefix, ready, settle

LABELLED = 8000
LEAST = 8
ROUNDS = 3
STEPS = 4  # of Newton's method in a round, at most; each reads all unlabelled documents
SURE = 0.1  # how far from 0 or 1 the probability of a pseudo-label may be
OTHERS = 32  # columns, by hash, for the sources or languages that no labelled document has
WORDS = 200
COMMON = 5  # documents that have a word, at least, for it to count
BINS = 12
THRESHOLD = 0.5

_KIND = np.zeros(256, np.uint8)  # 0 letters and other bytes
_KIND[[9, 11, 12, 13, 32]] = 1
_KIND[10] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_KIND[[44, 46]] = 6
_SPLIT = bytes(32 if k in (1, 2, 5, 6) else b for b, k in enumerate(_KIND))
STATS = ("size", "space", "lines", "digits", "upper", "signs", "stops", "word_length", "distinct", "echo", "top_word")


def _texts(batch: pa.RecordBatch, at: int = 1) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def _features(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The STATS of each text, and its distinct lower-cased words' hashes."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    kinds = _KIND[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    # seven kinds a byte of text: sums from counts of places, without a wide array for each
    counts = np.stack([np.diff(np.searchsorted(np.flatnonzero(kinds == k), begins)) for k in range(7)], 1)
    counts[:, 2] -= 1  # the joining line end
    size = np.maximum(np.diff(begins) - 1, 1)
    h, at = K.words([t.translate(_SPLIT) for t in texts], lower=True)
    stats, words = [], []
    for i in range(len(texts)):
        own = h[at[i] : at[i + 1]]
        distinct, n = np.unique(own, return_counts=True)
        words.append(distinct)
        m = max(len(own), 1)
        echo = (own[1:] == own[:-1]).sum() / m
        stats.append([math.log1p(size[i]), *(counts[i, 1:] / size[i]), size[i] / m, len(distinct) / m, echo, n.max(initial=0) / m])
    return np.array(stats).reshape(len(texts), len(STATS)), words


def _slopes(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, block: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood at weights w, the last one the intercept; x may hold bits as bytes."""
    slope, bend = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for a in range(0, len(x), block):
        own = np.hstack([x[a : a + block].astype(float), np.ones((len(x[a : a + block]), 1))])
        p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
        slope += own.T @ (weight[a : a + block] * (y[a : a + block] - p))
        bend += (own.T * (weight[a : a + block] * np.maximum(p * (1 - p), 1e-6))) @ own
    return slope, bend


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method."""
    w = np.zeros(x.shape[1] + 1)
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        slope, bend = _slopes(x, y, weight, w)
        step = np.linalg.solve(bend + np.diag(hold), slope - hold * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


class TextView:
    """Bins of the statistics, and words that tell good documents from others."""

    def __init__(self, stats: np.ndarray, y: np.ndarray, every: np.ndarray, n: np.ndarray, in_bad: np.ndarray):
        """every: the words of COMMON documents or more, rising; n, in_bad: how many documents, and bad ones, have them."""
        self.edges = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(stats.shape[1])]
        # a word counts where the classes differ in it
        share = max(1e-9, (y < 0.5).mean())
        chi = (in_bad - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9)
        self.words = np.sort(every[np.argsort(-chi, kind="stable")[:WORDS]][np.sort(-chi)[:WORDS] < -10])

    def __call__(self, stats: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        there, at = K.member(np.concatenate([np.zeros(0, np.uint64), *words]), self.words)
        doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        marks = np.zeros((len(words), len(self.words)), np.uint8)
        marks[doc[there], at[there]] = 1
        return self.columns(stats, marks)

    def columns(self, stats: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """marks: which of the view's words a document has."""
        out = []
        for j, e in enumerate(self.edges):
            out.append(np.eye(len(e) + 1, dtype=np.uint8)[np.searchsorted(e, stats[:, j], side="right")])
        return np.hstack([*out, marks])


class MetaView:
    """One column for each source and language that the labelled sample has, OTHERS for the rest, and bins of the recorded size."""

    def __init__(self, meta: list[tuple]):
        self.values = [{v: i for i, v in enumerate(sorted({m[j] for m in meta}))} for j in range(2)]
        self.edges = np.unique(np.quantile([m[2] for m in meta], np.linspace(0, 1, BINS + 1)[1:-1]))

    def __call__(self, meta: list[tuple]) -> np.ndarray:
        out = []
        for j, values in enumerate(self.values):
            x = np.zeros((len(meta), len(values) + OTHERS), np.uint8)
            x[np.arange(len(meta)), [values[m[j]] if m[j] in values else len(values) + zlib.crc32(m[j].encode()) % OTHERS for m in meta]] = 1
            out.append(x)
        out.append(np.eye(len(self.edges) + 1, dtype=np.uint8)[np.searchsorted(self.edges, [m[2] for m in meta], side="right")])
        return np.hstack(out)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


class Model:
    """Both views, calibrated, and their combination."""

    def __init__(self, stats, meta, y, counted, marked, sums):
        """From labelled documents; sums(model) gives what co_train() needs of the unlabelled ones.

        counted(picks) gives the words of the documents picked and their counts, as TextView takes them; marked(words) which document
        has which of the words.
        """
        r = np.random.default_rng(7)
        kept = np.zeros(len(y), bool)
        kept[r.permutation(len(y))[: max(2, len(y) // 4)]] = True
        if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
            kept[:] = True
        learns = ~kept if not kept.all() else kept
        self.text = TextView(stats[learns], y[learns], *counted(learns))
        self.meta = MetaView(meta)
        x = [self.text.columns(stats, marked(self.text.words)), self.meta(meta)]
        self.text_w, self.meta_w = (logistic(v[learns], y[learns], np.ones(learns.sum())) for v in x)
        self.co_train([v[learns] for v in x], y[learns], sums(self))
        odds = [_odds(v, w) for v, w in zip(x, (self.text_w, self.meta_w))]
        even = np.ones(kept.sum())
        self.calibrated = [logistic(o[kept, None], y[kept], even, 0.01) for o in odds]
        both = np.stack([_odds(o[kept, None], c) for o, c in zip(odds, self.calibrated)], 1)
        self.combined = logistic(both, y[kept], even, 0.1)

    def co_train(self, x: list[np.ndarray], y: np.ndarray, sums) -> None:
        """Newton's method over labels and pseudo-labels; the labels given by the views of the round before."""
        even = np.ones(len(y))
        for _ in range(ROUNDS):
            told = [self.text_w.copy(), self.meta_w.copy()]
            for _ in range(STEPS):
                now = [self.text_w, self.meta_w]
                found, far = sums(told, now), 0.0
                for v in range(2):
                    hold = np.full(len(now[v]), 0.3)
                    hold[-1] = 1e-6
                    slope, bend = _slopes(x[v], y, even, now[v])
                    slope, bend = slope - hold * now[v], bend + np.diag(hold)
                    for k in range(2):
                        n, more, curve = found[v, k]
                        weight = min(0.3, (y == k).sum() / max(n, 1))
                        slope, bend = slope + weight * more, bend + weight * curve
                    step = np.clip(np.linalg.solve(bend, slope), -4, 4)
                    now[v] += step
                    far = max(far, np.abs(step).max())
                if far < 1e-2:
                    break

    def score(self, stats, words, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of being good: by text, by metadata, by both."""
        odds = [_odds(self.text(stats, words), self.text_w), _odds(self.meta(meta), self.meta_w)]
        odds = [_odds(o[:, None], c) for o, c in zip(odds, self.calibrated)]
        both = _odds(np.stack(odds, 1), self.combined)
        return tuple(1 / (1 + np.exp(-o)) for o in (*odds, both))


def _meta(source, lang, size) -> list[tuple]:
    return [(s if s is not None else "\0", a if a is not None else "\0", math.log1p(max(n or 0, 0))) for s, a, n in zip(source, lang, size)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n"))


def _share(df: DataFrame, most: int, total: int):
    """A condition that about most of total rows meet, by hash of the id."""
    return F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 30)) < int(min(1.0, most / max(total, 1)) * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from labels (doc_id, quality, toxic); None with too few usable ones."""
    spark = ready(docs.sparkSession)
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when((F.col("quality") == 0) | (F.col("toxic") == 1), 0)
    usable = labels.select(F.col(id_col).cast("long").alias("id"), good.alias("good")).where("id is not null and good is not null")
    usable = usable.groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most")
    total = usable.count()
    picked = usable.where(_share(usable, LABELLED, total)).select("id", "good").orderBy(F.xxhash64("id")).limit(LABELLED).collect()
    if min(sum(r["good"] for r in picked), sum(1 - r["good"] for r in picked)) < LEAST:
        return None
    wanted = {r["id"]: r["good"] for r in picked}
    rows = _rows(docs, id_col, text_col)
    marks = F.broadcast(spark.createDataFrame(list(wanted.items()), "id long, good int"))  # at most LABELLED rows

    def read(batches):
        for batch in batches:
            for part in K.batch_slices(batch, 1):
                stats, words = _features(_texts(part))
                columns = [part.column(0), part.column(2), part.column(3), part.column(4), pa.array(list(stats), pa.list_(pa.float64())), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "source", "lang", "n", "stats", "words"])

    found = rows.join(marks.select("id"), "id", "left_semi").mapInArrow(read, "id long, source string, lang string, n long, stats array<double>, words array<long>")
    found = settle(found, "labelled")
    whole = found.groupBy("id").agg(F.max("source").alias("source"), F.max("lang").alias("lang"), F.avg("n").alias("n"), F.array(*[F.avg(F.col("stats")[i]) for i in range(len(STATS))]).alias("stats"))
    whole = whole.toArrow().sort_by("id").combine_chunks()  # one row for each labelled document
    ids = whole["id"].to_numpy()
    y = np.array([wanted[i] for i in ids.tolist()], float)
    if len(y) < 2 * LEAST or len(set(y)) < 2:
        return None
    meta = _meta(whole["source"].to_pylist(), whole["lang"].to_pylist(), whole["n"].to_pylist())
    stats = whole["stats"].chunk(0).flatten().to_numpy().reshape(len(y), len(STATS))
    words = found.select("id", F.explode("words").alias("word"))

    def counted(picks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = spark.createDataFrame([(i, int(good < 0.5)) for i, good in zip(ids[picks].tolist(), y[picks])], "id long, bad int")
        # an id's rows count as one document
        got = words.join(F.broadcast(told), "id").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= COMMON).toArrow()
        every = got["word"].to_numpy().view(np.uint64)
        rising = np.argsort(every)
        return every[rising], got["n"].to_numpy()[rising], got["bad"].to_numpy()[rising]

    def marked(picked: np.ndarray) -> np.ndarray:
        places = spark.createDataFrame([(w, i) for i, w in enumerate(picked.view(np.int64).tolist())], "word long, place int")
        got = words.join(F.broadcast(places), "word").groupBy("id").agg(F.collect_set("place").alias("places")).toArrow()
        out = np.zeros((len(ids), len(picked)), np.uint8)
        for i, own in zip(np.searchsorted(ids, got["id"].to_numpy()).tolist(), got["places"].to_pylist()):
            out[i, own] = 1
        return out

    others = rows.join(marks, "id", "left_anti")
    return Model(stats, meta, y, counted, marked, lambda model: _sums(others, model))


def _sums(others: DataFrame, model: Model):
    """A function of two pairs of weights, told and now: what every pseudo-label that told gives adds to the slopes at now.

    It returns {(view, class): (number of pseudo-labels, gradient, Hessian)}.
    """
    sizes = [len(model.text_w), len(model.meta_w)]
    views = (model.text, model.meta)

    def encode(batches):
        for batch in batches:
            for part in K.batch_slices(batch, 1):
                meta = _meta(*(part.column(i).to_pylist() for i in (2, 3, 4)))
                bits = [np.packbits(x.astype(bool), axis=1) for x in (views[0](*_features(_texts(part))), views[1](meta))]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()) for b in bits], ["text", "meta"])

    coded = settle(others.select("id", "text", "source", "lang", "n").mapInArrow(encode, "text binary, meta binary"), "coded")

    def at(told: list[np.ndarray], now: list[np.ndarray]) -> dict:
        told, now = [w.copy() for w in told], [w.copy() for w in now]

        def add(batches):
            total = {(v, k): [0, np.zeros(m), np.zeros((m, m))] for v, m in enumerate(sizes) for k in range(2)}
            for batch in batches:
                for a in range(0, batch.num_rows, 2000):
                    part = batch.slice(a, 2000)
                    raw = [np.frombuffer(b"".join(part.column(v).to_pylist()), np.uint8).reshape(part.num_rows, -1) for v in range(2)]
                    x = [np.hstack([np.unpackbits(r, axis=1, count=m - 1), np.ones((len(r), 1), np.uint8)]).astype(float) for r, m in zip(raw, sizes)]
                    for v in range(2):
                        chance = _chance(np.clip(x[1 - v] @ told[1 - v], -30, 30))
                        for k, sure in enumerate((chance < SURE, chance > 1 - SURE)):
                            own = x[v][sure]
                            p = _chance(np.clip(own @ now[v], -30, 30))
                            total[v, k][0] += len(own)
                            total[v, k][1] += own.T @ (k - p)
                            total[v, k][2] += (own.T * np.maximum(p * (1 - p), 1e-6)) @ own
            out = [(v, k, i, np.concatenate([[n, g[i]], h[i]])) for (v, k), (n, g, h) in total.items() for i in range(len(g)) if n]
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in list(zip(*out))[:3]), pa.array([r[3].tobytes() for r in out], pa.binary())], ["view", "class", "row", "body"])

        def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            body = np.sum([np.frombuffer(b) for b in rows["body"]], 0)
            return pd.DataFrame({"view": [key[0]], "class": [key[1]], "row": [key[2]], "body": [body.tobytes()]})

        kind = "view int, class int, row int, body binary"
        out = {(v, k): [0, np.zeros(m), np.zeros((m, m))] for v, m in enumerate(sizes) for k in range(2)}
        for r in coded.mapInArrow(add, kind).groupBy("view", "class", "row").applyInPandas(summed, kind).collect():
            body, own = np.frombuffer(r["body"]), out[r["view"], r["class"]]
            own[0], own[1][r["row"]], own[2][r["row"]] = int(body[0]), body[1], body[2:]
        return out

    return at


def _scorer(model: Model | None, at: tuple[int, ...] = (1, 2, 3, 4)):
    """Slices of batches with their scores; at: the columns of text, source, language and size."""
    text, *meta = at

    def run(batches):
        for batch in batches:
            for part in K.batch_slices(batch, text):
                if model is None:
                    scores = (np.ones(part.num_rows),) * 3
                else:
                    scores = model.score(*_features(_texts(part, text)), _meta(*(part.column(i).to_pylist() for i in meta)))
                yield [part, [pa.array(s) for s in scores]]

    return run


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_score, meta_score, quality_score, kept) of every row."""
    ready(docs.sparkSession)
    run = _scorer(model)

    def out(batches):
        for batch, scores in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores, pc.greater_equal(scores[2], THRESHOLD)], ["id", "text_score", "meta_score", "quality_score", "kept"])

    return _rows(docs, id_col, text_col).mapInArrow(out, "id long, text_score double, meta_score double, quality_score double, kept boolean")


def kept(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    ready(docs.sparkSession)
    names = docs.columns
    own = free_prefix(docs)
    # the columns as they are, each text once; behind them those that the views read
    extra = [F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    inputs = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(f"{own}{i}") for i, c in enumerate(extra)])
    run = _scorer(model, (names.index(text_col), *range(len(names), len(names) + 3)))

    def out(batches):
        for batch, scores in run(batches):
            rows = pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names)
            yield rows.filter(pa.array(scores[2].to_numpy() >= THRESHOLD))

    return inputs.mapInArrow(out, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")
