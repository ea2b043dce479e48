"""Approximate nearest neighbours by cosine, over learned partitions.

1. A bounded sample (``SAMPLE`` rows, by hash of the id) gives a neighbour graph, which is cut into partitions of near equal
   size: median cuts along principal axes first, then vertices move to where most of their neighbours are, as long as
   sizes stay within 5 %.
2. A small network learns from the sample which partitions hold a vector's neighbours. Every row is indexed in its most
   probable partition; a query goes to several. How many is found on sample rows that training did not see: as few as
   keep ``TARGET`` of their neighbours. Where the data have no structure, that is most partitions.
3. A partition is searched in blocks of bounded size, so copies of one vector spread over many tasks. Candidates are
   ranked by exact cosines of the original vectors in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is
not the most common one in the sample; very large and very small components are scaled before squares are taken; ties go to the smaller id; rows that repeat an id are candidates of their own, except for
queries of that id; queries with fewer candidates than asked get all there are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready, settle

SAMPLE = 6000
NEIGHBOURS = 10
TARGET = 0.96
ROWS_OF_PART = 100  # rows for each partition, up to
PARTS = 64
BLOCK = 8192
HIDDEN = 128
EPOCHS = 25


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought near 1 by powers of two, which changes no digit of their directions but keeps squares finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of every row of unit vectors."""
    out = []
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out.append(np.argpartition(-near, k, axis=1)[:, :k])
    return np.concatenate(out)


def balanced(x: np.ndarray, near: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """A partition of the neighbour graph into count parts of near equal size with few edges between them."""
    part = np.zeros(len(x), np.int64)
    number = 1
    while number < count:  # count is a power of two
        for p in range(number):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(0)
            axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
            order = own[np.argsort(centred @ axis, kind="stable")]
            part[order[len(order) // 2 :]] = p + number
        number *= 2
    most, least = 1.05 * len(x) / count, 0.95 * len(x) / count
    for _ in range(rounds):
        votes = np.zeros((len(x), count), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes, moved = np.bincount(part, minlength=count), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] + 1 <= most and sizes[part[i]] - 1 >= least:
                sizes[best[i]] += 1
                sizes[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over the partitions."""

    def __init__(self, x: np.ndarray, wanted: np.ndarray, seed: int = 1):
        r = np.random.default_rng(seed)
        sizes = (x.shape[1], HIDDEN, wanted.shape[1])
        self.w = [r.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(n) for n in sizes[1:]]
        state = [np.zeros_like(v) for v in (*self.w, *self.b)]
        drift = [np.zeros_like(v) for v in state]
        step = 0
        for _ in range(EPOCHS):
            for own in np.array_split(r.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                hidden = np.maximum(x[own] @ self.w[0] + self.b[0], 0)
                off = (self._soft(hidden @ self.w[1] + self.b[1]) - wanted[own]) / len(own)
                back = (off @ self.w[1].T) * (hidden > 0)
                slopes = [x[own].T @ back + 1e-4 * self.w[0], hidden.T @ off + 1e-4 * self.w[1], back.sum(0), off.sum(0)]
                for v, g, m, s in zip((*self.w, *self.b), slopes, state, drift):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(x @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1])


def learn(x: np.ndarray, rows: int) -> tuple[Router | None, int, int]:
    """The router, the number of partitions and of probes, from a sample of a table with so many rows."""
    count = 1
    while 2 * count <= min(PARTS, rows / ROWS_OF_PART, len(x) / 40):
        count *= 2
    if count == 1:
        return None, 1, 1
    x = scaled(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = graph(x.astype(np.float32), NEIGHBOURS)
    part = balanced(x, near, count)
    seen = np.arange(len(x)) % 4 != 0
    wanted = np.zeros((len(x), count))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[near].ravel()), 1 / (NEIGHBOURS + 1))
    wanted[np.arange(len(x)), part] += 1 / (NEIGHBOURS + 1)
    router = Router(x[seen], wanted[seen])
    found = router(x)
    home = found.argmax(1)
    rank = np.argsort(np.argsort(-found, axis=1, kind="stable"), axis=1)
    tests = np.flatnonzero(~seen)
    at = rank[tests[:, None], home[near[tests][:, :]]].ravel()
    probes = int(np.searchsorted(np.cumsum(np.bincount(at, minlength=count)) / len(at), TARGET)) + 1
    return router, count, min(probes, count)


def _top(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each query in a block."""
    q, v = scaled(q), scaled(v)
    q_norm, v_norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    out = []
    for at in range(0, len(q), 256):
        rough = (q[at : at + 256] @ v.T) / q_norm[at : at + 256, None] / v_norm
        rough[q_ids[at : at + 256, None] == v_ids] = -np.inf
        for i, line in zip(range(at, len(q)), rough):
            if len(line) > k:
                picked = np.flatnonzero(line >= np.partition(line, -k)[-k] - 1e-9)
            else:
                picked = np.arange(len(line))
            picked = picked[np.isfinite(line[picked])]
            # the same sums for the same vectors, wherever they stand
            score = (v[picked] * q[i]).sum(1) / (q_norm[i] * v_norm[picked])
            order = np.lexsort((v_ids[picked], -score))[:k]
            out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[picked[order]], "score": score[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of df that is_query, a condition on column "id", picks."""
    spark = ready(df.sparkSession)
    vector = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fits = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & F.exists("v", lambda c: c != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fits, F.lit(False)))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, SAMPLE / total)
    # at most SAMPLE rows reach the driver
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toPandas()
    if sample.empty:
        sample = rows.limit(SAMPLE).toPandas()
    size = Counter(map(len, sample["v"])).most_common(1)[0][0]
    router, count, probes = learn(np.stack([v for v in sample["v"] if len(v) == size]), total)
    rows = rows.where(F.size("v") == size).withColumn("asks", is_query)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = scaled(np.array(batch.column(1).flatten()).reshape(-1, size))
            found = router(x / np.linalg.norm(x, axis=1, keepdims=True)) if router else np.ones((len(x), 1))
            asks = batch.column(2).to_pylist()
            goes = np.argsort(-found, axis=1, kind="stable")[:, :probes]
            columns = [batch.column(0), batch.column(1), pa.array(found.argmax(1), pa.int32()), pa.array([g if a else None for g, a in zip(goes.astype(np.int32), asks)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "part", "probes"])

    placed = settle(rows.mapInArrow(place, "id long, v array<double>, part int, probes array<int>"), "placed")
    sizes = [(r["part"], -(-r["n"] // BLOCK)) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]  # one for each partition
    blocks = F.broadcast(spark.createDataFrame(sizes, "part int, blocks int"))
    asking = placed.where("probes is not null")
    rounds = max(1, -(-asking.count() // BLOCK))
    block_of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # rows go to blocks by their number, so that rows alike spread too
    numbered = placed.withColumn("row", F.monotonically_increasing_id())
    stored = numbered.join(blocks, "part").select("part", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"), "id", "v")

    def search(queries: DataFrame) -> DataFrame:
        """The best k of each query: of every block first, then of all blocks it has seen."""
        sent = queries.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), block_of(F.lit(rounds)).alias("turn"), "id", "v").toDF("q_part", "q_block", "q_turn", "q_id", "q_v")

        def both(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return _top(np.stack(q["q_v"]), q["q_id"].to_numpy(), np.stack(v["v"]), v["id"].to_numpy(), k)

        found = sent.groupBy("q_part", "q_block", "q_turn").cogroup(stored.groupBy("part", "block", "turn")).applyInPandas(both, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    queries = asking.dropDuplicates(["id"])
    found = settle(search(queries.select("id", "v", F.explode("probes").alias("part"))), "nearest")
    # a query whose partitions held too few rows sees all of them
    short = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = settle(queries.join(short, "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "v"), "short")
    if total > k and count > 1 and short.limit(1).count():
        again = search(short.withColumn("part", F.explode(F.array(*[F.lit(p) for p, _ in sizes]))))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
