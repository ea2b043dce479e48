"""Jaccard self-join of documents by word shingles, with token-combination prefixes.

A document's tokens are its distinct shingles, ordered by how many documents hold them, rarest first. A pair whose
similarity reaches the threshold lacks at most tau = n - ceil(t * n) of a document's n tokens. Prefixes are indexed:

* a token of the rare class (held by up to ``RARE`` documents) is indexed by itself and gives one credit;
* tokens of the frequent class fall into subclasses by hash, and within a subclass every combination of k = 2 tokens of
  the prefix is indexed; a subclass with m tokens in the prefix gives m - 1 credits. The prefix is extended until
  it has tau + 1 credits.

A missing token takes at most one credit, so linked documents share an indexed token or combination. The number of
subclasses follows the size of the larger document of a pair, in powers of two; a document near a power is indexed on both levels.
Tokens that no other document holds give credits but need no index, and documents with fewer than ceil(t * n) shared tokens
link with nothing. A document with combinations has all its rare tokens indexed; so a pair that shares combinations alone has only
frequent tokens in common, and their number bounds its overlap. Keys of combinations are odd, those of single tokens even.

Documents with equal sets are joined first, by a 128-bit digest of the set, and stand as one. Candidates are verified in
rounds, each exact. First every document meets the smallest id under each of its keys. A key whose documents are then of one
component is closed. Under the open ones each document meets ``PIVOTS`` others, of other components, picked by hash; that
joins what is left of large groups of near copies. What then stays open are documents that no pivot linked, and only pairs of
different components among them are tried. Sizes, numbers of shared tokens and ``BITS`` parities of the sets bound the overlap of a
pair, so that few go on to verification. So a large group of near copies is not paired with itself.

Defined results: null and empty texts have no tokens, and link with nothing; a text with fewer words than a shingle is
one token; of rows that repeat an id, each belongs to the component of its own text, and near copies of any of the texts link with
the id; a null id is the smallest, and a component that it names is null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from . import kernels as K
from .common import documents, looked_up, parts, settle
from .graph import components

RARE = 8
PIVOTS = 8
BITS = 256


def token_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The rising distinct shingle hashes of each text."""
    h, begins = K.words(texts, lower=True)
    g = K.grams(h, k)
    out = []
    for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(g[a : z - k + 1]))
        elif z > a:
            out.append(K.mix(K.grams(h[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(g[:0])
    return out


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n must share with a linked one, at least."""
    return -(-percent * n // 100)


def keys(tokens: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """What a set is indexed by; df: how many documents hold each token."""
    n = len(tokens)
    if n < 2 or (df > 1).sum() < needed(n, percent):
        return tokens[:0]
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    credits = n - needed(n, percent) + 1
    rare = int((df <= RARE).sum())
    own = tokens[: min(rare, credits)]
    out = [K.mix(own[df[: len(own)] > 1]) & ~np.uint64(1)]
    left = credits - rare
    if left > 0:
        frequent = tokens[rare:]
        for level in sorted({n.bit_length() - 1, (100 * n // percent).bit_length() - 1}):
            kind = K.mix(frequent + np.uint64(1)) % np.uint64(max(1, (1 << level) // 8))
            first = np.zeros(len(frequent), bool)
            first[np.unique(kind, return_index=True)[1]] = True
            reach = np.flatnonzero(np.cumsum(~first) >= left)
            m = int(reach[0]) + 1 if len(reach) else len(frequent)
            by = np.lexsort((frequent[:m], kind[:m]))
            t, c = frequent[:m][by], kind[:m][by]
            for step in range(1, m):
                same = c[step:] == c[:-step]
                if not same.any():
                    break
                out.append(K.mix(K.join(t[:-step][same], t[step:][same]) + np.uint64(level + 1)) | np.uint64(1))
    return np.unique(np.concatenate(out))


def parities(tokens: np.ndarray) -> list[int]:
    """BITS parities of a set: two sets differ in at least as many tokens as bits."""
    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _index(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, shared, frequent, digest, keys, tokens, bits) of every document; tokens: the shared ones, packed, where there are keys."""
    plan = C.layout(docs, id_col, text_col)
    chunks = C.chunked(docs, plan, id_col, text_col)
    number = plan.parts(docs.sparkSession)
    shift = max(0, 64 - 17 - math.ceil(math.log2(max(2, plan.raw_bytes))))

    def tell(chunk: int, rows: pd.DataFrame) -> list[tuple]:
        held = np.concatenate([np.zeros(0, np.uint64), *token_sets(C.texts(rows)[1], k)]) >> np.uint64(shift)
        hashes, n = np.unique(held, return_counts=True)
        return C.send(chunk, hashes, number, n.astype(np.uint32), shift=shift)

    def count(rows: pd.DataFrame):
        hashes, chunk, n, first = C.gather(rows, np.uint32)
        df = np.add.reduceat(n.astype(np.int64), first)
        df = np.repeat(np.minimum(df, 2**32 - 1).astype(np.uint32), np.diff(np.append(first, len(hashes))))
        return C.answer(hashes, chunk, df > 1, df)

    def index(chunk: int, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        ids, texts = C.texts(rows)
        known, counts = C.received(got, np.uint32)
        out = []
        for tokens in token_sets(texts, k):
            there, at = K.member(tokens >> np.uint64(shift), known)
            df = np.where(there, counts[at] if len(counts) else 1, 1)
            key = keys(tokens, df, percent)
            digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            out.append((len(tokens), int((df > 1).sum()), int((df > RARE).sum()), digest, key.view(np.int64), K.pack(tokens[df > 1]) if len(key) else None, parities(tokens) if len(key) else None))
        return pd.DataFrame({"id": ids} | dict(zip(("n", "shared", "frequent", "digest", "keys", "tokens", "bits"), zip(*out))))

    counts = C.compare(chunks, tell, count, 1, 1)
    return C.with_answers(chunks, counts, index, "id long, n long, shared long, frequent long, digest binary, keys array<long>, tokens binary, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose similarity reaches the threshold."""

    def check(batches):
        last, held = None, None
        for batch in batches:
            a, na, nb, ta, tb = batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], K.unpack(ta[i])
                both = int(K.member(K.unpack(tb[i]), held)[0].sum())
                keep.append(100 * both >= percent * (na[i] + nb[i] - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    by_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    by_a = by_b.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    return by_a.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(check, "a long, b long")


def _side(entries: DataFrame, x: str) -> DataFrame:
    return entries.select("key", *[F.col(c).alias(x if c == "id" else f"{c[0]}{x}") for c in entries.columns if c != "key"])


def _may_link(percent: int, bits: bool):
    """Sizes, numbers of shared tokens and parities of the sides a and b that allow a link."""
    n = F.col("na") + F.col("nb")
    fits = F.least("sa", "sb", "na", "nb") * (100 + percent) >= percent * n
    if not bits:
        return fits
    apart = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(BITS // 64)), F.lit(0))
    return fits & (apart * (100 + percent) <= n * (100 - percent))


def _open(entries: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of keys that hold several components, with component and bits."""
    labelled = entries.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    # few entries are left: they, not all, take their sets' bits
    return settle(labelled.join(keys, "key", "left_semi").join(sets.select("id", "bits"), "id"), "open")


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document; documents link at a similarity of percent / 100 or more."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    salt = F.floor(F.rand(1) * parts(docs.sparkSession)).alias("salt")  # written once: rows that are alike get several
    index = settle(_index(docs, k, percent, id_col, text_col).select("*", salt), "index")
    classes = index.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    sets = index.where("tokens is not null").join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi")
    sets = settle(sets.select("id", "n", "shared", "frequent", "keys", "tokens", "bits").dropDuplicates(["id", "tokens"]), "sets")
    entries = sets.select("id", "n", "shared", "frequent", F.explode("keys").alias("key"))
    entries = entries.select("id", "n", F.when(F.col("key").bitwiseAND(1) == 1, F.col("frequent")).otherwise(F.col("shared")).alias("shared"), "key")

    pivots = entries.groupBy("key").agg(F.min(F.struct("id", "n", "shared")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pivots = pivots.select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), F.col("p.shared").alias("sa"))
    stars = _side(entries, "b").join(pivots, "key").where((F.col("a") != F.col("b")) & _may_link(percent, False))
    links = settle(_verified(stars.select("a", "b", "na", "nb").distinct(), sets, percent), "verified")
    found = components(links)

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    for most in (PIVOTS, None):
        rest = _open(entries, sets, found)
        if not rest.limit(1).count():
            break
        others = rest
        if most:
            # one from each of PIVOTS classes by hash
            picked = rest.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(most)).alias("class")).agg(F.min_by(F.struct(*[c for c in rest.columns if c != "key"]), F.xxhash64("id", "key")).alias("p"))
            others = picked.select("key", "p.*")
        pairs = _side(others, "a").join(_side(rest, "b"), "key").where((F.col("ca") != F.col("cb") if most else F.col("ca") < F.col("cb")) & _may_link(percent, True))
        pairs = pairs.select(*ordered, F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
        more = settle(_verified(pairs, sets, percent), "verified")
        if more.limit(1).count():
            links = links.union(more)
            found = components(links)

    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    nodes = looked_up(index.select("id", F.col("n").alias("n_shingles"), "digest", "salt"), "digest", named)
    real = lambda c: F.when(c != C.NO_ID, c)
    return nodes.select(real(F.col("id")).alias("id"), "n_shingles", real(F.coalesce("component", "rep", "id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), 4, 85).withColumnRenamed("id", "doc_id")
