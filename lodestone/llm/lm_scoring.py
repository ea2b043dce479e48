"""Scoring of documents by a Brown class-based bigram model learned from the corpus itself.

p(text) is the product over tokens of p(class | class before) * p(word | class); every text is framed by an end token.

1. All words of the training documents are counted. The ``SEEDS`` most common ones, and their bigrams in all training
   documents, go to the driver (a bounded table), where exchange clustering moves one word at a time to the class that
   gives the corpus the highest likelihood, until few words move. The number of classes grows with the vocabulary.
2. ``ROUNDS`` rounds of exchange over the whole vocabulary follow, on the executors. In a round all words of the training documents,
   the seeds too, are looked at side by side, the others staying where they are: the classes before and after a word are counted over the
   whole corpus, and the word goes to the class of highest gain in likelihood (to first order in the word's counts). The first round
   knows the seeds' classes alone, the later ones the classes of all words. Words by words these counts never leave the executors.
3. Class transitions are counted over all training documents, and are smoothed towards the classes' own shares. Words that
   training lacks are one word in a class of its own; what follows words seen once tells how likely it is.

The base score is that of a smoothed unigram model over the same counts. Words are told apart by 64-bit hashes.

Defined results: null and empty texts hold the end token alone; a null id counts as an empty one when documents are dealt into
training and held-out ones; rows that repeat an id are scored one by one; an empty table gives an empty result; with no
training document every count is 0; other columns take no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from . import kernels as K
from .common import documents, ready, settle

SEEDS = 512
ROUNDS = 2
MOST_CLASSES = 250  # reached at some 240 million words; a class takes a byte
STEPS = 8
FOLDS = 10
SLICE = 8 << 20  # bytes of text that a task counts at once
BLOCK = 4096  # words whose gains a task weighs at once
WEIGHT = 5.0  # tokens that the classes' own shares count for

END = 0


def classes_for(types: int) -> int:
    """How many classes a vocabulary of so many words gets."""
    return int(min(MOST_CLASSES, max(8, round(2 * types**0.25))))


def held_out(ids: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == C.NO_ID else str(i).encode()) % folds == 0 for i in ids.tolist()], bool)


def exchange(bigrams: np.ndarray, classes: int, rounds: int = STEPS) -> np.ndarray:
    """Classes 0.. of the words 1.. by the exchange algorithm; word 0, the end, keeps a class of its own (the last).

    Maximises sum N(c,d) log N(c,d) - sum N(c,.) log N(c,.) - sum N(.,c) log N(.,c) over the words' bigrams.
    """
    n = len(bigrams)
    kinds = classes + 1
    own = (K.mix(np.arange(n - 1, dtype=np.uint64)) % np.uint64(classes)).astype(np.int64)
    own = np.concatenate([[classes], own])
    one = np.eye(kinds)[own]
    b = bigrams.astype(np.float64)
    table = one.T @ b @ one
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds):
        moved = 0
        for w in range(1, n):
            old = own[w]
            right, left, self_ = b[w] @ one, b[:, w] @ one, b[w, w]
            right[old] -= self_
            left[old] -= self_
            # the table without w
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_
            rows, cols = table.sum(1), table.sum(0)
            r, c = right.sum() + self_, left.sum() + self_
            # gain[k]: of putting w into class k
            diagonal = np.diag(table)
            gain = (xlogx(table + right) - xlogx(table)).sum(1) + (xlogx(table + left[:, None]) - xlogx(table)).sum(0)
            gain -= xlogx(diagonal + right) - xlogx(diagonal) + xlogx(diagonal + left) - xlogx(diagonal)
            gain += xlogx(diagonal + right + left + self_) - xlogx(diagonal)
            gain -= xlogx(rows + r) - xlogx(rows) + xlogx(cols + c) - xlogx(cols)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += self_
            if new != old:
                own[w] = new
                one[w] = np.eye(kinds)[new]
                moved += 1
        if moved * 200 <= n:
            break
    return own[1:]


def _frequent(docs: DataFrame, number: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Hashes (rising) and counts of the most common training words; all words' tokens and types; ends."""

    def tell(batches):
        for batch in (part for whole in batches for part in K.batch_slices(whole, 1, SLICE)):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t, out in zip(texts, held_out(ids)) if not out]
            rows = []
            for a, z in K.slices(texts, SLICE):
                hashes, n = np.unique(K.words(texts[a:z], lower=True)[0], return_counts=True)
                rows += C.send(0, hashes, number, n.astype(np.uint32))
            rows.append((-1, 0, K.pack(np.zeros(0, np.uint64)), K.squeeze(np.array([len(texts)], np.uint32))))
            yield pa.RecordBatch.from_pandas(C.frame(rows, ["part", "chunk"], 1).astype({"part": np.int32, "chunk": np.int32}), preserve_index=False)

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            ends = sum(int(K.unsqueeze(x, np.uint32)[0]) for x in rows["more0"])
            return pd.DataFrame({"word": [0], "n": [ends], "kind": ["end"]})
        hashes, _, n, first = C.gather(rows, np.uint32)
        n = np.add.reduceat(n.astype(np.int64), first)
        top = np.lexsort((hashes[first], -n))[:SEEDS]
        out = pd.DataFrame({"word": hashes[first][top].view(np.int64), "n": n[top], "kind": "word"})
        return pd.concat([out, pd.DataFrame({"word": [0, 0], "n": [n.sum(), len(n)], "kind": ["tokens", "types"]})])

    told = docs.mapInArrow(tell, C.schema("part int, chunk int", 1))
    # the ends' rows are one for each batch; they are summed in parts too
    found = settle(told.groupBy("part").applyInPandas(total, "word long, n long, kind string"), "words")
    sums = {r["kind"]: r["n"] for r in found.where("kind != 'word'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    top = found.where("kind = 'word'").orderBy(F.desc("n"), "word").limit(SEEDS).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["n"] for r in top], np.int64)[order], sums.get("tokens", 0), sums.get("types", 0), sums.get("end", 0)


def _bigrams(docs: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the ends (0) and the frequent words (1..) in all training documents."""
    size = len(frequent) + 1

    def count(batches):
        for batch in (part for whole in batches for part in K.batch_slices(whole, 1, SLICE)):
            texts = [t or b"" for t, out in zip(batch.column(1).cast(pa.binary()).to_pylist(), held_out(batch.column(0).to_numpy())) if not out]
            for a, z in K.slices(texts, SLICE):
                h, begins = K.words(texts[a:z], lower=True)
                there, at = K.member(h, frequent)
                # an end before and after every text
                line = np.insert(np.where(there, at + 1, -1), begins, 0)
                ok = (line[:-1] >= 0) & (line[1:] >= 0)
                pair, n = np.unique(line[:-1][ok] * size + line[1:][ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    found = docs.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def gains(left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """By words and classes 1..: what the likelihood gains where a word joins a class, to first order in the word's counts.

    left and right count the classes before and after each word; table counts classes by the class before.
    """
    log = np.log(table + 0.5)
    rows, cols = np.log(table.sum(1) + 0.5 * len(table)), np.log(table.sum(0) + 0.5 * len(table))
    gain = left @ log + right @ log.T - left.sum(1, keepdims=True) * cols - right.sum(1, keepdims=True) * rows
    return gain[:, 1:]


def _around(klass: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes before and after each word; texts are framed by ends."""
    before, after = np.full(len(klass), END), np.full(len(klass), END)
    before[1:], after[:-1] = klass[:-1], klass[1:]
    full = np.diff(begins) > 0
    before[begins[:-1][full]], after[begins[1:][full] - 1] = END, END
    return before, after


def _told(chunk: int, rows: pd.DataFrame, number: int, kinds: int, classed) -> list[tuple]:
    """A chunk tells the classes around its words. classed(hashes): the class of each, or kinds where it has none. A row of part -1 holds the chunk's transitions."""
    ids, texts = C.texts(rows)
    h, begins = K.words(texts, lower=True)
    train = np.repeat(~held_out(ids), np.diff(begins))
    klass = classed(h)
    before, after = _around(klass, begins)
    words, at = np.unique(h, return_inverse=True)
    width = 2 * (kinds + 1)
    both = np.concatenate([at[train] * width + before[train], at[train] * width + kinds + 1 + after[train]])
    # held-out documents ask for their words' classes too, which counts for nothing
    code, n = np.unique(np.concatenate([both, np.arange(len(words)) * width + kinds]), return_counts=True)
    n[np.searchsorted(code, np.arange(len(words)) * width + kinds)] -= 1
    out = C.send(chunk, words[code // width], number, (code % width).astype(np.uint16), n.astype(np.uint32))
    # transitions between classed words and from and to the ends, each once
    inner = train & (before < kinds) & (klass < kinds)
    last = train & (after == END) & (klass < kinds)
    pair, m = np.unique(np.concatenate([before[inner] * kinds + klass[inner], klass[last] * kinds]), return_counts=True)
    return [*out, (-1, chunk, K.pack(np.zeros(0, np.uint64)), K.squeeze(pair.astype(np.uint32)), K.squeeze(m.astype(np.uint64)))]


def _round(chunks: DataFrame, number: int, kinds: int, answers: DataFrame | None, seeds: np.ndarray, seed_class: np.ndarray, table: np.ndarray | None) -> DataFrame:
    """A round over all words: chunks tell, parts choose, and answer (class, count) by word. Without a table the chunks' transitions make it."""

    def by_seeds(h: np.ndarray) -> np.ndarray:
        there, at = K.member(h, seeds)
        return np.where(there, seed_class[at] if len(seeds) else kinds, kinds).astype(np.int64)

    def by_answers(got: pd.DataFrame):
        known, kind, _ = C.received(got, np.uint8, np.uint64)

        def classed(h: np.ndarray) -> np.ndarray:
            there, at = K.member(h, known)
            return np.where(there, kind[at] if len(kind) else kinds, kinds).astype(np.int64)

        return classed

    kind = C.schema("part int, chunk int", 2)
    frame = lambda rows: C.frame(rows, ["part", "chunk"], 2)
    if answers is None:
        told = chunks.groupBy("chunk").applyInPandas(lambda key, rows: frame(_told(int(key[0]), rows, number, kinds, by_seeds)), kind)
    else:
        told = C.with_answers(chunks, answers, lambda chunk, rows, got: frame(_told(chunk, rows, number, kinds, by_answers(got)) if len(rows) else []), kind)
    if table is None:
        told = settle(told, "told")

        def unroll(batches):
            for batch in batches:
                for p, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(K.unsqueeze(p, np.uint32).astype(np.int64)), pa.array(K.unsqueeze(m, np.uint64).astype(np.int64))], ["pair", "n"])

        # at most kinds * kinds rows
        found = told.where("part < 0").select("more0", "more1").mapInArrow(unroll, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        table = np.zeros(kinds * kinds)
        for r in found:
            table[r["pair"]] = r["n"]
        table = table.reshape(kinds, kinds)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, chunk, code, n, first = C.gather(rows, np.uint16, np.uint32)
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
        width = 2 * (kinds + 1)
        klass, total = np.zeros(len(first), np.uint8), np.zeros(len(first), np.int64)
        for a in range(0, len(first), BLOCK):
            z = min(a + BLOCK, len(first))
            own = slice(first[a], first[z] if z < len(first) else len(hashes))
            dense = np.bincount((word[own] - a) * width + code[own], weights=n[own], minlength=(z - a) * width).reshape(z - a, width)
            total[a:z] = dense[:, : kinds + 1].sum(1).round().astype(np.int64)
            left, right = dense[:, :kinds], dense[:, kinds + 1 : -1]
            best = gains(left, right, table).argmax(1)
            # words with nothing classed around them are spread
            best = np.where(left.sum(1) + right.sum(1) > 0, best, (K.mix(hashes[first[a:z]]) % np.uint64(kinds - 1)).astype(np.int64))
            klass[a:z] = 1 + best
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (chunk[1:] != chunk[:-1])) if len(hashes) else np.zeros(0, bool)
        return C.frame(list(C.answer(hashes, chunk, new & (total[word] > 0), klass[word], total[word].astype(np.uint64))), ["chunk"], 2)

    return told.where("part >= 0").groupBy("part").applyInPandas(choose, C.schema("chunk int", 2))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_out: dict | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document.

    model_out, where given, gets the words' classes and counts (answers) and the transitions (table).
    """
    spark = ready(df.sparkSession)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NO_ID)).alias("id"), F.col(text_col).alias("text"))
    plan = C.layout(docs, "id", "text")
    number = plan.parts(spark)
    frequent, counts, tokens, types, ends = _frequent(docs, number)
    bigrams = _bigrams(docs, frequent)
    kinds = 1 + classes_for(types)
    unknown, size_all = kinds, kinds + 1
    seed_class = 1 + exchange(bigrams, kinds - 1)
    of = np.eye(kinds)[np.append(END, seed_class)]
    all_tokens, all_types = tokens + ends, types + (ends > 0)
    below = all_tokens + 0.1 * (all_types + 1)

    chunks = C.chunked(docs, plan, "id", "text")
    answers = _round(chunks, number, kinds, None, frequent, seed_class, of.T @ bigrams @ of)
    for _ in range(ROUNDS - 1):
        answers = _round(chunks, number, kinds, answers, frequent, seed_class, None)

    def read(chunk: int, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        """What scoring needs of each document; and the chunk's transitions, in a row of their own."""
        ids, texts = C.texts(rows)
        held = held_out(ids)
        h, begins = K.words(texts, lower=True)
        known, kind, n = C.received(got, np.uint8, np.uint64)
        there, at = K.member(h, known)
        klass = np.where(there, kind[at] if len(kind) else unknown, unknown).astype(np.int64)
        c = np.where(there, n[at] if len(n) else 0, 0).astype(np.int64)
        base, log_c = np.log10((c + 0.1) / below), np.log10(np.maximum(c, 1))
        end_base = float(np.log10((ends + 0.1) / below))
        matrix = np.zeros(size_all * size_all, np.int64)
        out = []
        for i, a, z in zip(range(len(ids)), begins[:-1].tolist(), begins[1:].tolist()):
            line = np.zeros(z - a + 2, np.int64)
            line[1:-1] = klass[a:z]
            pairs, m = np.unique(line[:-1] * size_all + line[1:], return_counts=True)
            if not held[i]:
                matrix[pairs] += m
                once = np.flatnonzero(c[a:z] == 1)
                np.add.at(matrix, line[once] * size_all + unknown, 1)
            blob = K.squeeze(np.concatenate([pairs, m]).astype("<u4"))
            out.append((0, ids[i], bool(held[i]), z - a + 1, int((c[a:z] > 0).sum()) + (ends > 0), float(base[a:z].sum()) + end_base, float(log_c[a:z].sum()), blob))
        pairs = np.flatnonzero(matrix)
        out.append((1, C.NO_ID, False, 0, 0, 0.0, 0.0, np.concatenate([pairs, matrix[pairs]]).astype("<u8").tobytes()))
        return pd.DataFrame(out, columns=["kind", "id", "held_out", "n_tokens", "n_known", "base_score", "log_c", "pairs"])

    if model_out is not None:
        answers = settle(answers, "answers")
    read_out = settle(C.with_answers(chunks, answers, read, "kind int, id long, held_out boolean, n_tokens long, n_known long, base_score double, log_c double, pairs binary"), "read")

    def unroll(batches):
        for batch in batches:
            both = [np.frombuffer(x, "<u8").reshape(2, -1) for x in batch.column(0).to_pylist()]
            if both:
                both = np.concatenate(both, 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["pair", "n"])

    # at most size_all * size_all rows
    found = read_out.where("kind = 1").select("pairs").mapInArrow(unroll, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(size_all * size_all)
    for r in found:
        table[r["pair"]] = r["n"]
    logs, size = transitions(table.reshape(size_all, size_all))
    if model_out is not None:
        model_out |= {"answers": answers, "table": table.reshape(size_all, size_all), "seeds": (frequent, seed_class)}

    def score(batches):
        for batch in batches:
            out = []
            for log_c, blob in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                pairs, m = K.unsqueeze(blob, "<u4").reshape(2, -1).astype(np.int64)
                out.append(log_c + float((logs[pairs] * m).sum() - (size[pairs % size_all] * m).sum()))
            n = batch.column(2).to_numpy()
            columns = [batch.column(i) for i in range(4)] + [pa.array([all_tokens] * len(out), pa.int64()), batch.column(6), pa.array(out, pa.float64()), pa.array(10 ** (-np.array(out) / n), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = read_out.where("kind = 0").select("id", "held_out", "n_tokens", "n_known", "log_c", "pairs", "base_score")
    out = rows.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out.withColumn("id", F.when(F.col("id") != C.NO_ID, F.col("id")))


def transitions(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p(class | class before), flat, and log10 of the classes' sizes (0 for the end and the unknown word, which is the last class)."""
    unknown = len(table) - 1
    seen = table.copy()
    seen[:, unknown] = 0
    share = (table.sum(0) + 0.1) / (table.sum() + 0.1 * len(table))
    p = (table + WEIGHT * share) / (table.sum(1, keepdims=True) + WEIGHT)
    p[unknown] = share  # what follows an unknown word is not known
    size = seen.sum(0)
    size[[END, unknown]] = 1
    return np.log10(p).ravel(), np.log10(np.maximum(size, 1))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
