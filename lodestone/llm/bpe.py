"""Byte-pair encoding and decoding with a public vocabulary in the tokenizers library's file format.

The file's normaliser (NFC, lower case), split pattern, byte alphabet, end-of-word suffix and merge ranks are honoured for
files of the kind of ``word_bpe_49k.json``; white space separates words and is dropped, so a text is encoded word by word.
The symbols of a piece form a doubly linked list; a priority queue holds the ranks of mergeable neighbours, and entries
whose neighbours have changed meanwhile are skipped. Decoding puts together the vocabulary's strings, one space between
them, as the library does for a file that names no decoder.

Words already seen by a worker are kept, up to a fixed number of bytes; that changes the speed only.

Defined results: null and empty texts have no ids and decode to an empty text; special tokens spelled out in a text get their
ids; white space beyond ASCII separates pieces within a word; symbols that the vocabulary lacks are dropped; repeated
rows and rows with null ids are encoded like any other; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ready

WORDS_KEPT = PIECES_KEPT = 64 << 20  # bytes
# The split pattern's white space (the Unicode property, spelled out) and its contractions.
WHITE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class _Kept(dict):
    """A memory of a function of bytes or text, bounded in bytes."""

    def __init__(self, function, most: int):
        self.function, self.most, self.held = function, most, 0

    def __missing__(self, key):
        found = self.function(key)
        self.held += len(key) + len(found) + 160
        if self.held > self.most:
            self.clear()
            self.held = len(key) + len(found) + 160
        self[key] = found
        return found


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        # (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        letters = byte_letters()
        self.plain = [self.ids.get(x) for x in letters]
        self.last = [self.ids.get(x + self.suffix) for x in letters]
        self.split = regex.compile(SPLIT)
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = _Kept(self._piece, PIECES_KEPT)
        self.words = _Kept(self._word, WORDS_KEPT)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        symbols = [self.plain[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return np.array(self.merged([s for s in symbols if s is not None]), "<u4").tobytes()

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges neighbours by rank, of equal ranks the leftmost first."""
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, symbols[k])):
                    heapq.heappush(queue, (found[0], i, new, symbols[k], found[1]))
            p = before[i]
            if p >= 0 and (found := merges.get((symbols[p], new))):
                heapq.heappush(queue, (found[0], p, symbols[p], new, found[1]))
        return [s for s in symbols if s >= 0]

    def normal(self, text: str) -> str:
        # lower case letter by letter: a capital sigma doesn't look at what follows
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split_pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens, normalised."""
        return self.split.findall(self.normal(text))

    def _plain(self, text: str) -> list[bytes]:
        return [self.pieces[p] for p in self.split_pieces(text)]

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone: nothing to normalise or split
            return self.pieces[word.lower().decode()]
        if word[-1:] in b".,|" and word[:-1].isalpha():
            return self.pieces[word[:-1].lower().decode()] + self.pieces[word[-1:].decode()]
        text, out, at = word.decode("utf-8", "replace"), [], 0
        if self.find_special and "<|" in text:
            for m in self.find_special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(np.array([self.special[m[0]]], "<u4").tobytes())
                at = m.end()
        return b"".join(out + self._plain(text[at:]))

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def encoded(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    ready(df.sparkSession)
    path = path or vocabulary_path()
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        own = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t or b""), "<u4").astype(np.int32) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decoded(df: DataFrame, path: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids decode to an empty text."""
    ready(df.sparkSession)
    path = path or vocabulary_path()
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""
    ready(df.sparkSession)
    path = path or vocabulary_path()
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        own = encoder(path)
        for batch in batches:
            n, shas, back = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                ids = own.encode(text or b"")
                n.append(len(ids) // 4)
                shas.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
