"""Byte-level BPE: encoding by batched merge rounds, decoding by one gather.

A task keeps the symbols of many words in one flat array.  Each round looks up the pairs that the
round before changed by binary search over the sorted pair keys, takes every word's lowest rank with
one segmented minimum and merges its occurrences from the left.  Words without a pair left leave the
array.  Each distinct word is merged once and remembered (bounded); the vocabulary file is read on
the driver and broadcast, its size does not depend on the documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import slices

NO_RANK = np.int32(2**31 - 1)
SLICE_BYTES = 2 << 20
REMEMBERED = 600_000

# The split pattern of byte-level vocabularies and the white space of Unicode.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same split for texts of ASCII, Latin letters and common punctuation only, about twice as fast.
PLAIN_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
PLAIN = re.compile(r"[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]*")
PLAIN_SPLIT = re.compile(
    rf" ?[{PLAIN_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{PLAIN_LETTER}0-9]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself if it is visible, else the
    next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file (JSON of a byte-level BPE model)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        ids, letters = spec["model"]["vocab"], _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max([*ids.values(), *self.special.values()]) + 1
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        byte_of = {c: b for b, c in enumerate(letters)}
        plain = [b""] * self.size
        for token, i in ids.items():
            plain[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            plain[i] = token.encode()
        self.lengths = np.array([len(x) for x in plain], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.letters = np.frombuffer(b"".join(plain), np.uint8)
        self.decimals = [str(i) for i in range(self.size)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        rank = np.full(len(symbol), NO_RANK)  # of the pair a symbol makes with the next one of its word
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank_of(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = best != NO_RANK
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, rank, best = symbol[live], word[live], rank[live], best[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            # a pair of equal symbols can overlap itself: take every other one of a run
            run = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]]))))
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep) - 1
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            changed = np.zeros(len(symbol), bool)
            changed[at[hit]] = changed[np.maximum(at[hit] - 1, 0)] = True
            stale = np.flatnonzero(changed)
            rank[stale] = NO_RANK
            stale = stale[stale < len(word) - 1]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self.rank_of(symbol[stale], symbol[stale + 1])
        at = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
        return ids[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, special ones included."""
        n = self.lengths[ids]
        if not n.sum():
            return b""
        ends = np.cumsum(n)
        return self.letters[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + n, n)].tobytes()


class _Numbers(dict):
    """Numbers words in the order they come and keeps the new ones."""

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes batches of texts and remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers(zip(self.v.special, range(len(self.v.special)), strict=True))
        self.number.new = []
        self.flat = np.array([*self.v.special.values()], np.int32)
        self.sizes = np.ones(len(self.number), np.int64)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.v.special_split and any(t in text for t in self.v.special):
            parts = self.v.special_split.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.ordinary(part))]
        return self.ordinary(text)

    @staticmethod
    def ordinary(text: str) -> list[str]:
        return (PLAIN_SPLIT if PLAIN.fullmatch(text) else SPLIT).findall(text)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null or empty text has none."""
        if len(self.number) > REMEMBERED:
            self.forget()
        words = [np.fromiter(map(self.number.__getitem__, ws := self.words(t or "")), np.int64, len(ws)) for t in texts]
        if self.number.new:
            ids, sizes = self.v.merge([w.encode() for w in self.number.new])
            self.flat, self.sizes = np.concatenate((self.flat, ids)), np.concatenate((self.sizes, sizes))
            self.number.new = []
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for k in words:
            n = self.sizes[k]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[k] - ends + n, n)])
        return out


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(source: Broadcast) -> Encoder:
    """One encoder in each Python worker, kept from task to task."""
    key = hashlib.sha1(source.value).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(source.value))
    return _ENCODERS[key]


def vocabulary_source(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file for all tasks; 1 to 5 MB, whatever the documents are."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_ids) of each row.  Null and empty texts give no ids; equal rows stay as they
    are; an empty table gives none.  Strings of special tokens are encoded as these tokens."""
    source = vocabulary_source(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source)
        for part in slices(batches, text_col, SLICE_BYTES):
            ids = encoder(part.column(text_col).to_pylist())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(offsets).astype(np.int64)), lists], ["id", "n_tokens", "token_ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, token_ids array<int>")
            .withColumnRenamed("id", id_col))


def decode(tokens: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) of rows of token ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    source = vocabulary_source(tokens.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder_of(source).v
        for batch in batches:
            texts = [v.decode(np.asarray(x.values if x.is_valid else [], np.int64)).decode("utf-8", "replace")
                     for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and its ids are decoded in one
    pass, and only their digests leave the task."""
    source = vocabulary_source(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source)
        decimal, sha = encoder.v.decimals.__getitem__, hashlib.sha256
        for part in slices(batches, text_col, SLICE_BYTES):
            ids = encoder(part.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([
                part.column(id_col),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sha(",".join(map(decimal, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
                pa.array([sha(encoder.v.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids], pa.string()),
            ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(id_col, text_col)
            .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
