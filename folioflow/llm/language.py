"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to `order` bytes long.  A byte costs the code length that
PPM with escape method C and full exclusion gives it: from the longest context that the language has
seen down to a uniform code, each step that does not know the byte pays for an escape.  The trees are
frozen after learning, so the cost of a byte depends only on itself and the `order` bytes before it;
a task looks up each distinct group of bytes once and adds up the costs of a text in one pass.  The
language with the shortest code wins, `score` is its share of 2^-bits among all languages.

Learning takes, for each language, whole texts in the order of a hash of their id until `sample_bytes`
are reached (a documented bound of the classifier's sample, see `learn`).  Every text is scored whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

ORDER = 4
SAMPLE_BYTES = 3 << 20
SAMPLE_DOCS = 2000
SLICE_BYTES = 1 << 20
REMEMBERED = 1_000_000
UNKNOWN = "und"


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the `order` bytes before it, as one integer.  Before a text stand zero bytes."""
    position = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    key = data.astype(np.uint64)
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        before[position < k] = 0
        key |= before << np.uint64(8 * k)
    return key


@dataclass
class Tree:
    """One language's counts, by context length: contexts and (context, byte) pairs, both sorted."""

    pairs: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]
    excluded: list[np.ndarray]  # counts that the next shorter context has of the bytes seen here

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, order: int) -> Tree:
        pairs, counts = [], []
        for k in range(order + 1):
            p, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            pairs.append(p)
            counts.append(np.bincount(at, weights=n, minlength=len(p)))
        contexts, totals, distinct, excluded = [], [], [], []
        for k in range(order + 1):
            c, at = np.unique(pairs[k] >> np.uint64(8), return_inverse=True)
            contexts.append(c)
            totals.append(np.bincount(at, weights=counts[k], minlength=len(c)))
            distinct.append(np.bincount(at, minlength=len(c)).astype(float))
            if k:
                shorter = pairs[k] & np.uint64((1 << 8 * k) - 1)
                excluded.append(np.bincount(at, weights=counts[k - 1][np.searchsorted(pairs[k - 1], shorter)], minlength=len(c)))
            else:
                excluded.append(np.zeros(len(c)))
        return cls(pairs, counts, contexts, totals, distinct, excluded)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each key after the bytes before it."""
        cost = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        gone, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(len(self.pairs) - 1, -1, -1):
            key = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            pair = np.minimum(np.searchsorted(self.pairs[k], key), len(self.pairs[k]) - 1)
            seen = known & (self.pairs[k][pair] == key)
            left = self.totals[k][at] - gone[open_]
            kinds = self.distinct[k][at] - gone_kinds[open_]
            share = np.where(seen, self.counts[k][pair], kinds)
            pay = known & (kinds > 0)  # with all its bytes excluded a context passes on for nothing
            cost[open_[pay]] += np.log2((left + kinds)[pay] / share[pay])
            gone[open_[known]] = self.excluded[k][at[known]]
            gone_kinds[open_[known]] = self.distinct[k][at[known]]
            open_ = open_[~seen]
        cost[open_] += np.log2(np.maximum(256 - gone_kinds[open_], 1))
        return cost


@dataclass
class Model:
    order: int
    languages: list[str]
    trees: list[Tree]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(0, np.uint64)
        self.costs = np.zeros((0, len(model.languages)), np.float32)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Costs of sorted distinct keys; those of earlier batches are remembered."""
        new = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(self.keys) + len(new) > REMEMBERED:
            self.keys, self.costs, new = self.keys[:0], self.costs[:0], keys
        if len(new):
            own = np.stack([t.bits(new) for t in self.model.trees], axis=1).astype(np.float32)
            at = np.searchsorted(self.keys, new)
            self.keys, self.costs = np.insert(self.keys, at, new), np.insert(self.costs, at, own, axis=0)
        return self.costs[np.searchsorted(self.keys, keys)]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros((len(texts), len(self.model.languages)))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        starts = (np.cumsum(sizes) - sizes)[full]
        distinct, at = np.unique(grams(np.frombuffer(b"".join(texts), np.uint8), starts, self.model.order), return_inverse=True)
        costs = self.lookup(distinct)
        for i in range(costs.shape[1]):
            out[full, i] = np.add.reduceat(costs[:, i][at].astype(np.float64), starts)
        return out


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Trees of every non-null value of `lang_col`; None if no row has both a text and a language.

    The sample: of each language the `sample_docs` rows with the least hash of their id, of these as
    many in that order as begin within the first `sample_bytes`.  Counting runs on Spark, the counts
    that return to the driver are bounded by the sample.
    """
    order_of = F.xxhash64(F.col(id_col).cast("string"))
    given = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    light = given.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), order_of.alias("h"), F.octet_length(text_col).alias("n"))
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = (light.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
              .withColumn("before", F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, -1)))
              .where(F.coalesce("before", F.lit(0)) < sample_bytes))
    bounds = chosen.groupBy("lang").agg(F.max("h").alias("top"))
    texts = (given.select(F.col(lang_col).alias("lang"), order_of.alias("h"), F.col(text_col).alias("text"))
             .join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("top")).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            langs = np.array(part.column("lang").to_pylist(), object)
            data = [t.encode() for t in part.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                own = [data[i] for i in np.flatnonzero(langs == lang)]
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                keys, n = np.unique(grams(np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    langs = np.array(rows.column("lang").to_pylist(), object)
    keys, n = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    names = sorted(set(langs))
    return Model(order, names, [Tree.of(keys[langs == x], n[langs == x], order) for x in names])


_SCORERS: dict[bytes, Scorer] = {}


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row.  `und` with score 0 where the text is null, has no letter, or
    nothing was learned; ties go to the first language by name."""
    source = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha1(source.value).digest()
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(pickle.loads(source.value) or Model(0, [], []))
        scorer = _SCORERS[key]
        names = scorer.model.languages
        for part in slices(batches, text_col, SLICE_BYTES):
            texts = part.column(text_col).to_pylist()
            usable = [bool(names) and t is not None and any(map(str.isalpha, t)) for t in texts]
            bits = scorer.bits([t.encode() if ok else b"" for t, ok in zip(texts, usable, strict=True)])
            if names:
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([
                part.column(id_col),
                pa.array([names[best[i]] if ok else UNKNOWN for i, ok in enumerate(usable)], pa.string()),
                pa.array([float(share[i]) if ok else 0.0 for i, ok in enumerate(usable)], pa.float64()),
            ], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
