"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

1. Terms: the distinct words of a text, folded to lower case and stripped of punctuation, whole and
   as beginnings of 4 and 5 letters.  A bounded sample of labelled rows gives for each term how many
   toxic and how many other rows hold it; terms that lean to one side make the lexicons.
2. Voters: each lexicon is dealt by a hash into several voters, which say "toxic" when one of their
   terms occurs; pattern voters look at shape (runs of exclamation marks, shouted words, very short
   texts).  One scan of all texts gives each row its terms and votes.
3. Label model: vote patterns of all learning rows are counted; EM estimates the class share and each
   voter's firing rates in both classes, with the labels of the sample as one more, very accurate
   voter.  Voters that remain correlated within a class are joined into cliques whose joint patterns
   get a distribution of their own, so that dependent votes do not count twice.
4. A logistic regression over terms and votes is fitted to the posterior labels of the sample.

The sample is at most `sample_rows` labelled rows (those with the least hash of their id); vote
patterns cover every learning row, and every row is scored over its whole text.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise
from .common import slices

SAMPLE_ROWS = 20_000
LEXICON = 6_000
LEAST_SURPRISE = 10.0
BEGINNINGS = (4, 5)
PARTS = 4
SLICE_BYTES = 4 << 20
REMEMBERED = 600_000
PATTERNS = ("exclaims", "shouts", "short")
PUNCTUATION = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»„“”‘’…¡¿–—"


def terms_of(word: str) -> tuple[str, ...]:
    """Terms of a word: `=` before a whole word, its length before a beginning."""
    word = word.strip(PUNCTUATION)
    if not word or not word.isalpha():
        return ()
    return (f"={word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n))


def patterns_of(text: str) -> list[bool]:
    words = text.split(None, 12)
    return ["!!" in text, any(w.isupper() and len(w) > 3 and w.isalpha() for w in text.split()), len(words) < 12]


def kin_of(words: set[str]) -> int:
    """The least hash of the longer words: copies and near copies of a text mostly share it."""
    return min(zlib.crc32(w.encode()) for w in [x for x in words if len(x) > 5] or [" ".join(sorted(words))])


def term_counts(sample: DataFrame, text_col: str, label: str) -> DataFrame:
    """(term, pos, neg) by rows that hold the term, counted in the task before the shuffle.  Toxic rows
    with the same `kin_of` count once, or each word of a text with many copies would seem toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            neg, pos = Counter(), set()
            for text, toxic in zip(part.column(text_col).to_pylist(), part.column(label).to_pylist(), strict=True):
                words = set((text or "").lower().split())
                terms = set(itertools.chain.from_iterable(map(terms_of, words)))
                if toxic:
                    kin = kin_of(words)
                    pos.update((t, kin) for t in terms)
                else:
                    neg.update(terms)
            yield pa.RecordBatch.from_arrays([
                pa.array([*(t for t, _ in pos), *neg], pa.string()), pa.array([*(k for _, k in pos), *[-1] * len(neg)], pa.int64()),
                pa.array([*[0] * len(pos), *neg.values()], pa.int64())], ["term", "kin", "n"])

    return (sample.select(text_col, label).mapInArrow(run, "term string, kin long, n long")
            .groupBy("term", "kin").agg(F.sum("n").alias("n"))
            .groupBy("term").agg(F.sum((F.col("kin") >= 0).cast("long")).alias("pos"), F.sum("n").alias("neg")))


@dataclass
class Lexicon:
    """Term to number; numbers to voters.  Voters: parts of each lexicon, then the patterns."""

    terms: dict[str, int]
    voter: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, terms: list[str]) -> Lexicon:
        kinds = ["=", *map(str, BEGINNINGS)]
        return cls({t: i for i, t in enumerate(terms)}, [kinds.index(t[0]) * PARTS + zlib.crc32(t.encode()) % PARTS for t in terms])

    @property
    def voters(self) -> int:
        return (1 + len(BEGINNINGS)) * PARTS + len(PATTERNS)


def scan(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str) -> DataFrame:
    """(id, votes, hits): bit mask of the voters that fire and numbers of the lexicon's terms held."""
    spread = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = spread.value
        known: dict[str, tuple[int, ...] | None] = {}
        first = (1 + len(BEGINNINGS)) * PARTS
        for part in slices(batches, text_col, SLICE_BYTES):
            votes, hits = [], []
            if len(known) > REMEMBERED:
                known.clear()
            for text in part.column(text_col).to_pylist():
                text = text or ""
                words = set(text.lower().split())
                for w in words.difference(known):
                    known[w] = tuple(lex.terms[t] for t in terms_of(w) if t in lex.terms) or None
                own = sorted(set(itertools.chain.from_iterable(filter(None, map(known.__getitem__, words)))))
                mask = sum(1 << v for v in {lex.voter[i] for i in own})
                mask |= sum(1 << first + i for i, fires in enumerate(patterns_of(text)) if fires)
                votes.append(mask)
                hits.append(own)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(votes, pa.int64()), pa.array(hits, pa.list_(pa.int32()))], ["id", "votes", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, votes long, hits array<int>")


@dataclass
class LabelModel:
    """Class share and, for each clique of voters, the distribution of its patterns in both classes."""

    prior: float
    cliques: list[list[int]]
    tables: list[np.ndarray]

    @staticmethod
    def codes(votes: np.ndarray, clique: list[int]) -> np.ndarray:
        return sum(((votes >> v) & 1) << i for i, v in enumerate(clique))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for clique, table in zip(self.cliques, self.tables, strict=True):
            code = self.codes(votes, clique)
            out += np.log(table[1][code]) - np.log(table[0][code])
        return out

    @classmethod
    def fit(cls, votes: np.ndarray, label: np.ndarray, n: np.ndarray, voters: int, label_accuracy: float = 0.98,
            joined_at: float = 0.3, most_in_clique: int = 4, rounds: int = 30) -> LabelModel:
        """EM over counted patterns.  `label` is 1, 0 or -1 (none)."""
        evidence = np.log(label_accuracy / (1 - label_accuracy)) * np.where(label < 0, 0, 2 * label - 1)
        prior = min(max((n[label == 1].sum() + 1) / (n[label >= 0].sum() + 2), 1e-3), 0.5)
        # start from the labelled rows alone
        posterior = np.where(label < 0, -1, 1 / (1 + np.exp(-evidence)))
        weight = np.where(label < 0, 0, n)
        cliques = [[v] for v in range(voters)]
        for step in range(2):
            for _ in range(rounds):
                tables = []
                for clique in cliques:
                    code = cls.codes(votes, clique)
                    table = np.stack([np.bincount(code, weights=weight * p, minlength=1 << len(clique)) + 0.1 for p in (1 - posterior, posterior)])
                    tables.append(table / table.sum(axis=1, keepdims=True))
                model = cls(prior, cliques, tables)
                odds = model.log_odds(votes) + evidence
                posterior, weight = 1 / (1 + np.exp(-np.clip(odds, -60, 60))), n
                prior = min(max(float((n * posterior).sum() / n.sum()), 1e-4), 0.5)
            if step == 0:
                cliques = cls.correlated(votes, posterior, n, voters, joined_at, most_in_clique)
        return model

    @staticmethod
    def correlated(votes: np.ndarray, posterior: np.ndarray, n: np.ndarray, voters: int, joined_at: float, most: int) -> list[list[int]]:
        """Voters whose correlation within either class exceeds `joined_at`, strongest first."""
        fires = ((votes[:, None] >> np.arange(voters)) & 1).astype(float)
        strength = np.zeros((voters, voters))
        for p in (1 - posterior, posterior):
            w = n * p / max((n * p).sum(), 1e-9)
            centred = fires - w @ fires
            cov = (centred * w[:, None]).T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            strength = np.maximum(strength, np.where(np.minimum.outer(sd, sd) > 1e-4, np.abs(cov / np.outer(sd, sd)), 0))
        clique = {v: [v] for v in range(voters)}
        pairs = sorted(((strength[a, b], a, b) for a in range(voters) for b in range(a)), reverse=True)
        for s, a, b in pairs:
            if s > joined_at and clique[a] is not clique[b] and len(clique[a]) + len(clique[b]) <= most:
                clique[a].extend(clique[b])
                for v in clique[b]:
                    clique[v] = clique[a]
        return [sorted(c) for c in {id(c): c for c in clique.values()}.values()]


@dataclass
class Classifier:
    """Logistic regression: a bias, a weight for each voter and each lexicon term."""

    bias: float
    voters: np.ndarray
    terms: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, hits: list[list[int]], target: np.ndarray, voters: int, terms: int, ridge: float = 1e-4, rounds: int = 400) -> Classifier:
        """Full-batch Adam on the bounded sample; soft targets."""
        fires = ((votes[:, None] >> np.arange(voters)) & 1).astype(float)
        row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        col = np.fromiter(itertools.chain.from_iterable(hits), np.int64, len(row))
        w = np.zeros(1 + voters + terms)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            z = w[0] + fires @ w[1:1 + voters] + np.bincount(row, weights=w[1 + voters + col], minlength=len(hits))
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / max(len(hits), 1)
            grad = np.concatenate(([error.sum()], error @ fires, np.bincount(col, weights=error[row], minlength=terms)))
            grad[1:] += ridge * w[1:]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
            w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return cls(float(w[0]), w[1:1 + voters], w[1 + voters:])


@dataclass
class Fitted:
    lexicon: Lexicon
    label_model: LabelModel | None
    classifier: Classifier


def sampled(labels: DataFrame, learning: Column, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(id, label) of at most `sample_rows` labelled learning rows, those with the least hash of the id."""
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(id_col), (F.col(label_col) > 0).cast("int").alias("label")).groupBy(id_col).agg(F.max("label").alias("label"))
            .where(learning).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample_rows).withColumnRenamed(id_col, "id"))


def score(docs: DataFrame, labels: DataFrame, learning: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = SAMPLE_ROWS, lexicon_terms: int = LEXICON, cut: float = 0.3) -> DataFrame:
    """(id, score, predicted) of each row of `docs`.

    `learning` picks the rows (by the id column) that may teach.  Null and empty texts are scored like
    any text without a term; repeated rows get equal scores; with no labelled row that may teach and has a
    text here, or labels of one class only, every score is 0 or 1 by that class (0 without labels); an empty
    table gives no rows.
    """
    sample = F.broadcast(materialise(sampled(labels, learning, id_col, label_col, sample_rows)))
    present = docs.select(F.col(id_col).alias("id")).distinct().join(sample, "id")  # labels of texts that are not here teach nothing
    sizes = {r["label"]: r["n"] for r in present.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        flat = docs.select(F.col(id_col), F.lit(1.0 if pos else 0.0).alias("score"))
        return flat.withColumn("predicted", (F.col("score") >= cut).cast("int"))
    # by how much the term's share of toxic rows exceeds theirs of all rows, in log-likelihood
    p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
    share = F.lit(pos / (pos + neg))
    surprise = 2 * (p * F.log(p / (p + n) / share) + n * F.log(n / (p + n) / (1 - share)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    chosen = (term_counts(texts, "text", "label").withColumn("surprise", surprise)
              .where((F.col("pos") >= 3) & (p / (p + n) > share + (1 - share) / 3) & (F.col("surprise") > LEAST_SURPRISE))
              .orderBy(F.col("surprise").desc(), "term").limit(lexicon_terms))
    lexicon = Lexicon.of([r["term"] for r in chosen.select("term").collect()])
    votes = materialise(scan(docs, lexicon, id_col, text_col))
    taught = (votes.withColumnRenamed("id", id_col).where(learning).withColumnRenamed(id_col, "id")
              .join(sample, "id", "left").withColumn("label", F.coalesce("label", F.lit(-1))))
    counts = taught.groupBy("votes", "label").agg(F.count("*").alias("n")).toPandas()  # at most 3 rows a pattern
    model = LabelModel.fit(counts["votes"].to_numpy(), counts["label"].to_numpy(), counts["n"].to_numpy(float), lexicon.voters)
    fit = taught.where("label >= 0").select("votes", "hits", "label").toArrow()  # the bounded sample
    mask, label = fit.column("votes").to_numpy(), fit.column("label").to_numpy()
    odds = model.log_odds(mask) + np.log(0.98 / 0.02) * (2 * label - 1)
    target = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    classifier = Classifier.fit(mask, fit.column("hits").to_pylist(), target, lexicon.voters, len(lexicon.terms))
    return apply(votes, Fitted(lexicon, model, classifier), id_col, cut)


def apply(votes: DataFrame, fitted: Fitted, id_col: str, cut: float) -> DataFrame:
    """Scores from terms and votes, as columns: the weights are constants of the plan's broadcast."""
    spread = votes.sparkSession.sparkContext.broadcast(fitted.classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = spread.value
        for batch in batches:
            mask = batch.column("votes").to_numpy()
            hits = batch.column("hits")
            n = np.diff(hits.offsets.to_numpy())
            z = c.bias + ((mask[:, None] >> np.arange(len(c.voters))) & 1) @ c.voters
            z += np.bincount(np.repeat(np.arange(len(n)), n), weights=c.terms[hits.flatten().to_numpy()], minlength=len(n))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["id", "score"])

    kind = votes.schema["id"].dataType.simpleString()
    return votes.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
