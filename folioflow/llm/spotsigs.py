"""SpotSigs fingerprints: chains of content words that follow common words.

Every occurrence of a common word (an anchor) gives one signature, the anchor with the next `CHAIN`
words that are no anchors themselves.  The set of a text's signatures is its fingerprint: their 32-bit
hashes in ascending order, 8 hex digits each.  A text with fewer than `FEW` of them adds its pairs of
neighbouring words, and if they are still fewer its runs of three characters; an empty text has none.
The likeness of two fingerprints is the Jaccard similarity of their sets, 1 for two empty ones.

`near_pairs` compares the distinct fingerprints of a table: sets are partitioned by length, so that only
the same and the next partition can hold a set of fitting length; within a partition sets meet on one of
the first hashes, of which two sets that are similar enough share one; lengths prune before the rest is
compared.  No pair of a group of equal fingerprints is listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import pieces, slices

CHAIN = 2
FEW = 8
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(w.encode() for w in """
a an and are as at be by for from had has have he in is it its not of on or that the there this to was were which will with you
als an auch auf aus bei bin das dass dem den der des die ein eine er es für ich im in ist mit nicht sich sie sind so und von war wie zu
au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour que qui sa se son sur un une vous
al como con de del el ella en era es esta la las lo los más no para pero por que se su sus un una y ya
""".split())
#: ASCII characters that are no letters part words.
WORD_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def signatures(text: str | None) -> np.ndarray:
    """Ascending distinct signature hashes."""
    if not text:
        return np.zeros(0, np.uint32)
    words = text.lower().encode().translate(WORD_TABLE).split()
    content: list[bytes] = []
    anchors: list[tuple[bytes, int]] = []
    for w in words:
        if w in ANCHORS:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    h = xxhash.xxh32_intdigest
    found = {h(b" ".join((w, *content[k:k + CHAIN]))) for w, k in anchors if k < len(content)}
    if len(found) < FEW:
        found.update(h(b" ".join(words[i:i + 2])) for i in range(len(words) - 1))
    if len(found) < FEW:
        found.update(h(text[i:i + 3].encode(), 1) for i in range(max(len(text) - 2, 1)))
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def written(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without comparing where the lengths alone keep it below `least`."""
    short, long_ = sorted((len(a), len(b)))
    if not long_:
        return 1.0
    if short < least * long_ or not short:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (short + long_ - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sigs) of each row; null and empty texts have none; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            sigs = [signatures(t).astype(np.int64) for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(sigs, pa.list_(pa.int64()))], ["id", "sigs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, sigs array<long>").withColumnRenamed("id", id_col)


def near_pairs(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and pairs (a, b, likeness) of class ids with a likeness of `least` or more.

    A class is the rows with equal fingerprints, named by its least id (rows without signatures form one
    class, which is in no pair); a pair has a < b.
    """
    classes = prints.groupBy("sigs").agg(F.min(id_col).alias("class_id"))
    members = prints.join(classes, "sigs").select(id_col, "class_id")
    n = F.size("sigs")
    level = F.floor(F.log(n.cast("double")) / math.log(1 / least) + 1e-9)
    prefix = n - F.ceil(least * n - 1e-9) + 1
    sets = classes.where(n > 0).select("class_id", n.alias("n"), level.alias("level"), F.slice("sigs", 1, prefix.cast("int")).alias("first"))
    index = sets.select("class_id", "n", "level", F.explode("first").alias("sig"))
    probe = (sets.select(F.col("class_id").alias("other"), F.col("n").alias("m"), F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"), "first")
             .select("other", "m", "level", F.explode("first").alias("sig")))
    # the probing set is the shorter one; of two of equal length the one with the lesser id
    found = (probe.join(index, ["level", "sig"])
             .where((F.col("m") >= least * F.col("n") - 1e-9) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("class_id")))))
             .select("other", "class_id").distinct())
    whole = classes.select("class_id", "sigs")
    both = F.size(F.array_intersect("x", "y"))
    pairs = (found.join(whole.select(F.col("class_id").alias("other"), F.col("sigs").alias("x")), "other")
             .join(whole.withColumnRenamed("sigs", "y"), "class_id")
             .withColumn("likeness", both / (F.size("x") + F.size("y") - both)).where(F.col("likeness") >= least)
             .select(F.least("other", "class_id").alias("a"), F.greatest("other", "class_id").alias("b"), "likeness"))
    return members, pairs


def with_next(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, guest, id, text) of which each block, in order, holds neighbours by id.

    Blocks are ranges of ids of about `block_bytes`; the first rows of each are also sent, as guests, to
    the block before (those of the first block to the last), so one shuffle of the texts is enough.  The
    bounds are one number for each block, which is all that is broadcast.
    """
    spark = docs.sparkSession
    count = pieces(docs, block_bytes)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    shares = [i / count for i in range(1, count)]
    row = docs.select(place.alias("place")).agg(F.min("place").alias("least"), F.percentile_approx("place", shares, 10 * count).alias("bounds")).first()
    bounds = sorted({row["least"], *row["bounds"]}) if row["bounds"] else []
    starts = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.pandas_udf(LongType())
    def block_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts.value, place.to_numpy(), side="right") - 1, 0), index=place.index)

    @F.pandas_udf(LongType())
    def begins(place: pd.Series) -> pd.Series:
        """The block before one that begins here, else -1."""
        at = np.searchsorted(starts.value, place.to_numpy())
        here = (at < len(starts.value)) & (starts.value[np.minimum(at, len(starts.value) - 1)] == place.to_numpy())
        return pd.Series(np.where(here, (at - 1) % max(len(starts.value), 1), -1), index=place.index)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), place.alias("place"))
    rows = rows.select("id", "text", "place", block_of("place").alias("own"), begins("place").alias("before"))
    seats = F.array_compact(F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("guest")),
                                    F.when(F.col("before") >= 0, F.struct(F.col("before").alias("block"), F.lit(True).alias("guest")))))
    return (rows.select("id", "text", "place", F.explode(seats).alias("seat")).select("seat.block", "seat.guest", "id", "text", "place")
            .repartition(max(len(bounds), 1), "block").sortWithinPartitions("block", "guest", "place", "text").select("block", "guest", "id", "text"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text (the last quarter of its code points replaced
    by the first as many of the next row by id; after the last row comes the first): id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty.  Null ids come first, rows with equal ids stand in the order of their
    texts; a single row follows itself; an empty table gives none.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each own row with its block and that of the row after it."""
        held = None
        for part in slices(batches, "text", SLICE_BYTES):
            for block, guest, id_, text in zip(*(part.column(c).to_pylist() for c in ("block", "guest", "id", "text")), strict=True):
                text = text or ""
                now = (block, guest, id_, text, signatures(text))
                if held is not None and held[0] == block and not held[1]:
                    yield held, now
                held = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_kind), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names)

        for (_, _, id_, text, own), (_, _, _, after, other) in rows(batches):
            n = len(text)
            edited = text[:n - n // 4] + after[:n // 4]
            sigs = signatures(edited)
            out.append((id_, n, hashlib.sha256(edited.encode()).hexdigest(), written(own), written(sigs), likeness(own, sigs), likeness(own, other)))
            size += 4 * n + 200
            if size > SLICE_BYTES:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    id_kind = pa.int64()
    return (with_next(docs, id_col, text_col)
            .mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
            .withColumnRenamed("id", id_col))
