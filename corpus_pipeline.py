"""A training-data pipeline over `documents`: each stage calls one operator of `folioflow.llm`.

Stages hand on the columns of `documents`; the last one returns token ids.  Rows are judged one by one, also
where ids are null or repeat (`keyed`).  Null and empty texts run through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, lines, mixing, ngram_join, simhash, toxicity
from folioflow.llm.common import HELD_OUT, read
from folioflow.llm.components import components
from folioflow.plans.checkpoints import materialise, scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Weights of languages among their siblings; every source keeps at least one whole epoch.
WEIGHTS = {("de",): 1.0, ("en",): 2.0, ("es",): 1.0, ("fr",): 1.0}


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their id and text: equal only for copies under one id."""
    return docs.withColumn("__key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("null"))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator does not call toxic.  A row learns the label of its id, unless that is held out."""
    rows = keyed(docs)
    labels = rows.select("doc_id", "__key").distinct().join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select("__key", "toxic")
    own_id = F.substring_index("__key", ":", 1)
    scores = toxicity.score(rows, labels, F.crc32(own_id) % 4 != HELD_OUT, id_col="__key")
    rejected = scores.where("predicted = 1").select("__key").distinct()
    return rows.join(rejected, "__key", "left_anti").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, but for two edits, in an earlier one, whatever their share of a
    document; see `llm.lines`."""
    kept = lines.without_repeats(docs, most_removed=lines.EVERY_LINE).select(docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by SimHash fingerprints or by shingles.

    Fingerprints of five-word shingles link at two or fewer differing bits, sets of these shingles at a
    Jaccard similarity of 0.8 or more; either finds links the other does not.  The row with the least id
    stays, of equal ids the least by its columns; null ids come last.  Texts without words, such as line
    dedup leaves of copies, have one fingerprint and so are one group.
    """
    rows = keyed(docs)
    close = simhash.near_duplicates(rows, "__key", "text", width=ngram_join.WIDTH).select("__key", F.col("component_id").alias("of"))
    alike = ngram_join.groups(rows, "__key", "text").select("__key", F.col("component_id").alias("of"))
    links = materialise(close.unionByName(alike).where("of <> __key").distinct())
    root = components(links, "__key", "of").withColumnRenamed("node", "__key")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__key")
    stays = (rows.select("doc_id", "__key").distinct().join(root, "__key", "left").groupBy(F.coalesce("root", "__key")).agg(F.min(order).alias("first"))
             .select(F.col("first.__key").alias("__key")))
    return rows.join(stays, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those that weights by language and source ask for again: a fifth more
    tokens than there are, no source more than three times."""
    counted = docs.withColumn("__tokens", mixing.words_in("text"))
    taken = mixing.mix(counted, ["lang", "source"], WEIGHTS, share_of_supply=1.2, least_epochs=1, most_epochs=3, seed=11, tokens_col="__tokens")
    times = taken.groupBy("doc_id").agg(F.max("epoch").alias("last"))
    return (docs.join(times.withColumnRenamed("doc_id", "taken"), F.col("doc_id").eqNullSafe(F.col("taken")))
            .withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of each row."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: The stages learn, link and merge: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the cluster's shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
