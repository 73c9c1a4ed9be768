"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, conversation_repair, conversation_trie, language, lines, mixing, ngram_join, simhash, spotsigs, suffixes, token_files, toxicity
from .common import held_out, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Weights of domains, and of English, among their siblings; all others have weight 1.
WEIGHTS = {("d0",): 5.0, ("d1",): 3.0, ("d2",): 2.0} | {(f"d{i}", "en"): 3.0 for i in range(3)}


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens by weight, no source more than twice; a source's domain is its crc32 modulo 3."""
    domain = F.concat(F.lit("d"), F.crc32(F.coalesce("source", F.lit(""))) % 3)
    docs = read(spark, sf_dir, "documents").select("doc_id", domain.alias("domain"), "lang", "source", mixing.words_in("text").alias("n_tokens"))
    return mixing.mix(docs, ["domain", "lang", "source"], WEIGHTS, share_of_supply=0.5, most_epochs=2, seed=7)


@query
def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the texts' bytes as 8-bit samples; every 50th id is searched among all rows."""
    media = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("media"))
    return chroma.search(media, F.col("id") % 50 == 0)


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out("doc_id")))
    return language.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeats(read(spark, sf_dir, "documents"), most_removed=lines.EVERY_LINE)
    return kept.select("doc_id", "n_lines", "n_repeated", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digests(read(spark, sf_dir, "documents"))


@query
def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(read(spark, sf_dir, "conversations"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.shared_prefixes(read(spark, sf_dir, "conversations"))


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(read(spark, sf_dir, "documents"))


ORACLES["op10_token_counts"] = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS BIGINT) AS n_tokens FROM documents"""
