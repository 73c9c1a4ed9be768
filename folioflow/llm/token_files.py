"""Token counts of flat token files by a separator scan.

A flat file is a run of 16-bit little-endian token ids; one id ends every document, nothing else marks
where documents begin.  A task searches a file block by block for the separator with one vectorised
comparison.  Each block reports how many separators it has and the tokens before its first one; lengths
between two separators of a block are final at once.  A prefix scan over the blocks of a file stitches
the rest: the sum of separators numbers the documents, the place of the last separator so far tells how
long the document is that a block's first separator ends, however many blocks it runs through.

`write_token_files` makes such files from texts with Spark's text writer, whose line end is then the
separator's two bytes; commits, retries and file systems are Spark's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import scratch_dir
from .common import pieces, slices

SEPARATOR = 0xFFFF
BLOCK_TOKENS = 1 << 18
FILE_BYTES = 16 << 20
SLICE_BYTES = 2 << 20


def word_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): a 16-bit id, its crc32 modulo the separator, for each word of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            tokens = []
            for text in part.column(text_col).to_pylist():
                words = (text or "").encode().split()
                tokens.append((np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % SEPARATOR).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(tokens, pa.binary())], ["id", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, tokens binary").withColumnRenamed("id", id_col)


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def write_token_files(tokens: DataFrame, path: str, buckets: int, id_col: str = "doc_id", separator: int = SEPARATOR) -> None:
    """One flat file for each bucket of ids, its documents in ascending order of id (null first)."""
    ends = separator.to_bytes(2, "little").decode("iso-8859-1")
    (tokens.select(bucket_of(id_col, buckets).alias("bucket"), id_col, F.coalesce("tokens", F.lit(b"")).alias("tokens"))
     .repartition(buckets, "bucket").sortWithinPartitions("bucket", id_col)
     .select(F.col("tokens").cast("string").alias("value"), "bucket")
     .write.partitionBy("bucket").option("lineSep", ends).option("encoding", "iso-8859-1").text(path))


def block_reports(data: np.ndarray, separator: int, block: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Of each block: its first token, its number of tokens, the places of its first and its last separator
    (-1: none), and the places of all of them."""
    for start in range(0, len(data), block):
        part = data[start:start + block]
        at = np.flatnonzero(part == separator) + start
        yield start, len(part), int(at[0]) if len(at) else -1, int(at[-1]) if len(at) else -1, at


def document_lengths(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, number, start, n_tokens, closed) of each document of the flat files below `path`.

    Documents are numbered from 0 in the order of the file; `start` is the place of the first token.  Two
    separators in a row make an empty document.  Tokens after the last separator are a document that is
    not `closed`; an empty file has none.  A file is one row of Spark's binary reader (at most 2 GB); a
    last odd byte is ignored.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["file", "begin", "size", "first", "last", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for name, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), "<u2", len(content.as_buffer()) // 2)
                for begin, size, first, last, at in block_reports(data, separator, block):
                    inner = pa.StructArray.from_arrays([pa.array(at[:-1] + 1, pa.int64()), pa.array(np.maximum(np.diff(at) - 1, 0), pa.int64())], ["start", "n_tokens"])
                    lists = pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (begin, size, first, last)), lists], names)

    blocks = files.mapInArrow(run, "file string, begin long, size long, first long, last long, inner array<struct<start: long, n_tokens: long>>")
    in_file = Window.partitionBy("file").orderBy("begin")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    found, end = F.col("first") >= 0, F.col("begin") + F.col("size")
    scanned = (blocks.withColumn("ends", F.when(found, F.size("inner") + 1).otherwise(0).cast("long"))
               .withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0)))
               .withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)  # where the open document began
               .withColumn("rest", F.greatest(F.col("last") + 1, F.col("open")))
               .withColumn("final", F.lead("begin").over(in_file).isNull()))

    def document(number: Column, start: Column, n: Column, closed: bool) -> Column:
        return F.struct(number.alias("number"), start.alias("start"), n.alias("n_tokens"), F.lit(closed).alias("closed"))

    head = F.when(found, document(F.col("number"), F.col("open"), F.col("first") - F.col("open"), True))
    inner = F.transform("inner", lambda x, i: document(F.col("number") + 1 + i, x["start"], x["n_tokens"], True))
    tail = F.when(F.col("final") & (end > F.col("rest")), document(F.col("number") + F.col("ends"), F.col("rest"), end - F.col("rest"), False))
    return scanned.select("file", F.explode(F.array_compact(F.concat(F.array(head), inner, F.array(tail)))).alias("d")).select("file", "d.*")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(id, file, start, n_tokens) of each row: the texts become flat files, a scan counts their tokens.

    The files hold no ids: a bucket's documents and its ids are both in ascending order, so the number of
    a document in its file finds its id.  Null, empty and blank texts have 0 tokens; rows with equal ids
    are counted one by one; an empty table gives none.
    """
    spark = docs.sparkSession
    buckets, path = pieces(docs, file_bytes), f"{scratch_dir(spark)}/flat"
    write_token_files(word_tokens(docs, id_col, text_col), path, buckets, id_col)
    lengths = document_lengths(spark, path).withColumn("bucket", F.regexp_extract("file", r"/bucket=(\d+)/", 1).cast("int"))
    ids = (docs.select(id_col, bucket_of(id_col, buckets).alias("bucket"))
           .withColumn("number", F.row_number().over(Window.partitionBy("bucket").orderBy(id_col)).cast("long") - 1))
    return (ids.join(lengths, ["bucket", "number"])
            .select(id_col, F.regexp_extract("file", r"[^/]*$", 0).alias("file"), "bucket", "start", "n_tokens"))
