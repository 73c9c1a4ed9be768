"""What several operators share: reading tables, the held-out split, batches in Arrow tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import release_finished  # noqa: F401
from ..plans.sizing import estimated_bytes

HELD_OUT = 2
UNKNOWN_SIZE = 1 << 60


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(id_col: str) -> Column:
    """True for rows kept back from learning: crc32 of the id as text leaves 2 modulo 4.  A null id
    is kept back."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(True))


def pieces(df: DataFrame, piece_bytes: int, least: int = 16) -> int:
    """How many parts of about `piece_bytes` the files below `df` make.  Where Spark knows no size (rows
    of an RDD or a checkpoint), as many as the session's shuffle partitions."""
    size = estimated_bytes(df)
    if size >= UNKNOWN_SIZE:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / piece_bytes))


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        start = filled = 0
        for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_pylist()):
            if i > start and filled + n > most:
                yield batch.slice(start, i - start)
                start, filled = i, 0
            filled += n
        if start < batch.num_rows:
            yield batch.slice(start)
