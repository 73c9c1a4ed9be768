"""Decisions by estimated table size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan, the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def in_pieces(df: DataFrame, source: DataFrame, piece_bytes: int, *by: str) -> DataFrame:
    """The same rows in a part for about every `piece_bytes` of the files that `source` reads.  For rows that
    become many times larger, or dear to compute: neither a file read whole nor shuffled rows that fit
    together while they are small then make one task of them.  Rows of one piece stay as they are."""
    parts = math.ceil(estimated_bytes(source) / piece_bytes)
    return df.repartition(parts, *by) if parts > 1 else df
