"""Bloom filters of a fixed size: what they let through is checked again by an exact join."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # 64-bit words: 8 MB, however many members there are
BITS = 64 * WORDS
PROBES = 2


def filter_of(places: DataFrame) -> Broadcast:
    """Filter with the given places (column `p`, below `BITS`).  At most `WORDS` rows come to the driver."""
    words = (places.groupBy(F.shiftright("p", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("bits"))).toArrow()
    table = np.zeros(WORDS, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return places.sparkSession.sparkContext.broadcast(table)


def bloom_of(members: DataFrame, value: Column) -> Broadcast:
    """Filter of the values of a column."""
    return filter_of(members.select(F.explode(F.array(*places_of(value))).alias("p")))


def mixed_places(values: np.ndarray) -> list[np.ndarray]:
    """Places of unsigned 64-bit integers, computed in tasks."""
    h = values * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return [(h >> np.uint64(s) & np.uint64(BITS - 1)).view(np.int64) for s in (0, 32)]


def places_of(value: Column) -> list[Column]:
    """The columns that `passes` needs, computed by Spark as in the filter."""
    return [F.pmod(F.xxhash64(F.lit(i), value), F.lit(BITS)) for i in range(PROBES)]


def passes(table: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(places[0]), bool)
    for p in places:
        out &= (table[p >> 6] >> (p & 63)) & 1 == 1
    return out
