"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import scratch_dir


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least one around it: the larger ones (large star), or the
    smaller ones and itself (small star).  Two min aggregations and a join by node; the minimum of a
    node with very many edges is combined before the shuffle."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge to another one.

    Alternates large and small stars until a round changes nothing; the number of rounds grows with the
    logarithm of the longest path.  Each round is written to the cluster's shared folder, so that lineage
    stays short and a lost executor costs one round.  An edge with a null end or a node with itself adds
    nothing.
    """
    spark = edges.sparkSession
    folder, turn = f"{scratch_dir(spark)}/{uuid.uuid4().hex}", 0
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        now.write.parquet(f"{folder}/{turn}")
        now = spark.read.parquet(f"{folder}/{turn}")
        # the edges as a set of pairs: a sum of hashes tells whether a round changed it
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = tuple(sign)
        now = _stars(_stars(now, True), False)
        turn += 1
