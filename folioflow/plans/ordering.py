"""Ordered computations over groups of any size.

A plain window puts a whole group into one task.  These helpers cut each group into blocks along
its order, compute inside the blocks, and carry one summary row per block forward, so a group that
holds a third of the table still spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .checkpoints import materialise

KEY, BLOCK = "_key", "_block"


def block_of(order: Column | str, size: int) -> Column:
    """Block number of an integer order column; each block spans `size` consecutive values."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(size))


def _keyed(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Rows with their key and their block inside it, as structs: a struct equals another one also
    where fields are NULL, so NULL keys and NULL blocks (which come first) are kept by every join."""
    return df.withColumn(KEY, F.struct(*keys)).withColumn(BLOCK, F.struct(KEY, block.alias("block")))


def _earlier_blocks() -> WindowSpec:
    return Window.partitionBy(f"{BLOCK}.{KEY}").orderBy(f"{BLOCK}.block").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], order: list, out: str, block: Column) -> DataFrame:
    """Add the 1-based position inside `keys`.  `block` must not decrease along `order`; NULL keys are
    one group, NULL orders come first.  The rows are read twice, the second time for keys and blocks
    alone: materialise a `df` that is dear to compute."""
    rows = _keyed(df, keys, block)
    counts = rows.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(BLOCK, F.coalesce(F.sum("_n").over(_earlier_blocks()), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(BLOCK).orderBy(*order)
    return (rows.join(starts, BLOCK)
            .withColumn(out, (F.col("_start") + F.row_number().over(inside)).cast("bigint"))
            .drop(KEY, BLOCK, "_start"))


def number_rows_any(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """`number_rows` for orders without integer blocks: range-partition once, fix the partitions
    with a reliable checkpoint, and use the partition number as the block."""
    ordered = materialise(df.repartitionByRange(*[F.col(k) for k in keys], *order))
    return number_rows(ordered, keys, order, out, F.spark_partition_id())


def running(df: DataFrame, keys: list[str], order: str, block: Column,
            **outs: tuple[str, Column]) -> DataFrame:
    """Inclusive running values along `order`, NULLs of `keys` and `order` as in `number_rows`.

    Each output is `name=(kind, column)` with kind `last` (last non-null), `sum` or `max`.
    """
    rows = _keyed(df, keys, block).withColumns({f"_v_{n}": c for n, (_, c) in outs.items()})
    total = {
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(order))),
        "sum": F.sum, "max": F.max,
    }
    over = {
        "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
        "sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w),
    }
    sums = rows.groupBy(BLOCK).agg(*[total[k](F.col(f"_v_{n}")).alias(f"_t_{n}") for n, (k, _) in outs.items()])
    carry = sums.select(BLOCK, *[over[k](F.col(f"_t_{n}"), _earlier_blocks()).alias(f"_c_{n}") for n, (k, _) in outs.items()])
    inside = Window.partitionBy(BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, BLOCK)
    merge = {
        "last": lambda here, c: F.coalesce(here, c),
        "sum": lambda here, c: F.coalesce(here, F.lit(0)) + F.coalesce(c, F.lit(0)),
        "max": lambda here, c: F.greatest(here, c),
    }
    return (joined.withColumns({n: merge[k](over[k](F.col(f"_v_{n}"), inside), F.col(f"_c_{n}"))
                                for n, (k, _) in outs.items()})
            .drop(KEY, BLOCK, *[f"_v_{n}" for n in outs], *[f"_c_{n}" for n in outs]))


def with_lookback(df: DataFrame, at: Column, block: int, lookback: int) -> DataFrame:
    """Give each row its block along the numeric `at`, and repeat rows within `lookback` of the
    block end as context of the next block.  Windows partitioned by the block then see everything
    they need; keep only rows with `_context` false afterwards."""
    if lookback > block:
        raise ValueError("lookback must not exceed the block length")
    b = F.floor(at / F.lit(block)).cast("bigint")
    near_end = at >= (b + 1) * F.lit(block) - F.lit(lookback)
    copies = F.when(near_end, F.array(b, b + 1)).otherwise(F.array(b))
    return (df.withColumn("_own", b).withColumn(BLOCK, F.explode(copies))
            .withColumn("_context", F.col(BLOCK) != F.col("_own")).drop("_own"))


def join_text(df: DataFrame, keys: list[str], order: str, text: str, sep: str, part: Column,
              out: str = "body") -> DataFrame:
    """Concatenate text along `order` into one row per (keys, part).  `part` bounds how much one
    row holds; joining the parts of a key in order with `sep` gives the whole text."""
    rows = df.select(*keys, part.alias("part"), F.col(order).alias("_o"), F.col(text).alias("_t"))
    packed = F.array_sort(F.collect_list(F.struct("_o", "_t")))
    return (rows.groupBy(*keys, "part").agg(packed.alias("_l"))
            .select(*keys, "part", F.array_join(F.transform("_l", lambda s: s["_t"]), sep).alias(out)))


def with_previous(df: DataFrame, keys: list[str], order: str, block: Column, **outs: str) -> DataFrame:
    """Values of the row before along `order`, as `name=column`; NULL on the first row of a key."""
    rows = _keyed(df, keys, block)
    packed = F.struct(*[F.col(c).alias(n) for n, c in outs.items()])
    ends = rows.groupBy(BLOCK).agg(F.max_by(packed, F.struct(order)).alias("_e"))
    prior = Window.partitionBy(f"{BLOCK}.{KEY}").orderBy(f"{BLOCK}.block")
    carry = ends.select(BLOCK, F.lag("_e").over(prior).alias("_e"))
    inside = Window.partitionBy(BLOCK).orderBy(order)
    return (rows.join(carry, BLOCK)
            .withColumn("_p", F.coalesce(F.lag(packed).over(inside), F.col("_e")))
            .withColumns({n: F.col(f"_p.{n}") for n in outs})
            .drop(KEY, BLOCK, "_e", "_p"))
