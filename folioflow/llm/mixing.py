"""Mixing sources to target weights over a tree of domains, languages and sources.

Budgets.  Every node of the tree has a weight among its siblings.  From the root down a node's tokens are
split over its children by weight, each child held between what `least_epochs` and `most_epochs` of its
own supply come to.  What a child cannot take goes to its siblings by their weights; only what all of
them together cannot take was already left with the node's own siblings when its ancestor was split, for
a node's limits are the sums of its leaves'.  Tokens are whole numbers; remainders go to the largest
fractions, then by name.

Selection.  A leaf runs through seeded epochs: epoch k is all its rows in the order of a hash of seed, k
and id.  It takes whole epochs and then the prefix of one more that fills its budget; the last row of
the prefix counts only in part.  The prefix is found from sums over hash buckets; rows are ordered only
inside the one bucket of each leaf where the budget ends, so a leaf with a third of all rows needs no
sort of its own.

The tree, one row for each leaf, is what returns to the driver; it grows with the number of sources, not
with the documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise

BUCKETS = 1 << 12


def words_in(text_col: str) -> Column:
    """Tokens as words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")


def split_budget(budget: int, weights: list[float], least: list[int], most: list[int]) -> list[int]:
    """Shares of a budget by weight, each between its limits; their sum is the budget if the limits allow
    it, else the nearest sum they allow.

    All shares are level x weight, cut to their limits, for one level; it lies between two of the levels
    where a share meets a limit, and there the sum is linear.  Children of weight 0 take more than their
    least only when all others are full.
    """
    budget = min(max(budget, sum(least)), sum(most))
    if 0 in weights and any(weights):
        bare = [i for i, w in enumerate(weights) if not w]
        rest = [i for i, w in enumerate(weights) if w]
        held = max(sum(least[i] for i in bare), budget - sum(most[i] for i in rest))
        out = [0] * len(weights)
        for group, part in ((bare, held), (rest, budget - held)):
            for i, share in zip(group, split_budget(part, [weights[i] or 1.0 for i in group], [least[i] for i in group], [most[i] for i in group]), strict=True):
                out[i] = share
        return out
    weights = weights if any(weights) else [1.0] * len(weights)

    def at(level: float) -> list[float]:
        return [min(max(level * w, lo), hi) for w, lo, hi in zip(weights, least, most, strict=True)]

    knees = sorted({x / w for w, lo, hi in zip(weights, least, most, strict=True) for x in (lo, hi)} | {0.0})
    low, high = 0, len(knees) - 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(at(knees[mid])) <= budget else (low, mid)
    a, b = sum(at(knees[low])), sum(at(knees[high]))
    exact = at(knees[high] if b <= budget else knees[low] + (knees[high] - knees[low]) * max(budget - a, 0) / (b - a))
    out = [min(max(int(x), lo), hi) for x, lo, hi in zip(exact, least, most, strict=True)]
    by_fraction = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    while (missing := budget - sum(out)) > 0:
        for i in [i for i in by_fraction if out[i] < most[i]][:missing]:
            out[i] += 1
    return out


def leaf_budgets(supply: Mapping[tuple, int], weight: Mapping[tuple, float], total: int, least_epochs: float, most_epochs: float) -> dict[tuple, int]:
    """Tokens for each leaf.  `weight` has the weights of nodes by their path (1 where absent)."""
    least = {leaf: int(n * least_epochs) for leaf, n in supply.items()}
    most = {leaf: int(n * most_epochs) for leaf, n in supply.items()}
    depth = len(next(iter(supply), ()))
    out: dict[tuple, int] = {}

    def walk(path: tuple, budget: int, leaves: list[tuple]) -> None:
        if len(path) == depth:
            out[path] = budget
            return
        children: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[:len(path) + 1], []).append(leaf)
        names = sorted(children, key=lambda p: tuple((x is not None, str(x)) for x in p))
        shares = split_budget(budget, [float(weight.get(c, 1.0)) for c in names],
                              [sum(least[x] for x in children[c]) for c in names], [sum(most[x] for x in children[c]) for c in names])
        for c, share in zip(names, shares, strict=True):
            walk(c, share, children[c])

    if supply:
        walk((), total, list(supply))
    return out


def mix(rows: DataFrame, levels: list[str], weight: Mapping[tuple, float], share_of_supply: float = 1.0, least_epochs: float = 0, most_epochs: float = 4,
        seed: int = 0, id_col: str = "doc_id", tokens_col: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """(id, levels, n_tokens, epoch, take_tokens): the rows that are taken, once for each epoch.

    The total is `share_of_supply` times all tokens.  Null levels are nodes of their own; rows without
    tokens belong to whole epochs and to a prefix that reaches them; null counts are 0; rows with equal
    ids are taken one by one; an empty table gives none.
    """
    spark = rows.sparkSession
    light = materialise(rows.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"l{i}") for i, c in enumerate(levels)), F.coalesce(tokens_col, F.lit(0)).cast("long").alias("n_tokens")))
    keys = [f"l{i}" for i in range(len(levels))]
    stats = {tuple(r[k] for k in keys): r["n"] for r in light.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).collect()}
    targets = leaf_budgets(stats, weight, round(share_of_supply * sum(stats.values())), least_epochs, most_epochs)
    kinds = ", ".join(f"t{i} {light.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    # a leaf whose rows have no tokens costs nothing: it comes once where whole epochs are asked for
    plan = [(*leaf, *(divmod(t, stats[leaf]) if stats[leaf] else (int(least_epochs > 0), 0))) for leaf, t in targets.items()]
    leaves = spark.createDataFrame(plan, f"{kinds}, whole long, part long")
    same = [F.col(f"t{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("id").cast("string"))
    placed = light.join(F.broadcast(leaves), same).drop(*(f"t{i}" for i in range(len(keys)))).withColumn("h", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)))

    begun = placed.where("part > 0")
    sums = begun.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < part AND before + n >= part")
            .select(*(F.col(k).alias(f"t{i}") for i, k in enumerate(keys)), F.col("bucket").alias("last"), "before"))
    reached = begun.join(F.broadcast(last), same).where("bucket <= last")
    out = ["id", *keys, "n_tokens", "epoch", "take_tokens"]
    epochs = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("take_tokens", F.col("n_tokens")).select(out)
    inner = reached.where("bucket < last").withColumn("epoch", F.col("whole")).withColumn("take_tokens", F.col("n_tokens")).select(out)
    running = Window.partitionBy(*keys).orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = (reached.where("bucket = last").withColumn("so_far", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).where("so_far < part")
            .withColumn("epoch", F.col("whole")).withColumn("take_tokens", F.least("n_tokens", F.col("part") - F.col("so_far"))).select(out))
    return epochs.unionByName(inner).unionByName(edge).toDF(id_col, *levels, "n_tokens", "epoch", "take_tokens")
