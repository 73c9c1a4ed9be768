"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

A fingerprint has 64 bits; bit i is 1 if it is set in more than half of the XXH64 hashes of a text's
word shingles.  Equal fingerprints are one node.  Two nodes are linked if at most `distance` (2) bits
differ.  The 64 bits are cut into 4 segments of 16: of two linked fingerprints at least 2 segments are
equal, so all links lie inside the blocks of the 6 pairs of segments.  A block with many distinct
fingerprints is split again in the same way over its remaining 32 bits, and that over its remaining
16 (exact at each level, so no block needs a cap: 56 bits are then equal and at most 256 nodes remain).

Inside a block every fingerprint has a row in a pivot table, its Hamming distances to many reference
fingerprints.  Distances differ by at most the distance of the two, so a pair whose coordinates differ
by more than 2 anywhere is discarded; survivors are verified.  Blocks are compared through a window
over the first pivot, coordinate by coordinate, and give a forest of their links, not all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise
from .common import slices
from .components import components

BITS, SEED = 64, 42
DISTANCE = 2
PIVOTS = 32
BLOCK = 2_000
SLICE_BYTES = 1 << 20


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of `width` words (fewer words: all of them; none: no hash)."""
    words = (text or "").encode().lower().split()  # ASCII case and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b - 1], SEED) for a, b in zip(starts, ends[width - 1:], strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprint of each list of hashes, as unsigned integers."""
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(n.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(n) - n)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of each row, fp as a signed long.  A null, empty or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            fp = majority([shingle_hashes(t, width) for t in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def pivots(count: int) -> np.ndarray:
    """The reference fingerprints: a fixed pseudo-random sequence."""
    return np.random.default_rng(SEED).integers(0, 2**64, count, np.uint64, endpoint=False)


def block_links(fp: np.ndarray, distance: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of a forest of the links among distinct fingerprints of one block."""
    refs = pivots(count)
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort(table.T[::-1])
    fp, table = fp[order], table[order]
    # all rows after a row whose first coordinate is within reach form one range
    reach = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    for i in range(len(fp)):
        near = np.arange(i + 1, reach[i])
        for step in range(1, count, 8):  # coordinates in strips: most pairs fall at the first one
            if not len(near):
                break
            near = near[np.abs(table[near, step:step + 8] - table[i, step:step + 8]).max(axis=1) <= distance]
        if len(near):
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
    return order[np.array(left, int)], order[np.array(right, int)]


def _blocks(nodes: DataFrame, level: int, distance: int) -> DataFrame:
    """One row for each node and choice of equal segments of the bits that are still open.

    `open` lists the nibbles (4-bit groups) not yet known to be equal; 16, 8 and 4 of them at the three
    levels are cut into 4 segments, and every choice of 4 - distance segments is a key.
    """
    size = [16, 8, 4][level] // 4
    choices = list(itertools.combinations(range(4), 4 - distance))
    picks = F.array(*(F.struct(
        F.array(*(F.col("open")[s * size + i] for s in c for i in range(size))).alias("fixed"),
        F.array(*(F.col("open")[s * size + i] for s in range(4) if s not in c for i in range(size))).alias("open")) for c in choices))
    part = F.aggregate("pick.fixed", F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(15).cast("long"), i * 4)))
    return (nodes.select("fp", "block", F.explode(picks).alias("pick"))
            .select("fp", F.col("pick.open").alias("open"), F.xxhash64("block", "pick.fixed", F.col("fp").bitwiseAND(part)).alias("block")))


def links(nodes: DataFrame, distance: int = DISTANCE, pivot_count: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b): links among the distinct values of `fp` that connect whatever `distance` connects."""
    if distance != 2:
        raise ValueError("the blocks are cut for two differing bits")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(part["fp"].to_numpy()).view(np.uint64)
        i, j = block_links(fp, distance, pivot_count)
        return pd.DataFrame({"a": fp[i].view(np.int64), "b": fp[j].view(np.int64)})

    keyed = _blocks(nodes.select("fp", F.lit(0).cast("long").alias("block"), F.array(*map(F.lit, range(16))).alias("open")), 0, distance)
    found = []
    for level in range(3):
        sizes = keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
        # a block of one node has no link; one of too many is split by the next level
        small = keyed.join(sizes.where(F.col("n") <= block) if level < 2 else sizes, "block")
        found.append(small.groupBy("block").applyInPandas(compare, "a long, b long"))
        if level == 2:
            break
        large = materialise(keyed.join(sizes.where(F.col("n") > block).select("block"), "block", "left_semi"))
        if large.isEmpty():
            break
        keyed = _blocks(large, level + 1, distance)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component_id) of each row: the least id whose fingerprint is reachable over links.

    Rows without words have fingerprint 0 and are linked by it like all others.  A null id keeps its row
    and is no component's name unless the component has no other.  Repeated rows stay.  An empty table
    gives none.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width))
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(links(nodes, distance), "a", "b")
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    # a fingerprint may belong to a third of all rows: their side is split, the other side has it once
    return prints.join(of, "fp", "left").select(id_col, "fp", "component_id")
