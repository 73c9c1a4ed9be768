"""Prefix trie of conversations in balanced parentheses, built in shards.

A conversation is the sequence of its turns, each an MD5 of role and text; a node of the trie is a
distinct beginning.  Conversations are sorted by their sequences, so that a shard (a range of them) holds
a piece of the trie in preorder.  The shard writes it as balanced parentheses, one pair a node:

* blocks of the running excess keep their minimum and maximum, and a binary tree over them the minimum
  and maximum of every range: `close` finds where the excess first falls below an opening one, which
  delimits the subtree;
* the rank of `()` counts the leaves between the two;
* sums over the preorder (members, savings) give every subtree as a difference of two.

The nodes on the paths of a shard's first and last sequence, its spines, may also lie in other shards.
For them a shard states what hangs on each beside the spine; the rest of its nodes are final.  The spines
of neighbouring shards are merged by node in the same way, `FAN` shards at a time, until one task holds
what is left, which is a few nodes a shard.

The turns of one conversation are held in one row (about 24 bytes a turn, no texts).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise
from .common import pieces

WIDTH = 16  # bytes of a turn's digest
SHARD_BYTES = 512 << 20  # of the table; its digests are a twentieth or so
FAN = 1000
EXCESS_BLOCK = 64
NOBODY = np.iinfo(np.int64).max
REPEATED = 5  # conversations begin like the one whose id is the next lower multiple
MOST_SHARED = 8


# ---- balanced parentheses ----------------------------------------------------------------------------

class Parentheses:
    """The trie whose nodes in preorder have the given depths, the root 0 first."""

    def __init__(self, depth: np.ndarray) -> None:
        n = len(depth)
        self.open = 2 * np.arange(n) - depth  # before node i stand i openings and i - depth closings
        bits = np.zeros(2 * n, np.int8)
        bits[self.open] = 1
        self.leaf = np.zeros(2 * n, bool)
        self.leaf[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-2 * n // EXCESS_BLOCK)
        self.half = 1 << max(blocks - 1, 0).bit_length()
        pad = blocks * EXCESS_BLOCK - 2 * n
        table = np.pad(self.excess, (0, pad), mode="edge").reshape(blocks, EXCESS_BLOCK)
        self.low, self.high = np.full(2 * self.half, NOBODY), np.full(2 * self.half, -1)
        self.low[self.half:self.half + blocks], self.high[self.half:self.half + blocks] = table.min(axis=1), table.max(axis=1)
        level = self.half
        while level > 1:
            pairs, level = slice(level, 2 * level), level // 2
            self.low[level:2 * level] = self.low[pairs].reshape(-1, 2).min(axis=1)
            self.high[level:2 * level] = self.high[pairs].reshape(-1, 2).max(axis=1)
        self.close = self._close()

    def _holds(self, range_: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.low[range_] <= target) & (target <= self.high[range_])

    def _scan(self, start: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from `start` to before `stop` where the excess is `target`, or -1."""
        out, todo = np.full(len(start), -1), np.arange(len(start))
        at = start.copy()
        while len(todo := todo[at[todo] < stop[todo]]):
            hit = self.excess[at[todo]] == target[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
        return out

    def _close(self) -> np.ndarray:
        """The closing place of every node: in its own block, or in the first later one that holds it."""
        target, total = self.excess[self.open] - 1, len(self.excess)
        block = self.open // EXCESS_BLOCK
        out = self._scan(self.open + 1, np.minimum((block + 1) * EXCESS_BLOCK, total), target)
        far = np.flatnonzero(out < 0)
        at = block[far] + 1 + self.half
        at //= at & -at  # the largest range that begins there
        todo = np.flatnonzero(~self._holds(at, target[far]))
        while len(todo):
            at[todo] += 1
            at[todo] //= at[todo] & -at[todo]
            todo = todo[~self._holds(at[todo], target[far[todo]])]
        while len(todo := np.flatnonzero(at < self.half)):
            left = 2 * at[todo]
            at[todo] = np.where(self._holds(left, target[far[todo]]), left, left + 1)
        first = (at - self.half) * EXCESS_BLOCK
        out[far] = self._scan(first, np.minimum(first + EXCESS_BLOCK, total), target[far])
        return out

    def after(self) -> np.ndarray:
        """Preorder number behind the subtree of each node."""
        return np.arange(len(self.open)) + (self.close - self.open + 1) // 2

    def leaves(self, counted: np.ndarray) -> np.ndarray:
        """Leaves in the subtree of each node, among the counted nodes."""
        here = self.leaf.copy()
        here[self.open[~counted]] = False
        rank = np.concatenate(([0], np.cumsum(here)))
        return rank[self.close + 1] - rank[self.open]


# ---- pieces of the trie ------------------------------------------------------------------------------

@dataclass
class Piece:
    """Nodes in preorder.  `members`, `least`, `leaves`, `saved` and `children` are what hangs on a node
    beside the nodes of this piece (for a new node: the conversations that end there, and nothing)."""

    depth: list[int]
    size: list[int]
    ends: list[bytes | None]
    members: list[int]
    least: list[int]
    leaves: list[int]
    saved: list[int]
    children: list[int]
    parent: list[int]
    name: dict[int, bytes]  # of nodes on a spine


def piece_of(rows: Iterator[tuple[bytes, list[int], int, int, bytes]]) -> Piece | None:
    """Nodes of sorted distinct sequences (key, sizes, members, least, digest of members)."""
    out = Piece([0], [0], [None], [0], [NOBODY], [0], [0], [0], [-1], {})
    path, before, spines = [0], None, []
    for key, sizes, members, least, ends in rows:
        shared = 0
        if before is not None:
            top = min(len(before), len(key))
            while shared * WIDTH < top and before[shared * WIDTH:(shared + 1) * WIDTH] == key[shared * WIDTH:(shared + 1) * WIDTH]:
                shared += 1
        del path[shared + 1:]
        for d in range(shared, len(sizes)):
            out.parent.append(path[-1])
            path.append(len(out.depth))
            out.depth.append(d + 1)
            out.size.append(sizes[d])
            out.ends.append(None)
            out.members.append(0)
            out.least.append(NOBODY)
            for hangs in (out.leaves, out.saved, out.children):
                hangs.append(0)
        out.members[path[-1]], out.least[path[-1]], out.ends[path[-1]] = members, least, ends
        if before is None:
            spines.append((list(path), key))
        before = key
    if before is None:
        return None
    for nodes, key in (*spines, (path, before)):
        name = bytes(WIDTH)
        for d, node in enumerate(nodes):
            if d:
                name = xxhash.xxh3_128_digest(name + key[(d - 1) * WIDTH:d * WIDTH])
            out.name[node] = name
    return out


def merged(rows: Iterator[dict]) -> tuple[Piece, list[int]] | None:
    """Spine nodes of successive shards, equal ones added up; and the nodes of the first and last shard."""
    out, at, path, first, last, shard = Piece([], [], [], [], [], [], [], [], [], {}), {}, [], [], [], None
    for r in rows:
        if shard != r["shard"]:
            shard, last = r["shard"], []
        node = at.get(r["name"])
        if node is None:
            node = at[r["name"]] = len(out.depth)
            out.name[node] = r["name"]
            for values, v in ((out.depth, r["depth"]), (out.size, r["size"]), (out.ends, r["ends"]), (out.members, r["members"]), (out.least, r["least"]),
                              (out.leaves, r["leaves"]), (out.saved, r["saved"]), (out.children, r["children"])):
                values.append(v)
            out.parent.append(path[r["depth"] - 1] if r["depth"] else -1)
        else:
            out.members[node] += r["members"]
            out.least[node] = min(out.least[node], r["least"])
            out.leaves[node] += r["leaves"]
            out.saved[node] += r["saved"]
            out.children[node] += r["children"]
            out.ends[node] = out.ends[node] or r["ends"]
        del path[r["depth"]:]
        path.append(node)
        last.append(node)
        if not first or first[0][0] == shard:
            first.append((shard, node))
    return (out, [*(n for _, n in first), *last]) if shard is not None else None


NOTHING = hashlib.sha256(b"").hexdigest()
FINAL = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
         ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
SPINE = [("shard", pa.int64()), ("place", pa.int64()), ("name", pa.binary()), ("size", pa.int64()), ("ends", pa.binary()), ("members", pa.int64()), ("least", pa.int64()),
         ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64())]
OUT = pa.schema([*FINAL, ("parent_name", pa.binary()), *SPINE, ("final", pa.bool_())])
OUT_TYPE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_name binary, "
            "shard long, place long, name binary, size long, ends binary, members long, least long, leaves long, saved long, children long, final boolean")


def solved(piece: Piece, spine_nodes: list[int], shard: int) -> pa.RecordBatch:
    """Rows of `OUT`: final ones for the nodes off the spine, what hangs on them for the others."""
    n = len(piece.depth)
    depth, parent, size, members, leaves, saved, children = (np.array(x, np.int64) for x in (
        piece.depth, piece.parent, piece.size, piece.members, piece.leaves, piece.saved, piece.children))
    spine = np.zeros(n, bool)
    spine[spine_nodes] = True
    tree = Parentheses(depth)
    after = tree.after()

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[after] - sums[:n]

    def beside(values: np.ndarray) -> np.ndarray:
        """Without the children on the spine."""
        out = values.copy()
        np.subtract.at(out, parent[1:][spine[1:]], values[1:][spine[1:]])
        return out

    convs = below(members)
    kids = children + np.bincount(parent[1:], minlength=n)
    all_leaves = tree.leaves((children == 0) & ~spine) + below(leaves)
    all_saved = below(np.where(spine | (depth == 0), 0, (convs - 1) * size) + saved)
    least = piece.least
    for i in range(n - 1, 0, -1):
        if not spine[i] and least[i] < least[p := piece.parent[i]]:
            least[p] = least[i]
    least = np.array(least, np.int64)
    root = parent < 0
    known = ~root & ~spine[parent]  # the parent's least member is final too
    off = ~spine
    named = np.array([piece.name.get(i) for i in range(n)], object)
    ends = np.array([e.hex() if e else NOTHING for e in piece.ends], object)

    def column(kind: pa.DataType, values: np.ndarray, valid: np.ndarray) -> pa.Array:
        return pa.array(values, kind, mask=~valid)

    hang_children = children + np.bincount(parent[1:][off[1:]], minlength=n)
    columns = {
        "conv_id": (least, off), "depth": (depth, ~np.zeros(n, bool)), "parent_conv_id": (least[parent], off & known), "n_convs": (convs, off),
        "n_children": (kids, off), "n_leaves": (all_leaves, off), "saved_tokens": (all_saved, off), "ends_sha256": (ends, off),
        "parent_name": (named[parent], off & ~known & ~root), "shard": (np.full(n, shard), spine), "place": (np.arange(n), spine),
        "name": (named, np.array([i in piece.name for i in range(n)])), "size": (size, spine),
        "ends": (np.array(piece.ends, object), spine & np.array([e is not None for e in piece.ends])), "members": (beside(convs), spine), "least": (least, spine),
        "leaves": (beside(all_leaves), spine), "saved": (beside(all_saved), spine), "children": (hang_children, spine), "final": (off, ~np.zeros(n, bool))}
    return pa.RecordBatch.from_arrays([column(f.type, *columns[f.name]) for f in OUT], schema=OUT)


# ---- Spark -------------------------------------------------------------------------------------------

def turns_of(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turns) of each id that is not null: an array of (digest, size) by turn, null first; of equal
    turns by role, then by digest.  Null roles and texts are empty."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.col(f"`{turn_col}`").cast("long")
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("id"), turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"),
                                digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("id IS NOT NULL")
    packed = F.array_sort(F.collect_list(F.struct("known", "turn", "role", "digest", "size")))
    return rows.groupBy("id").agg(packed.alias("all")).select("id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(id, turns): the first h turns of the conversation id - id % 5, h being the id's crc32 modulo 9,
    then its own after its first h.  A remainder has the sign of the id."""
    shared = (F.crc32(F.col("id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    first = turns.where(F.col("id") % REPEATED == 0).select(F.col("id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("first"))
    own = turns.withColumn("of", F.col("id") - F.col("id") % REPEATED)
    begin = F.when(F.col("first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("first", F.lit(1), shared))
    return own.join(first, F.col("of") == F.col("base"), "left").select("id", F.concat(begin, F.slice("turns", shared + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def distinct_sequences(sequences: DataFrame, parts: int) -> DataFrame:
    """(key, sizes, members, least, ends) of each distinct sequence; `ends` is the SHA-256 of the ids that
    have it, which are read in order, one at a time."""
    fields = pa.schema([("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("members", pa.int64()), ("least", pa.int64()), ("ends", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, i, s) for b in batches for k, i, s in zip(*(b.column(c).to_pylist() for c in ("key", "id", "sizes")), strict=True))

        def found() -> Iterator[dict]:
            for key, group in itertools.groupby(rows, key=lambda r: r[0]):
                _, least, sizes = next(group)
                sha, members = hashlib.sha256(str(least).encode()), 1
                for _, i, _ in group:
                    sha.update(f",{i}".encode())
                    members += 1
                yield {"key": key, "sizes": sizes, "members": members, "least": least, "ends": sha.digest()}

        several = found()
        while some := list(itertools.islice(several, 2000)):
            yield pa.RecordBatch.from_pylist(some, fields)

    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    keyed = sequences.select("id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    return (keyed.repartition(parts, "key").sortWithinPartitions("key", "id")
            .mapInArrow(run, "key binary, sizes array<long>, members long, least long, ends binary"))


def trie(sequences: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each
    node over the sequences (id, turns)."""
    distinct = materialise(distinct_sequences(sequences, parts))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None

        def rows() -> Iterator[tuple]:
            nonlocal shard
            for b in batches:
                if b.num_rows:
                    shard = b.column("shard")[0].as_py()
                yield from zip(*(b.column(c).to_pylist() for c in ("key", "sizes", "members", "least", "ends")), strict=True)

        piece = piece_of(rows())
        if piece is not None:
            yield solved(piece, list(piece.name), shard)

    def merge(final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = itertools.groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["shard"] // fan)
            for number, rows in group:
                piece, ends = merged(rows)
                yield solved(piece, [] if final else ends, number)
        return run

    ordered = distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("shard", F.spark_partition_id().cast("long"))
    done = materialise(ordered.mapInArrow(build, OUT_TYPE))
    found, shards = done.where("final"), parts
    while True:
        last = shards <= fan
        spines = done.where("NOT final").select("depth", *(n for n, _ in SPINE))
        groups = spines.withColumn("to", F.floor(F.col("shard") / fan)).repartition(-(-shards // fan), "to").sortWithinPartitions("shard", "place")
        done = materialise(groups.drop("to").mapInArrow(merge(last), OUT_TYPE))
        found, shards = found.unionByName(done.where("final")), -(-shards // fan)
        if last:
            break
    names = found.where("name IS NOT NULL").select(F.col("name").alias("of"), F.col("conv_id").alias("named"))
    out = [F.coalesce("parent_conv_id", "named").alias(c) if c == "parent_conv_id" else F.col(c) for c, _ in FINAL]
    return found.join(names, F.col("parent_name") == F.col("of"), "left").select(*out)


def shared_prefixes(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all conversations, rebuilt from each other's beginnings (`rebuilt`).

    Rows with a null id belong to no conversation.  Repeated rows are turns each.  A conversation that has
    no turn left is a member of the root.  Columns other than the four named ones play no part.  An empty
    table gives no node.
    """
    turns = materialise(turns_of(conversations, id_col, turn_col, role_col, text_col))
    return trie(rebuilt(turns), pieces(conversations, SHARD_BYTES))
