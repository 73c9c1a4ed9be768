"""Exact Jaccard self-join of texts over their word n-grams by token-combination prefixes.

A text is the set of the XXH64 hashes (tokens) of its runs of `width` words, split as in `simhash`; equal
sets are one node.  Two sets of sizes n and m link if 100 * common >= percent * union, so at most
n - ceil(percent * n / 100) tokens of either are missing in the other.  All tokens have one order, rare
ones first.  A prefix is taken until the tokens in it, less those that may be shared without a shared
signature, outnumber the missing ones:

* rare tokens are signatures themselves, and each counts;
* frequent tokens are dealt to classes by their hash; all pairs inside a class are signatures, and a class
  counts one less than it has, so the prefix is extended accordingly.

Of two linked sets, take the one whose prefix ends first: had they no common signature, it would miss too
many.  The number of classes follows from the size, in bands that grow by 100 / percent: linked sets lie
in one band or in neighbouring ones, so a set with frequent tokens in its prefix writes signatures for its
own band and for the next.  Small sets take frequent tokens one by one.  The tokens of all texts are
counted; those beyond the `KNOWN` most frequent ones are rare.

Search.  A signature of several nodes is a block.  Its nodes are compared with its least one, then, where
a block still has several components, with its greatest one.  What is then still apart is gathered by
the least node of its blocks, in tiles of bounded size, and only nodes that pass a bound with any other
leave a tile: the parities of a set's tokens in some 2n buckets differ from those of another set in at
most as many places as the sets differ in tokens.  Texts are fetched through a filter of fixed size and an
exact join: those of the first two steps are each compared with the centre they are dealt to, where
centres with many candidates are split; those of the nodes that left a tile are compared in tiles again,
each giving only links that join what was apart in it.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise, scratch_dir
from .bloom import bloom_of, passes, places_of
from .common import pieces, slices
from .components import components
from .simhash import SEED, SLICE_BYTES, shingle_hashes

WIDTH, PERCENT = 5, 80
SAMPLE = 1  # texts to each counted one: all are counted
KNOWN = 1 << 17  # tokens whose frequency is kept
MANY = 64  # texts from which a token is frequent
SMALL = 25  # sets below take frequent tokens one by one
PER_CLASS = 20  # a class for so many tokens of a set
PER_CENTRE = 500
TILE = 1500  # nodes that are compared with each other or with as many others in one go
TILE_TOKENS = 1 << 20  # tokens of these nodes, but for a larger set
PIECE_BYTES = 4 << 20
COUNT_BYTES = 8 << 20  # text whose tokens are counted in one range


def token_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), SEED) - (1 << 63)


def missing(n: int, percent: int) -> int:
    """How many tokens of a set may be missing in one it links to."""
    return n - -(-percent * n // 100)


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least size of each band: sizes that may link lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out)


def class_count(size: int) -> int:
    """Classes of frequent tokens in a band that begins at `size`; 0: one by one."""
    return size // PER_CLASS if size >= SMALL else 0


def combined(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """One integer for each pair of tokens."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(band)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def pairs_inside(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    left, right, lag = [], [], 1
    while lag < len(tokens) and (same := classes[lag:] == classes[:-lag]).any():
        left.append(tokens[:-lag][same])
        right.append(tokens[lag:][same])
        lag += 1
    empty = tokens[:0]
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def signatures(tokens: np.ndarray, percent: int, starts: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Signatures of a set, as signed integers; `known` is ascending."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    need = missing(n, percent) + 1
    often = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        often = np.where(known[at] == tokens, times[at], 0)
    if often.any():
        order = np.argsort(often, kind="stable")
        tokens, often = tokens[order], often[order]
    rare = int(np.searchsorted(often, MANY))
    if rare >= need:
        return tokens[:need].view(np.int64)
    out, frequent, need = [tokens[:rare]], tokens[rare:], need - rare
    band = int(np.searchsorted(starts, n, side="right")) - 1
    for b in (band, band + 1):
        count = class_count(int(starts[b]))
        if not count:
            out.append(frequent[:need])
            continue
        classes = frequent >> np.uint64(20) & np.uint64(0xFFFFFFFF)
        classes %= np.uint64(count)
        gain = np.ones(len(frequent), np.int64)
        gain[np.unique(classes, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(gain), need)) + 1
        out.append(combined(*pairs_inside(frequent[:end], classes[:end]), b))
    return np.unique(np.concatenate(out)).view(np.int64)


def parities(tokens: np.ndarray) -> bytes:
    """Whether each of the buckets, a power of two not below twice the size of the set, holds an odd number."""
    buckets = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(buckets - 1)).view(np.int64), minlength=buckets) & 1, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets of sizes n and m that differ in too many tokens to link."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    size, other = 8 * len(x), 8 * len(y)
    if size < other:
        a, b, size, other = b, a, other, size
    while size > other:  # two buckets that become one are odd together if one of them was
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ b).bit_count() * (100 + percent) <= (n + m) * (100 - percent)


def near_pairs(sizes: np.ndarray, odd: list[bytes], apart: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may link by sizes and parities and differ in every column of `apart`."""
    order = np.argsort(sizes, kind="stable")
    sizes, apart = sizes[order], apart[order]
    words = [np.frombuffer(odd[i], "<u8") for i in order]
    width = np.array([len(w) for w in words])
    place = np.zeros(len(words), np.int64)
    own, folded = {}, {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        own[w] = np.stack([words[i] for i in at])
        folded[w] = own[w][:, :w // 2] ^ own[w][:, w // 2:]
    last = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    left, right = [], []
    for i in range(len(words)):
        rest = np.arange(i + 1, last[i])
        rest = rest[(apart[rest] != apart[i]).all(axis=1)]
        for table, w in ((own, width[i]), (folded, 2 * width[i])):  # a size a quarter larger has as many buckets or twice as many
            near = rest[width[rest] == w]
            if len(near):
                differ = np.bitwise_count(table[w][place[near]] ^ words[i]).sum(axis=1, dtype=np.int64)
                near = near[differ * (100 + percent) <= (sizes[i] + sizes[near]) * (100 - percent)]
                left.append(np.full(len(near), i))
                right.append(near)
    empty = np.zeros(0, np.int64)
    return order[np.concatenate(left or [empty])], order[np.concatenate(right or [empty])]


def joining_links(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that link and differ in `root` and `side`, without those whose ends `root` or links
    found before already join."""
    sizes, root = np.array([len(s) for s in sets]), root.copy()
    x, y = near_pairs(sizes, [parities(s) for s in sets], np.array([root, side]).T, percent)
    left, right = [], []
    for pairs in np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1):
        pairs = pairs[root[x[pairs]] != root[y[pairs]]]
        if not len(pairs):
            continue
        i, others = x[pairs[0]], y[pairs]
        own, tokens, n = sets[i], np.concatenate([sets[j] for j in others]), sizes[others]
        equal = own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens
        common = np.add.reduceat(equal, np.cumsum(n) - n, dtype=np.int64)
        for j in others[100 * common >= percent * (len(own) + n - common)]:
            if root[i] != root[j]:
                left.append(i)
                right.append(j)
                root[root == root[j]] = root[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def dealt(tokens: np.ndarray, times: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, tokens, times): ascending distinct tokens, cut into the parts of their range that have any."""
    cuts = np.searchsorted(tokens, np.array([i * ((1 << 64) // parts) for i in range(parts)], np.uint64)).tolist() + [len(tokens)]
    some = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
    blobs = [pa.array([x[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()) for x in (tokens, times.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *blobs], ["part", "tokens", "times"])


def added(tokens: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens with the sums of their times."""
    order = np.argsort(tokens)
    tokens = tokens[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    return tokens[starts], np.add.reduceat(times[order], starts, dtype=np.int64)


def frequencies(docs: DataFrame, width: int) -> Broadcast:
    """(tokens, times) of the `KNOWN` tokens that occur in the most texts, counted over all of them.  The
    tokens of some texts at a time are dealt by ranges, and each range is counted."""
    parts = pieces(docs, COUNT_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PIECE_BYTES):
            sets = [token_set(t, width) for t in part.column("text").to_pylist()]
            yield dealt(*np.unique(np.concatenate(sets), return_counts=True), parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("part", "tokens", "times")), strict=True))
        for _, same in itertools.groupby(rows, key=lambda r: r[0]):
            _, tokens, times = zip(*same, strict=True)
            tokens, times = added(np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(times), np.uint32))
            tokens, times = tokens[times > 1].view(np.int64), times[times > 1]
            most = np.lexsort((tokens, -times))[:KNOWN]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[most]), pa.array(times[most])], ["token", "times"])

    ranges = docs.select("text").mapInArrow(cut, "part long, tokens binary, times binary").repartition(parts, "part").sortWithinPartitions("part")
    seen = ranges.mapInArrow(count, "token long, times long").orderBy(F.desc("times"), "token").limit(KNOWN).toArrow()
    tokens, times = (seen.column(c).to_numpy() for c in ("token", "times"))
    order = np.argsort(tokens.view(np.uint64))
    return docs.sparkSession.sparkContext.broadcast((tokens.view(np.uint64)[order], times[order]))


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, code, node, n, odd, sigs) of each row, `odd` being its parities.  Of equal sets in one task only
    the first has signatures."""
    shared, starts = frequencies(docs, width), bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in slices(batches, "text", SLICE_BYTES):
            sets = [token_set(t, width) for t in part.column("text").to_pylist()]
            nodes = [node_of(s) for s in sets]
            sigs = []
            for node, s in zip(nodes, sets, strict=True):
                sigs.append(signatures(s, percent, starts, *shared.value) if node not in done else None)
                done.add(node)
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("code"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parities(s) for s in sets], pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["id", "code", "node", "n", "odd", "sigs"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, code long, node long, n long, odd binary, sigs array<long>")


def _filtered(df: DataFrame, table: Broadcast, hashed: list[str], schema: str) -> DataFrame:
    """Rows whose places (`hashed` columns) are all in the filter, without these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = passes(table.value, [part.column(c).to_numpy() for c in hashed])
            yield part.drop_columns(hashed).filter(pa.array(keep))

    return df.mapInArrow(run, schema)


class Search:
    """The tables of one join, each written once."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> None:
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.folder = f"{scratch_dir(self.spark)}/{uuid.uuid4().hex}"
        self.parts = pieces(docs, PIECE_BYTES)
        self.docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("code"), F.col(f"`{text_col}`").alias("text"))
        self.rows = self.table("rows", signed(self.docs, width, percent))
        one = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "code")).alias("one")  # a row with an id, if there is one
        nodes = self.rows.where("n > 0").groupBy("node").agg(one, F.first("n").alias("n"), F.first("odd").alias("odd"))
        self.nodes = self.table("nodes", nodes.withColumn("one", F.struct("one.id", "one.code")))
        self.members = self.table("members", self._members())

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """A large table of which not all columns are read each time; small ones are checkpoints."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _members(self) -> DataFrame:
        """(sig, node, low, high) of the signatures of several nodes."""
        sigs = self.rows.select("node", F.explode("sigs").alias("sig"))
        blocks = self.table("blocks", sigs.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"))
        first, second = places_of(F.col("sig"))
        met = _filtered(sigs.select("sig", "node", first.alias("p0"), second.alias("p1")), bloom_of(blocks, F.col("sig")), ["p0", "p1"], "sig long, node long")
        return met.join(blocks, "sig").distinct()

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(one, text) of the rows that stand for the `wanted` nodes, their texts compressed."""
        kind, table = self.docs.schema["id"].dataType.simpleString(), bloom_of(wanted, F.col("one.code"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor().compress
            for batch in batches:
                keep = passes(table.value, [batch.column(c).to_numpy() for c in ("p0", "p1")])
                part = batch.select(["id", "code", "text"]).filter(pa.array(keep))
                texts = pa.array([pack((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("code"), texts], ["id", "code", "text"])

        first, second = places_of(F.col("code"))
        small = self.docs.select("id", "code", "text", first.alias("p0"), second.alias("p1")).mapInArrow(run, f"id {kind}, code long, text binary")
        return small.select(F.struct("id", "code").alias("one"), "text").dropDuplicates(["one"])

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) whose sizes and parities allow a link."""
        x, y = (self.nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("odd").alias(o)) for c, n, o in (("a", "n", "x"), ("b", "m", "y")))
        fits = F.least("n", "m") * 100 >= self.percent * F.greatest("n", "m")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                keep = [may_link(*row, percent) for row in zip(*(part.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.distinct().join(x, "a").join(y, "b").where(fits).select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link; the texts of all b of an a are read beside that of a."""
        alike = materialise(self._alike(pairs))
        many = alike.groupBy("a").agg(F.ceil(F.count("*") / PER_CENTRE).alias("splits"))
        dealt = alike.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("splits")).alias("split"))
        want = (dealt.select("a", "split", F.lit(1).alias("role"), F.col("b").alias("node"))
                .unionByName(dealt.select("a", "split").distinct().select("a", "split", F.lit(0).alias("role"), F.col("a").alias("node"))))
        want = materialise(want.join(self.nodes.select("node", "one"), "node"))
        beside = want.join(self._texts(want), "one").repartition(self.parts, "a", "split").sortWithinPartitions("a", "split", "role", "node")
        width, percent = self.width, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, own, unpack = None, None, zstandard.ZstdDecompressor().decompress
            for part in batches:
                left, right = [], []
                for a, role, node, text in zip(*(part.column(c) for c in ("a", "role", "node", "text")), strict=True):
                    tokens = token_set(unpack(text.as_py()).decode(), width)
                    if role.as_py() == 0:
                        centre, own = a, tokens
                        continue
                    assert centre == a
                    common = len(np.intersect1d(own, tokens, assume_unique=True))
                    if 100 * common >= percent * (len(own) + len(tokens) - common):
                        left.append(a.as_py())
                        right.append(node.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        return materialise(beside.select("a", "role", "node", "text").mapInArrow(run, "a long, b long"))

    def roots(self, hints: DataFrame | None = None) -> DataFrame:
        """(node, root) of each node that links to another one.  `hints` are pairs (a, b) of ids that may
        link; those that do spare the search some comparisons."""
        pairs = self.members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
        if hints is not None:
            a, b = (self.rows.where("n > 0").select(F.col("id").alias(x), F.col("node").alias(f"node_{x}")).distinct() for x in "ab")
            hinted = hints.join(a, "a").join(b, "b").where("node_a <> node_b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
            pairs = pairs.unionByName(hinted)
        links = self.linked(pairs)
        found = components(links, "a", "b")
        apart = self._apart(found)
        top = apart.where("node = high").select("sig", F.col("root").alias("other"))
        more = self.linked(apart.where("node <> high").join(top, "sig").where("root <> other").select(F.col("high").alias("a"), F.col("node").alias("b")))
        links = links.unionByName(more)
        found = components(links, "a", "b")
        return components(links.unionByName(self._inside(self._apart(found))), "a", "b")

    def _tiled(self, near: DataFrame) -> DataFrame:
        """Rows (low, node, root, n) once for each tile (low, i, j) of theirs; `side` is theirs in a tile of two."""
        most = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_TOKENS))
        dealt = near.join(near.groupBy("low").agg(most.cast("int").alias("tiles")), "low").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return meets.select("low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(-1).alias("side"), "node", "root", "n")

    def _inside(self, apart: DataFrame) -> DataFrame:
        """Links (a, b) among the nodes of all blocks with one least node, enough to join what links there.

        A tile says first which of its nodes may link to any other, then, beside their texts, which do; a
        link is left out where others of its tile already join its ends.  So either step gives at most as
        many rows as it reads, however many pairs a group has."""
        near = materialise(apart.select("low", "node", "root").distinct().join(self.nodes.select("node", "n"), "node"))
        keys, percent, width = ["low", "i", "j"], self.percent, self.width

        def tiles(batches: Iterator[pa.RecordBatch], last: str) -> Iterator[tuple]:
            rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("low", "i", "j", "side", "node", "root", "n", last)), strict=True))
            for (low, i, j), tile in itertools.groupby(rows, key=lambda r: r[:3]):
                side, node, root, n, data = zip(*(r[3:] for r in tile), strict=True)
                # inside a tile of two sides, pairs of one side are left to another tile
                yield low, np.array(node, np.int64), np.array(root, np.int64), np.array(n), np.array(side if i < j else range(len(side))), data

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for low, node, root, n, side, odd in tiles(batches, "odd"):
                at = np.unique(np.concatenate(near_pairs(n, list(odd), np.array([root, side]).T, percent)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), low)), *(pa.array(x[at]) for x in (node, root, n))], ["low", "node", "root", "n"])

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for _, node, root, _, side, texts in tiles(batches, "text"):
                x, y = joining_links([token_set(unpack(t).decode(), width) for t in texts], root, side, percent)
                yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

        def beside(near: DataFrame, what: DataFrame, *on: str) -> DataFrame:
            return self._tiled(near).join(what, [*on]).repartition(self.parts, *keys).sortWithinPartitions(*keys, "side")

        shares = beside(near, self.nodes.select("node", "odd"), "node").select(*keys, "side", "node", "root", "n", "odd")
        near = materialise(shares.mapInArrow(some, "low long, node long, root long, n long").distinct())
        ones = materialise(near.select("node").distinct().join(self.nodes.select("node", "one"), "node"))
        texts = ones.join(self._texts(ones), "one").select("node", "text")
        return beside(near, texts, "node").select(*keys, "side", "node", "root", "n", "text").mapInArrow(links, "a long, b long")

    def _apart(self, found: DataFrame) -> DataFrame:
        """Members, with their component, of blocks that still have several."""
        roots = found.withColumnsRenamed({"node": "of", "root": "to"})
        named = self.members.join(roots, F.col("node") == F.col("of"), "left").select("sig", "node", "low", "high", F.coalesce("to", "node").alias("root"))
        several = named.groupBy("sig").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("sig")
        return named.join(several, "sig")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, hints: DataFrame | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the size of its set, and the least id reachable over links.

    A text of fewer words than `width` is one shingle; one without words, or null, has none and links to
    nothing, so its component is its own id.  Rows with equal ids are rows each.  A null id keeps its row
    and names a component only if that has no other.  Other columns play no part.  An empty table gives none.
    Pairs of ids that another search suggests (`hints`: a, b) are verified like all others.
    """
    search = Search(docs, id_col, text_col, width, percent)
    of = (search.nodes.join(search.roots(hints).withColumnsRenamed({"node": "of", "root": "to"}), F.col("node") == F.col("of"), "left")
          .select("node", "one", F.coalesce("to", "node").alias("root")))
    component = of.join(of.groupBy("root").agg(F.min("one.id").alias("component_id")), "root").select(F.col("node").alias("of"), "component_id")
    return (search.rows.select("id", "node", "n").join(component, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))
