"""Repeated passages: every byte that lies in a string of `length` bytes occurring at two places.

Cutting.  Each window of `length` bytes has an anchor, the leftmost of its 64-byte strings with the
least hash.  Neighbouring windows with one anchor form a piece, about 170 windows long; equal windows
have their anchors at the same offset, so they lie in pieces of equal anchor hash.  Pieces whose anchor
hash occurs once end here, and pieces with equal contents count as one with a multiplicity.

Sorting.  The suffixes that begin at the anchors of the remaining distinct pieces, and the reversed
prefixes before them, are sorted by a deep-shallow sort: multikey quicksort on words of 8 bytes down to
a shallow depth, then a blind trie for each group that still agrees.  In this order the common lengths
of neighbours give for any two pieces of a group how far they agree to the right and to the left of
their anchors, which are the windows they share, exactly.

A group of more than `GROUP` distinct pieces (the ends of a passage that very many texts share) is not
gathered.  Its windows are dealt by their anchor's offset into strips; the windows of a strip have a core
in common, so pieces are grouped anew by strip and core.  Most cores are either unique or come with equal
contents; what remains large is cut into finer strips, down to single windows, whose groups have one
content.  No row is capped or dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import materialise
from .common import slices

LENGTH = 400
GRAM = 64
GROUP = 512
SHALLOW = 128
STRIPS = (48, 8, 1)
SLICE_BYTES = 1 << 20
CHUNK = 1 << 22  # windows of a long text that are anchored at once; positions have 24 bits
BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- anchors ---------------------------------------------------------------------------------------

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(BASE), -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (int(BASE), inverse)]
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each `gram` bytes."""
    up, down = _powers(max(len(data), SLICE_BYTES))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: minima from block starts and to block ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def pieces_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor and anchor hash of each piece of some texts in a row."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    h = gram_hashes(data, gram)
    keyed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    anchor = (window_minimum(keyed, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    at = np.arange(len(anchor))
    text = np.searchsorted(ends, at, side="right")
    inside = at + length <= ends[text]
    same = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~np.concatenate(([False], same)))
    last = np.flatnonzero(inside & ~np.concatenate((same, [False])))
    return first, last, anchor[first], h[anchor[first]]


def _rid(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def cut(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    """(id, rid, first, last, anchor, mini, c1, c2) of each piece: windows and anchor as byte offsets in the
    text, hash of the anchor, 128-bit hash of the piece's bytes.  A row is known by its id and a hash."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            rid = part.column("rid").to_numpy()
            flat = b"".join(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            data = np.frombuffer(flat, np.uint8)
            for low in range(0, max(len(flat) - length + 1, 0), CHUNK):
                high = min(low + CHUNK + length - 1, len(flat))
                first, last, anchor, mini = pieces_of(data[low:high], np.minimum(np.maximum(ends - low, 0), high - low), length, gram)
                digests = b"".join(xxhash.xxh3_128_digest(flat[a:b]) for a, b in zip((first + low).tolist(), (last + low + length).tolist(), strict=True))
                c = np.frombuffer(digests, np.int64).reshape(-1, 2)
                text = np.searchsorted(ends, first + low, side="right")
                shift = low - (ends - sizes)[text]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(text)), *(pa.array(x) for x in (rid[text], first + shift, last + shift, anchor + shift, mini.view(np.int64), c[:, 0], c[:, 1]))],
                                                 ["id", "rid", "first", "last", "anchor", "mini", "c1", "c2"])

    return (docs.select(F.col(id_col).alias("id"), _rid(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, rid long, first long, last long, anchor long, mini long, c1 long, c2 long"))


# ---- deep-shallow sort -----------------------------------------------------------------------------

def _common(a: bytes, b: bytes, low: int) -> int:
    """Common length of two strings that agree on their first `low` bytes."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie_order(strings: list[bytes], depth: int) -> list[int]:
    """Order of strings that agree on `depth` bytes.  A node holds the position where its strings part and
    a child for each byte there (-1: the end); inserting walks down blindly to some leaf, compares with
    it once, and adds a branch where they part."""
    root: list = [strings[0], [0]]  # leaf: its string, its members; inner node: position, children
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = node[0]
        n = _common(s, other, depth)
        if n == len(s) == len(other):
            node[1].append(k)
            continue
        node, above, edge = root, None, None
        while isinstance(node[1], dict) and node[0] < n:
            above, edge = node, s[node[0]]
            node = node[1][edge]
        mine = s[n] if n < len(s) else -1
        if isinstance(node[1], dict) and node[0] == n:
            node[1][mine] = [s, [k]]
            continue
        branch = [n, {mine: [s, [k]], other[n] if n < len(other) else -1: node}]
        if above is None:
            root = branch
        else:
            above[1][edge] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[1], dict):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node[1])
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> np.ndarray:
    """Indexes of the strings in lexicographic order.

    All groups are partitioned at once, each around the word of 8 bytes that its middle member has at
    the group's depth, into less, equal (8 bytes deeper) and greater, until a group has one member or
    agrees down to `shallow` bytes.
    """
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings) + bytes(shallow + 8), np.uint8)
    order, group, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while True:
        bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        count = np.diff(np.append(bounds, n))
        live = np.flatnonzero(np.repeat((count > 1) & (depth[bounds] < shallow), count))
        if not len(live):
            break
        own, deep = order[live], depth[live]
        offset = np.arange(8)
        bytes_ = data[(starts[own] + deep)[:, None] + offset]
        bytes_ = np.where(deep[:, None] + offset < sizes[own][:, None], bytes_, 0).astype(np.uint8)
        word = bytes_.view(">u8").ravel().astype(np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], group[live][1:] != group[live][:-1])))
        widths = np.diff(np.append(edges, len(live)))
        pivot = np.repeat(word[edges + widths // 2], widths)
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        key = np.repeat(np.arange(len(edges)), widths) * 3 + side
        turn = np.argsort(key, kind="stable")
        order[live], depth[live] = own[turn], (deep + 8 * (side == 1))[turn]
        fresh = np.zeros(n, np.int64)
        fresh[bounds] = 1  # old borders stay, those between the three sides come on top
        fresh[live[1:]] |= (np.diff(key[turn]) != 0) & (np.diff(live) == 1)
        fresh[live[edges]] = 1
        group = np.cumsum(fresh)
    for low, size in zip(bounds.tolist(), count.tolist(), strict=True):
        if size > 1:
            own = order[low:low + size]
            # zero padding cannot tell an end from zero bytes: such groups start over
            safe = min(int(depth[low]), int(sizes[own].min()))
            first = strings[own[0]][:safe]
            if any(strings[i][:safe] != first for i in own.tolist()):
                safe = 0
            order[low:low + size] = own[blind_trie_order([strings[i] for i in own.tolist()], safe)]
    return order


# ---- shared windows of a group ---------------------------------------------------------------------

def _agreement(near: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common length of any two strings of a group, from those of neighbours in sorted order."""
    n = len(order)
    out = np.zeros((n, n), np.int16)
    for i in range(n - 1):
        run = np.minimum.accumulate(near[i:])
        out[order[i], order[i + 1:]] = run
        out[order[i + 1:], order[i]] = run
    return out


def shared_windows(groups: np.ndarray, contents: list[bytes], anchors: list[int], length: int) -> list[tuple[int, int, int]]:
    """(member, low, high): windows low..high of a piece also occur in another piece of its group.

    `groups` numbers the members' groups, which stand together; anchors are offsets in the contents.
    """
    sides = [[c[a:] for c, a in zip(contents, anchors, strict=True)], [c[:a][::-1] for c, a in zip(contents, anchors, strict=True)]]
    places = []
    for side in sides:
        place = np.empty(len(side), np.int64)
        place[deep_shallow_order(side)] = np.arange(len(side))
        places.append(place)
    out = []
    bounds = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    for low, high in zip(bounds.tolist(), np.append(bounds[1:], len(groups)).tolist(), strict=True):
        n = high - low
        if n < 2:
            continue
        common = []
        for side, place in zip(sides, places, strict=True):
            order = np.argsort(place[low:high])
            own = [side[low + i] for i in order.tolist()]
            common.append(_agreement(np.array([_common(x, y, 0) for x, y in zip(own, own[1:], strict=False)], np.int16), order))
        right, left = common
        # the farthest reach to the right among pieces that agree at least so far to the left
        reach = np.full((n, length + 1), -1, np.int16)
        off = ~np.eye(n, dtype=bool)
        np.maximum.at(reach, (np.nonzero(off)[0], left[off]), right[off])
        reach = np.maximum.accumulate(reach[:, ::-1], axis=1)[:, ::-1]
        shared = reach + np.arange(length + 1) >= length
        for i in np.flatnonzero(shared.any(axis=1)).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], shared[i].view(np.int8), [0]))))
            a = anchors[low + i]
            out.extend((low + i, a - int(y) + 1, a - int(x)) for x, y in zip(edge[::2], edge[1::2], strict=True))
    return out


def sort_groups(pieces: DataFrame, length: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """(c1, c2, low, high) of the shared windows of pieces (mini, c1, c2, anchor, content).  A task reads
    its groups in order and sorts several at once; a group has at most `GROUP` pieces."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = shared_windows(rows["mini"].to_numpy(), rows["content"].tolist(), rows["anchor"].tolist(), length)
        who = [w for w, _, _ in found]
        return pd.DataFrame({"c1": rows["c1"].to_numpy()[who], "c2": rows["c2"].to_numpy()[who],
                             "low": np.array([x for _, x, _ in found], np.int64), "high": np.array([x for _, _, x in found], np.int64)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for part in parts:
            part = part.drop_duplicates(["mini", "c1", "c2"])  # repeated rows bring a piece again
            held.append(part)
            size += int(part["content"].map(len).sum())
            if size >= batch_bytes:
                rows = pd.concat(held, ignore_index=True).drop_duplicates(["mini", "c1", "c2"], ignore_index=True)
                whole = rows["mini"] != rows["mini"].iloc[-1]  # the last group may go on
                if whole.any():
                    yield solve(rows[whole].reset_index(drop=True))
                held = [rows[~whole].reset_index(drop=True)]
                size = int(held[0]["content"].map(len).sum())
        if held:
            yield solve(pd.concat(held, ignore_index=True).drop_duplicates(["mini", "c1", "c2"], ignore_index=True))

    return pieces.select("mini", "c1", "c2", "anchor", "content").repartition("mini").sortWithinPartitions("mini").mapInPandas(run, "c1 long, c2 long, low long, high long")


# ---- the operator ----------------------------------------------------------------------------------

def _joined(docs: DataFrame, per_text: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Rows (id, data, ...) with what is known of each text; a null id finds its own."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"), _rid(id_col, text_col).alias("rid"))
    other = per_text.withColumnsRenamed({"id": "own_id", "rid": "own_rid"})
    return texts.join(other, (F.col("rid") == F.col("own_rid")) & F.col("id").eqNullSafe(F.col("own_id")), how)


def _contents(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Adds `content`, the bytes of each wanted piece (id, rid, first, last)."""
    per_text = wanted.groupBy("id", "rid").agg(F.collect_list(F.struct("first", "last", "anchor", "mini", "c1", "c2")).alias("pieces"))
    return (_joined(docs, per_text, id_col, text_col, "inner").select("data", F.explode("pieces").alias("p"))
            .select("p.mini", "p.c1", "p.c2", (F.col("p.anchor") - F.col("p.first")).alias("anchor"),
                    F.substring(F.col("data"), (F.col("p.first") + 1).cast("int"), (F.col("p.last") - F.col("p.first") + length).cast("int")).alias("content")))


def _strips(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """(p1, p2, base, mini, c1, c2, anchor, content): for each piece (c1, c2) and strip of `width` anchor
    offsets the part that holds the strip's windows, with its first window in the piece, a hash of strip
    and core, and a hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[tuple] = []
            for c1, c2, mini, anchor, content in zip(*(part.column(x).to_pylist() for x in ("c1", "c2", "mini", "anchor", "content")), strict=True):
                least, most = anchor - (len(content) - length), anchor  # anchor offsets of its windows
                for strip in range(least // width, most // width + 1):
                    low, high = strip * width, strip * width + width - 1
                    first, last = anchor - min(high, most), anchor - max(low, least)
                    own = content[first:last + length]
                    mark = mini.to_bytes(8, "little", signed=True) + strip.to_bytes(4, "little")
                    core = np.frombuffer(xxhash.xxh3_64_digest(mark + content[anchor - low:anchor - high + length]), np.int64)
                    c = np.frombuffer(xxhash.xxh3_128_digest(mark + (anchor - first).to_bytes(4, "little") + own), np.int64)
                    out.append((c1, c2, first, int(core[0]), int(c[0]), int(c[1]), anchor - first, own))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "content" else pa.int64()) for n, x in zip(names, columns, strict=True)], names)

    names = ["p1", "p2", "base", "mini", "c1", "c2", "anchor", "content"]
    return (pieces.select("c1", "c2", "mini", "anchor", "content")
            .mapInArrow(run, "p1 long, p2 long, base long, mini long, c1 long, c2 long, anchor long, content binary"))


def _split_groups(pieces: DataFrame, length: int, group: int, widths: tuple[int, ...] = STRIPS) -> DataFrame:
    """(c1, c2, low, high) of the shared windows of pieces in groups too large to gather."""
    strips = materialise(_strips(pieces, length, widths[0]))
    counts = strips.groupBy("mini", "c1", "c2").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("mini").agg(F.count("*").alias("kinds"))
    marked = materialise(counts.join(kinds, "mini").where("n > 1 OR kinds > 1"))
    contents = strips.select("mini", "c1", "c2", "anchor", "content")
    size = strips.select("c1", "c2", (F.octet_length("content") - length).cast("long").alias("high")).distinct()
    whole = marked.where("n > 1").join(size, ["c1", "c2"]).select("c1", "c2", F.lit(0).cast("long").alias("low"), "high")
    few = marked.where((F.col("kinds") > 1) & (F.col("kinds") <= group)).select("mini", "c1", "c2")
    found = whole.unionByName(sort_groups(contents.join(few, ["mini", "c1", "c2"], "left_semi"), length))
    many = marked.where(F.col("kinds") > group).select("mini", "c1", "c2")
    if len(widths) > 1 and not many.isEmpty():
        large = contents.join(many, ["mini", "c1", "c2"], "left_semi").dropDuplicates(["mini", "c1", "c2"])
        found = found.unionByName(_split_groups(large, length, group, widths[1:]))
    return (strips.select("p1", "p2", "base", "c1", "c2").join(found, ["c1", "c2"])
            .select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, rid, spans): for each text with a repeated passage its ranges of bytes [low, high), not merged."""
    cuts = cut(docs, id_col, text_col, length, gram)
    # written first, so that the join reads plain shuffles and a hash that very many pieces share is split
    often = materialise(cuts.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini"))
    members = materialise(cuts.join(often, "mini", "left_semi"))
    distinct = members.groupBy("mini", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("id", "rid", "first", "last", "anchor")).alias("one"))
    sizes = distinct.groupBy("mini").agg(F.count("*").alias("kinds")).where("kinds > 1")
    distinct = materialise(distinct.join(sizes, "mini", "left").select("mini", "c1", "c2", "n", "kinds", "one.*"))
    sorted_ = distinct.where(F.col("kinds") <= group)
    found = sort_groups(_contents(docs, sorted_, id_col, text_col, length), length)
    counted = distinct.where(F.col("kinds") > group)
    if not counted.isEmpty():
        found = found.unionByName(_split_groups(_contents(docs, counted, id_col, text_col, length), length, group))
    whole = distinct.where("n > 1").select("c1", "c2", F.lit(0).cast("long").alias("low"), (F.col("last") - F.col("first")).alias("high"))
    ranges = found.unionByName(whole)
    return (members.join(ranges, ["c1", "c2"])
            .groupBy("id", "rid").agg(F.collect_set(F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + length).alias("high"))).alias("spans")))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    return _joined(docs, repeated_spans(docs, id_col, text_col, length, gram), id_col, text_col, "left").select("id", "data", "spans")


def _kept(data: bytes | None, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    data = data or b""
    merged: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or []):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    cuts = [0, *(x for span in merged for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), [tuple(x) for x in merged]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, kept, spans) of each row: the bytes that stay and the maximal removed ranges [low, high).

    Every occurrence goes, the first one too.  Null and empty texts, and texts shorter than `length`,
    stay as they are; passages never cross documents; of repeated rows each counts as a document; an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            done = [_kept(d, s) for d, s in zip(part.column("data").to_pylist(), part.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array([k for k, _ in done], pa.binary()),
                pa.array([[{"low": a, "high": b} for a, b in m] for _, m in done], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], ["id", "kept", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (_with_spans(docs, id_col, text_col, length, gram)
            .mapInArrow(run, f"id {kind}, kept binary, spans array<struct<low: long, high: long>>").withColumnRenamed("id", id_col))


RANGES = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed, removed_share) of each row, as
    `without_repeats` without the bytes: `removed` has the removed ranges [low, high), `removed_share` is
    their part of the bytes (0 for an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data = part.column("data").to_pylist()
            done = [_kept(d, s) for d, s in zip(data, part.column("spans").to_pylist(), strict=True)]
            sizes = [len(d or b"") for d in data]
            gone = [n - len(k) for n, (k, _) in zip(sizes, done, strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                pa.array([len(m) for _, m in done], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in done], pa.string()),
                pa.array([[{"low": a, "high": b} for a, b in m] for _, m in done], RANGES), pa.array([g / max(n, 1) for g, n in zip(gone, sizes, strict=True)], pa.float64())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "removed_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (_with_spans(docs, id_col, text_col, length, gram)
            .mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<low: long, high: long>>, removed_share double")
            .withColumnRenamed("id", id_col))
