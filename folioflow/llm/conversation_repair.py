"""Repair of damaged conversations by generalised LR parsing with weighted edits.

The grammar of roles (`GRAMMAR`: nothing, or an optional system turn before pairs of user and assistant)
is turned into LR states.  A conversation is parsed with a graph-structured stack: a stack is a chain of
interned cells, so that stacks share what they have in common below, and stacks with equal tops merge by
the minimum of (cost, audit).  A turn may be kept, get another role (rerole) or be deleted, and turns may
be inserted before and after it; blank and duplicate turns can only be deleted.  Two audits of one position
and one cost are never a prefix of each other, since inserts cost something, so what is the least here
stays the least however the rest is edited.

Turns are ordered by (turn, null first); of equal turns by role, then by two hashes of the text.  Nulls in
role, text and, for the damage, in ids count as one space.  A null id is a conversation like any other.

Spark.  Turns are reduced to a few numbers, cut by range partitions and parsed block by block, each from
every stack it may start with; a block yields the cheapest edits from each such stack to each stack at
its end, and blocks are chained.  So one conversation may span any number of tasks.  Only the last step
follows a conversation through its text in order, row by row in constant memory but for the audit,
because a digest of the whole repaired text is asked for.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pieces

GRAMMAR = (("S", ""), ("S", "H"), ("H", "sL"), ("H", "L"), ("L", "LP"), ("L", "P"), ("P", "ua"))
ROLE = {"s": "system", "u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = "\\x20\\x09-\\x0D"
BLOCK = 2048
PIECE_BYTES = 8 << 20
Cost = tuple[int, str]


# ---- LR states ---------------------------------------------------------------------------------------

def lr_states(grammar: tuple) -> tuple[dict[tuple[int, str], int], list[list[tuple[str, int]]]]:
    """Transitions, and the complete rules (head, length) of each state."""
    heads = {h for h, _ in grammar}

    def closure(items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            nxt = grammar[rule][1][dot:dot + 1]
            new = {(i, 0) for i, (h, _) in enumerate(grammar) if h == nxt and nxt in heads} - items
            items |= new
            todo.extend(new)
        return frozenset(items)

    states, moves = [closure({(i, 0) for i, (h, _) in enumerate(grammar) if h == grammar[0][0]})], {}
    for number, items in enumerate(states):  # grows on the way
        for symbol in sorted({grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}):
            target = closure({(r, d + 1) for r, d in items if grammar[r][1][d:d + 1] == symbol})
            if target not in states:
                states.append(target)
            moves[number, symbol] = states.index(target)
    return moves, [[(grammar[r][0], d) for r, d in sorted(items) if d == len(grammar[r][1])] for items in states]


def _going_on(grammar: tuple) -> set[str]:
    """Heads after which a sentence may go on; the others are reduced at its end only."""
    out = {x for _, right in grammar for x in right[:-1]}
    while more := {right[-1] for head, right in grammar if right and head in out} - out:
        out |= more
    return out


MOVES, COMPLETE = lr_states(GRAMMAR)
GOING_ON = _going_on(GRAMMAR)


class Cell:
    """Top of a stack and the stack below; one object for equal stacks."""

    __slots__ = ("state", "below", "above")

    def __init__(self, state: int, below: Cell | None) -> None:
        self.state, self.below, self.above = state, below, {}

    def push(self, state: int) -> Cell:
        if state not in self.above:
            self.above[state] = Cell(state, self)
        return self.above[state]

    def states(self) -> tuple[int, ...]:
        return (*(self.below.states() if self.below else ()), self.state)


ROOT = Cell(0, None)


def cell_of(states: list[int]) -> Cell:
    return functools.reduce(Cell.push, states[1:], ROOT)


def _reduced(cell: Cell, at_end: bool) -> list[Cell]:
    """The stack and all that reductions make of it."""
    out = [cell]
    for one in out:
        for head, length in COMPLETE[one.state]:
            base = one
            for _ in range(length):
                base = base.below
            if (at_end or head in GOING_ON) and (base.state, head) in MOVES:
                out.append(base.push(MOVES[base.state, head]))
    return out


@functools.cache
def shifted(cell: Cell, role: str) -> tuple[Cell, ...]:
    """Stacks after a turn of a role: those that can go on, or else those that can end."""
    if (cell.state, role) not in MOVES:
        return ()
    made = _reduced(cell.push(MOVES[cell.state, role]), False)
    return tuple(c for c in made if any((c.state, x) in MOVES for x in ROLE)) or tuple(filter(accepted, made))


@functools.cache
def accepted(cell: Cell) -> bool:
    """Whether the turns so far are a sentence."""
    def whole(c: Cell) -> bool:
        return any(head == GRAMMAR[0][0] and len(c.states()) == length + 1 for head, length in COMPLETE[c.state])
    return any(whole(c) for c in _reduced(cell, True))


# ---- parsing -----------------------------------------------------------------------------------------

def _put(tops: dict[Cell, Cost], cell: Cell, cost: Cost) -> bool:
    if cell not in tops or cost < tops[cell]:
        tops[cell] = cost
        return True
    return False


def _with_inserts(tops: dict[Cell, Cost]) -> dict[Cell, Cost]:
    todo = list(tops)
    while todo:
        cell = todo.pop()
        cost, audit = tops[cell]
        for role in "ua":
            todo += [c for c in shifted(cell, role) if _put(tops, c, (cost + INSERT, audit + "I"))]
    return tops


def edited(tokens: str, tops: dict[Cell, Cost]) -> dict[Cell, Cost]:
    """Stacks after some turns, from stacks with what was spent on them.

    A token is the initial of a role, in upper case if the turn is truncated; `-` stands for a turn that
    must go, `x` and `X` for a role of another initial.
    """
    tops = _with_inserts(dict(tops))
    for token in tokens:
        after: dict[Cell, Cost] = {}
        extra, initial = TRUNCATED * token.isupper(), token.lower()
        for cell, (cost, audit) in tops.items():
            _put(after, cell, (cost + DELETE, audit + "D"))
            if token == "-":
                continue
            for c in shifted(cell, initial):
                _put(after, c, (cost + extra, audit + "K"))
            for role in "ua":
                for c in shifted(cell, role):
                    _put(after, c, (cost + extra + REROLE, audit + "R"))
        tops = _with_inserts(after)
    return tops


def reachable() -> list[Cell]:
    """All stacks on which a block may start."""
    out = [ROOT]
    for cell in out:
        out += [c for role in ROLE for c in shifted(cell, role) if c not in out]
    return out


def _transfer(tokens: str, entries: list[Cell]) -> list[dict]:
    return [{"entry": list(e.states()), "exit": list(c.states()), "cost": cost, "audit": audit}
            for e in entries for c, (cost, audit) in edited(tokens, {e: (0, "")}).items()]


@functools.lru_cache(1 << 16)
def _short_transfer(tokens: str) -> list[dict]:
    """Most conversations are short and look like many others."""
    return _transfer(tokens, [ROOT])


def chained(blocks: list[list[dict]]) -> Cost:
    """Cheapest edits through all blocks that leave a sentence."""
    tops: dict[tuple, Cost] = {ROOT.states(): (0, "")}
    for block in blocks:
        after: dict[tuple, Cost] = {}
        for step in block:
            if (entry := tuple(step["entry"])) in tops:
                cost, audit = tops[entry]
                _put(after, tuple(step["exit"]), (cost + step["cost"], audit + step["audit"]))
        tops = after
    return min(v for states, v in tops.items() if accepted(cell_of(list(states))))


# ---- Spark -------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text) after the damage that the crc32 of `id:turn` modulo 20 decides: 0 drops the
    row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes it a user's."""
    def filled(c: str):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    code = F.crc32(F.concat(filled(id_col), F.lit(":"), filled(turn_col))) % 20
    text = F.when(F.col("__code") == 1, "").when(F.col("__code") == 2, F.regexp_replace(filled(text_col), "[.!?]", "")).otherwise(filled(text_col))
    return (conversations.withColumn("__code", code).where("__code <> 0")
            .select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.when(F.col("__code") == 4, "user").otherwise(filled(role_col)).alias("role"),
                    text.alias("text"), F.explode(F.when(F.col("__code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")).drop("__copy"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "h1", "h2"]


def turn_faults(rows: DataFrame) -> DataFrame:
    """(id, turn, role, h1, h2, initial, n, fault, rest) for each distinct row of a conversation: how often
    it occurs, the fault of its first occurrence and of the others (`b`, `d`, `t` or `.` for none)."""
    hashed = _hashed(rows)
    last = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    kinds = (hashed.select("id", "turn", "role", "h1", "h2", F.when(last == "", "b").when(last.isin(".", "!", "?"), ".").otherwise("t").alias("kind"))
             .groupBy("id", "turn", "role", "h1", "h2").agg(F.count("*").alias("n"), F.min("kind").alias("kind")))
    # null turns come first, as the minimum of (known, turn) puts them
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = kinds.groupBy("id", "role", "h1", "h2").agg(F.min(place).alias("first")).withColumnsRenamed({"id": "i", "role": "r", "h1": "g1", "h2": "g2"})
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    again = ~place.eqNullSafe(F.col("first"))
    initial = F.lower(F.substring("role", 1, 1))
    return kinds.join(first, same).select(
        "id", "turn", "role", "h1", "h2", "n", F.when(F.substring("role", 1, 1).isin(*ROLE), initial).otherwise("x").alias("initial"),
        F.when((F.col("kind") != "b") & again, "d").otherwise(F.col("kind")).alias("fault"), F.when(F.col("kind") == "b", "b").otherwise("d").alias("rest"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """[id, rows] of each block: rows of one conversation that follow each other, `BLOCK` turns at most."""
    now: list | None = None
    for batch in batches:
        for key, turn, initial, n, fault, rest in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "initial", "n", "fault", "rest")), strict=True):
            while n:
                if now is None or now[0] != key or now[2] >= BLOCK:
                    if now is not None:
                        yield now
                    now = [key, [], 0]
                some = min(n, BLOCK - now[2])
                now[1].append((turn, initial, some, fault, rest))
                now[2] += some
                n, fault = n - some, rest
    if now is not None:
        yield now


LEGAL = {"su", "ua", "au"}
STEP = pa.list_(pa.struct([("entry", pa.list_(pa.int32())), ("exit", pa.list_(pa.int32())), ("cost", pa.int64()), ("audit", pa.string())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
BLOCK_FIELDS = [*((c, pa.int64()) for c in COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("steps", STEP)]
BLOCK_TYPE = ("blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, "
              "steps array<struct<entry: array<int>, exit: array<int>, cost: long, audit: string>>")


def _block(rows: list[tuple], whole: bool) -> dict:
    """What a block adds to its conversation.  `turns` counts distinct turns, `low` and `high` are their ends."""
    out = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "first": rows[0][1], "last": rows[-1][1]}
    tokens, before = [], ""
    for turn, initial, n, fault, rest in rows:
        for kind, times in ((fault, 1), (rest, n - 1)):
            name = {"b": "blank", "d": "duplicate", "t": "truncated"}.get(kind)
            if name and times:
                out[name] += times
            tokens.append(("-" if kind in "bd" else initial.upper() if kind == "t" else initial) * times)
        out["illegal"] += (before + initial not in LEGAL if before else 0) + n - 1  # no role may follow itself
        before = initial
        if turn is not None and turn != out["high"]:
            out["turns"] += 1
            out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
    text = "".join(tokens)
    return out | {"steps": _short_transfer(text) if whole and len(text) < 64 else _transfer(text, [ROOT] if whole else reachable())}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks of a sorted partition; one that may go on in another block is parsed from every stack."""
    runs = _runs(batches)
    before, now = None, next(runs, None)
    while now is not None:
        after = next(runs, None)
        whole = before is not None and after is not None and before[0] != now[0] != after[0]
        yield {"id": now[0], **_block(now[1], whole)}
        before, now = now, after


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema)


def _conversation(key: object, blocks: list[dict]) -> dict:
    out = {"id": key} | {c: sum(b[c] for b in blocks) for c in COUNTS}
    low = high = None
    for before, block in itertools.pairwise(blocks):
        out["illegal"] += before["last"] + block["first"] not in LEGAL
    for block in blocks:
        if block["low"] is not None:
            out["turns"] -= block["low"] == high  # a turn on both sides of a cut
            low, high = block["low"] if low is None else low, block["high"]
    out["gaps"] = 0 if low is None else high - low + 1 - out["turns"]
    out["cost"], out["audit"] = chained([b["steps"] for b in blocks])
    return out


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repairs(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `rows`, a
    table of (id, turn, role, text) without nulls in role and text.  An empty table gives none."""
    kind = rows.schema["id"].dataType
    key = pa.field("id", to_arrow_type(kind))
    block = pa.schema([key, ("seq", pa.int64()), *BLOCK_FIELDS])
    summary = pa.schema([key, *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(({"seq": i} | b for i, b in enumerate(_blocks(batches))), block)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((k, b) for batch in batches for k, b in zip(batch.column("id").to_pylist(), batch.column("blocks").to_pylist(), strict=True))
        return _in_batches((_conversation(k, b) for k, b in pairs), summary)

    by = [F.col("id").asc_nulls_first(), *_order()]
    ordered = turn_faults(rows).repartitionByRange(pieces(rows, PIECE_BYTES), *by).sortWithinPartitions(*by)
    blocks = ordered.select("id", "turn", "initial", "n", "fault", "rest").mapInArrow(parse, f"id {kind.simpleString()}, seq long, {BLOCK_TYPE}")
    chains = (blocks.withColumn("part", F.spark_partition_id()).groupBy("id")
              .agg(F.array_sort(F.collect_list(F.struct("part", "seq", *(n for n, _ in BLOCK_FIELDS)))).alias("blocks")))
    return chains.mapInArrow(chain, f"id {kind.simpleString()}, {', '.join(f'{c} long' for c in SUMMARY)}, audit string")


def _repaired(header: dict, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) along an audit; deleted turns too."""
    expected = "u"
    for edit in header["audit"] or "":
        role, text = ("", "") if edit == "I" else next(turns)
        if edit in "IR":
            role = ROLE[expected]
        if edit != "D":
            expected = {"u": "a"}.get(role[:1], "u")
        yield edit, role, text


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(header, turns) of each conversation of a sorted partition, whose first row is its header."""
    rows = ((k, h, r, t) for batch in batches for k, h, r, t in zip(*(batch.column(c).to_pylist() for c in ("id", "header", "role", "text")), strict=True))
    for _, group in itertools.groupby(rows, key=lambda row: row[0]):
        first = next(group)
        yield {"id": first[0], **first[1]}, ((r, t) for _, _, r, t in group)


def _digest(header: dict, turns: Iterator[tuple[str, str]]) -> dict:
    sha, between = hashlib.sha256(), b""
    for edit, role, text in _repaired(header, turns):
        if edit != "D":
            sha.update(between + f"{role}:{text}".encode())
            between = b"\n"
    return header | {"repaired_sha256": sha.hexdigest()}


def _with_headers(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Turns behind a header row of their conversation, in order, one conversation in one partition."""
    found = repairs(rows).withColumnRenamed("id", "k")
    empty = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMMARY] + [F.coalesce("audit", F.lit("")).alias("audit")]
    ids = conversations.distinct()
    headers = ids.join(found, F.col("id").eqNullSafe(F.col("k")), "left").select("id", F.struct(*empty).alias("header"))
    both = headers.unionByName(_hashed(rows), allowMissingColumns=True)
    return (both.repartition(pieces(rows, PIECE_BYTES), "id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("header").isNull(), *_order())
            .select("id", "header", "role", "text"))


def _ids(conversations: DataFrame, id_col: str) -> DataFrame:
    return conversations.select(F.col(f"`{id_col}`").alias("id"))


def repair_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation
    after `damaged`.

    A conversation that has no turn left has zeros, an empty audit and the digest of nothing.  Repeated
    rows are turns each: all but the first are duplicates.  An empty table gives none; columns other
    than the four named ones play no part.
    """
    kind = conversations.schema[id_col].dataType
    out = pa.schema([("id", to_arrow_type(kind)), *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches((_digest(h, t) for h, t in _streamed(batches)), out)

    rows = damaged(conversations, id_col, turn_col, role_col, text_col)
    done = _with_headers(_ids(conversations, id_col), rows).mapInArrow(run, f"id {kind.simpleString()}, {', '.join(f'{c} long' for c in SUMMARY)}, audit string, repaired_sha256 string")
    return done.withColumnRenamed("id", id_col)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(id, place, edit, role, text): the turns of each conversation of `rows` (id, turn, role, text; no
    nulls in role and text) along its cheapest edits, deleted ones too, with what became of them."""
    kind = rows.schema["id"].dataType
    out = pa.schema([("id", to_arrow_type(kind)), ("place", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ({"id": h["id"], "place": i, "edit": e, "role": r, "text": x} for h, t in _streamed(batches) for i, (e, r, x) in enumerate(_repaired(h, t)))
        return _in_batches(turns, out)

    return _with_headers(rows.select("id"), rows).mapInArrow(run, f"id {kind.simpleString()}, place long, edit string, role string, text string")
