"""Repair and prefix trie of conversations against plain versions, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioflow.llm import conversation_repair as repair
from folioflow.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, key string, audit long, shard string, seq string"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


def table(spark, rows):
    """Conversations with further columns of clashing names."""
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Null ids, turns, roles and texts, repeated rows, ties, strange roles, one long conversation."""
    rng = random.Random(2)
    words = ["Yes.", "No!", "what", "", " ", "\t\n", "Why so?", "a ", "é.", "one. two", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice(words)) for c in [None, *range(60)] for t in range(rng.randint(1, 9))]
    rows += [(c, None, "user", "no turn.") for c in (1, 2, 3, None)] + rows[:40] + [(7, 3, "user", "tie."), (7, 3, "user", "other tie")]
    return rows + [(100, t // 2, ("user", "assistant")[t % 2], f"turn {t % 50}{'.' * (t % 3)}") for t in range(900)] + [(101, 4, "user", " ")] * 30


# ---- repair ------------------------------------------------------------------------------------------

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # 0 nothing, 1 system, 2 open, 3 closed


def cheapest(turns):
    """(cost, audit, repaired) by dynamic programming over (role, text, fault)."""
    def inserted(tops):
        grew = True
        while grew:
            grew = False
            for state, (cost, audit, out) in list(tops.items()):
                for y in "ua":
                    to = NEXT.get((state, y))
                    new = (cost + 3, audit + "I", [*out, (repair.ROLE[y], "")])
                    if to is not None and (to not in tops or new[:2] < tops[to][:2]):
                        tops[to], grew = new, True
        return tops

    tops = inserted({0: (0, "", [])})
    for role, text, fault in turns:
        after = {}
        for state, (cost, audit, out) in tops.items():
            options = [(state, (cost + 4, audit + "D", out))]
            if fault not in "bd":
                extra = 3 * (fault == "t")
                options += [(NEXT[state, y], (cost + extra + price, audit + edit, [*out, (name, text)]))
                            for y, name, price, edit in ((role[:1], role, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")) if (state, y) in NEXT]
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        tops = inserted(after)
    return min((tops[s] for s in (0, 3) if s in tops), key=lambda v: v[:2])


def place_of(spark, rows):
    """The order of equal turns: by role, then by two hashes of the text, as Spark computes them."""
    texts = {t for *_, t in rows} | {"", " "} | {re.sub("[.!?]", "", t or " ") for *_, t in rows}
    df = spark.createDataFrame([(t if t is not None else " ",) for t in texts], "t string").distinct()
    return {r.t: (r.a, r.b) for r in df.selectExpr("t", "xxhash64(t) AS a", "xxhash64(1, t) AS b").collect()}


def repaired_by_hand(spark, rows):
    order, found = place_of(spark, rows), {}
    for c, t, role, text in rows:
        own = found.setdefault(c, [])
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [] if code == 0 else [(t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for c, own in found.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], order[v[2]]))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "." if last in ".!?" else "t")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults, strict=True)])
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest())
    return out


def test_repair_equals_dynamic_programming(shared, odd):
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(table(shared, odd)).collect()}
    assert got == repaired_by_hand(shared, odd)
    assert repair.repair_digests(table(shared, [])).collect() == []


def test_blocks_of_a_conversation_are_chained(shared, odd, monkeypatch):
    """The same where blocks are a few turns and partitions many."""
    monkeypatch.setattr(repair, "BLOCK", 5)
    monkeypatch.setattr(repair, "pieces", lambda *_: 37)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(table(shared, odd)).collect()}
    assert got == repaired_by_hand(shared, odd)


def test_parser_knows_the_grammar():
    legal = re.compile("(s?(ua)+)?")
    for n in range(7):
        for roles in map("".join, itertools.product("sua", repeat=n)):
            tops = {repair.ROOT: None}
            for role in roles:
                tops = {c: None for top in tops for c in repair.shifted(top, role)}
            assert any(map(repair.accepted, tops)) == bool(legal.fullmatch(roles)), roles
    assert len(repair.reachable()) == 8


def test_repaired_turns_are_what_the_audit_says(shared):
    rows = shared.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", " "), (1, 2, "user", "So?"), (2, 0, "system", "Be kind.")], "id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in repair.repaired_turns(rows).collect())
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi."), (1, 2, "D", "user", " "), (1, 3, "K", "user", "So?"), (1, 4, "I", "assistant", ""), (2, 0, "D", "system", "Be kind.")]


# ---- trie --------------------------------------------------------------------------------------------

def nodes_by_hand(sequences):
    members, children = defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].add(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = sum(saved[k] for k in children[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(s)).encode()).hexdigest()) for s, m in members.items()}


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        shared = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:shared] + turns[c][shared:])
    return out


def test_trie_equals_a_plain_one(shared, odd):
    rows = odd + [(-3, 0, "user", "x"), (-7, 0, "user", "x"), (1002, 0, "user", "alone"), (1004, 0, "user", "alone")]
    got = [tuple(r) for r in trie.shared_prefixes(table(shared, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == nodes_by_hand(rebuilt_by_hand(rows))
    assert trie.shared_prefixes(table(shared, [])).collect() == []


def test_spines_of_many_shards_merge(shared):
    rng = random.Random(4)
    sequences = {c: tuple(("user", rng.choice("abc")) for _ in range(rng.choice([0, 1, 2, 3, 5, 60]))) for c in range(400)}
    arrays = [(c, [(bytearray(hashlib.md5(f"{r}{x}".encode()).digest()), len(x)) for r, x in s]) for c, s in sequences.items()]
    df = shared.createDataFrame(arrays, "id long, turns array<struct<digest: binary, size: long>>")
    want = nodes_by_hand(sequences)
    for parts, fan in ((1, 1000), (30, 1000), (30, 4)):
        got = [tuple(r) for r in trie.trie(df, parts, fan).collect()]
        assert len(got) == len(want) and set(got) == want, (parts, fan)


def test_parentheses_delimit_subtrees():
    rng = random.Random(6)
    for n in (1, 2, 3, 70, 4000):
        for deepest in (2, 40, 10 ** 6):
            depth = [0]
            while len(depth) < n:
                depth.append(rng.randint(max(1, depth[-1] - deepest), depth[-1] + 1) if rng.random() < 0.3 else depth[-1] + 1)
            tree = trie.Parentheses(np.array(depth))
            end = [next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n) for i in range(n)]
            assert tree.after().tolist() == end
            leaf = [i + 1 == n or depth[i + 1] <= depth[i] for i in range(n)]
            assert tree.leaves(np.ones(n, bool)).tolist() == [sum(leaf[i:e]) for i, e in enumerate(end)]
