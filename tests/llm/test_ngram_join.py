"""The n-gram join against comparing all pairs, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import ngram_join as join


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[i:i + width]) for i in range(len(words) - width + 1)] if words else [])


def groups_by_hand(rows, percent=80):
    rows_of = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        rows_of[shingles(text)].append(i)
    sets = list(rows_of)
    root, holders = list(range(len(sets))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, s in enumerate(sets):
        ids = [rows[k][0] for k in rows_of[s] if rows[k][0] is not None]
        least[find(i)] = min([*ids, *([least[find(i)]] if least.get(find(i)) is not None else [])], default=None)
    out = [(rows[k][0], len(s), least[find(i)] if s else rows[k][0]) for i, s in enumerate(sets) for k in rows_of[s]]
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "doc_id long, text string, node string, n string, code string, low string").repartition(5)
    return sorted((tuple(r) for r in join.groups(df, **options).collect()), key=str)


def test_odd_rows(shared):
    long = " ".join(f"w{i % 701} of {i * 7 % 13}" for i in range(20000))
    rows = [(1, ""), (2, None), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four five"), (7, "one two three four five"), (7, "another text of six words here"),
            (None, "one"), (None, "alone under no id"), (8, long), (9, long + " end"), (10, "é É"), (11, "É é"), (12, "one two\x0bthree four")]
    assert found(shared, rows) == groups_by_hand(rows)
    assert found(shared, []) == []


@pytest.mark.parametrize("many", [2, 4])
def test_frequent_tokens_and_hot_groups(shared, monkeypatch, many):
    """Texts made of a few passages that all share, at every distance around the limit."""
    monkeypatch.setattr(join, "SAMPLE", 1)
    monkeypatch.setattr(join, "MANY", many)
    monkeypatch.setattr(join, "TILE", 40)
    monkeypatch.setattr(join, "PER_CENTRE", 7)
    rng = random.Random(many)
    passages = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 12, 40, 120, 300]))] for _ in range(20)]
    rows = []
    for i in range(900):
        words = list(rng.choice(passages))
        for _ in range(rng.randrange(max(1, len(words) // 9) + 1)):
            at = rng.randrange(len(words))
            words[at:at + 1] = [f"x{rng.randrange(50)}"] if rng.random() < 0.5 else []
            words = words or ["none"]
        rows.append((i, " ".join(words + (rng.choice(passages)[:rng.randrange(1, 8)] if rng.random() < 0.3 else []))))
    assert found(shared, rows) == groups_by_hand(rows)


def test_hints_are_verified(shared):
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "quite another text than the two before it")]
    hints = shared.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert found(shared, rows, hints=hints) == groups_by_hand(rows)


def test_signatures_miss_no_link():
    """Two sets that link share a signature, whatever is frequent."""
    rng = np.random.default_rng(5)
    starts = join.bands(80)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 4, 9, 24, 25, 40, 90, 300]))
        universe = rng.integers(0, 2**64, 4 * n + 8, np.uint64, endpoint=False)
        known = np.sort(rng.choice(universe, int(rng.integers(0, len(universe))), replace=False))
        times = rng.integers(2, 9, len(known))
        x = np.unique(rng.choice(universe, n, replace=False))
        keep = x[rng.random(len(x)) > rng.choice([0, 0.05, 0.1, 0.2])]
        y = np.unique(np.concatenate((keep, rng.choice(universe, int(rng.integers(0, n // 8 + 1)), replace=False))))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= 80 * (len(x) + len(y) - common):
            a, b = (set(join.signatures(s, 80, starts, known, times).tolist()) for s in (x, y))
            assert a & b
            assert join.may_link(join.parities(x), join.parities(y), len(x), len(y), 80)
            sizes, odd = np.array([len(x), len(y)]), [join.parities(x), join.parities(y)]
            assert len(join.near_pairs(sizes, odd, np.array([[0], [1]]), 80)[0]) == 1


def test_a_tile_gives_links_that_join_and_no_pairs():
    """Near copies of one text that is not there: their links come as a forest, not as all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 200, np.uint64, endpoint=False)
    sets = [np.unique(np.concatenate((base[rng.random(200) > 0.05], rng.integers(0, 2**64, int(rng.integers(0, 12)), np.uint64, endpoint=False)))) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 2**64, 200, np.uint64, endpoint=False)) for _ in range(5)]
    for sides in (np.arange(65), np.arange(65) % 2):
        root = np.where(np.arange(65) < 4, 0, np.arange(65))
        truth = [(i, j) for i in range(65) for j in range(i) if sides[i] != sides[j]
                 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        x, y = join.joining_links(sets, root, sides, 80)
        assert {(max(p), min(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} <= set(truth)

        def roots(pairs):
            of = root.copy()
            for i, j in pairs:
                of[of == of[j]] = of[i]
            return [of.tolist().index(r) for r in of]

        assert roots(zip(x, y, strict=True)) == roots(truth) and len(truth) > 300
        assert len(x) == len(set(root.tolist())) - len(set(roots(truth)))
    assert join.joining_links(sets[:1], np.zeros(1, np.int64), np.zeros(1, np.int64), 80)[0].tolist() == []
