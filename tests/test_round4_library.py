"""Lookups of chapters: requests and chapters are shuffled once, by book, whatever way a book then goes."""

import random

import pytest
from folioflow.operators import library as L

KIND = "site string, book_id string, chapter_id string, url string, title string, order_index long"
ASKED = f"request_id string, {KIND}, fallback_index long"


def tables(spark):
    r = random.Random(5)
    base = lambda: (r.choice(["s", "s", "t", None]), r.choice(["1", "2", "3", "3", None]), r.choice(["", "1", "2", "3", "4", None]), r.choice(["", "u1", "u2", None]), r.choice(["", "A", "B", None]), r.choice([0, 1, 2, None]))
    chapters = [(*base(), r.choice(["x", " ", None, "y"]), r.choice([0, 1, 2, 3, 4, None])) for _ in range(50)]
    asked = [(r.choice([f"r{i}", f"r{i}", "r1", None]), *base(), r.choice([0, 1, 2, 9, -1, None])) for i in range(90)]
    return asked, chapters


def filled(*keys):
    return {(k, *v) for k, *v in keys if v[0] not in ("", None)}


def same(asked, chapters):
    """`same_chapter` row by row."""
    keys = lambda i, u, t, o: filled(("id", i), ("url", u), ("title", t if o else None, o))
    of = lambda s, b: [c for c in chapters if None not in (s, b) and c[:2] == (s, b)]
    at, best = [], {}
    for request, s, b, *own, f in asked:
        last = max((c[7] for c in of(s, b) if c[7] is not None), default=None)
        at.append(0 if last is None else max(0, min(f or 0, last)))
        found = [-1 if c[7] == at[-1] else c[7] for c in of(s, b) if keys(*own) & keys(*c[2:6]) and c[7] is not None]
        if request is not None:
            best[request] = min([*found, best.get(request, 99)])
    return [(*a, x if best.get(a[0], 99) in (-1, 99) else best[a[0]]) for a, x in zip(asked, at, strict=True)]


def stored(asked, chapters):
    """`lookup_stored` row by row; of chapters with equal order the least or the last id counts."""
    low = lambda o: (o is not None, o or 0)
    best = {}
    for request, s, b, i, u, t, *_ in asked:
        of = [c for c in chapters if None not in (s, b) and c[:2] == (s, b)]
        mine = [c for c in of if i and c[2] == i]
        last = max(mine, key=lambda c: (*low(c[5]), bool((c[6] or "").strip()))) if mine else None
        full = [c for c in of if (c[6] or "").strip() and filled(("id", i), ("url", u), ("title", t)) & filled(("id", c[2]), ("url", c[3]), ("title", c[4]))]
        # an id whose last chapter has content is found by that one
        found = [(0, low(last[5]))] if last and (last[6] or "").strip() else []
        found += [(1, low(c[5])) for c in full]
        if request is not None and found:
            best[request] = min([*found, best.get(request, (9,))])
    return [(*a, best[a[0]][1][1] if a[0] in best and best[a[0]][1][0] else None) for a in asked]


@pytest.mark.parametrize("most,at_once", [(100_000, 1_000_000), (100_000, 50), (12, 70)])
def test_lookups_agree_with_brute_force_whatever_way_a_book_goes(spark, monkeypatch, most, at_once):
    monkeypatch.setattr(L, "BOOK_ROWS", most)
    monkeypatch.setattr(L, "ROUND_ROWS", at_once, raising=False)
    asked, chapters = tables(spark)
    requests = spark.createDataFrame(asked, ASKED)
    rows = spark.createDataFrame(chapters, f"{KIND}, content string, position long")
    got = L.same_chapter(requests, rows)
    assert sorted(map(repr, map(tuple, got.select(*requests.columns, "matched_index").collect()))) == sorted(map(repr, same(asked, chapters)))
    found = L.lookup_stored(requests, rows)
    assert sorted(map(repr, map(tuple, found.drop("stored_id").collect()))) == sorted(map(repr, stored(asked, chapters)))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


@pytest.mark.parametrize("name", ["same_chapter", "lookup_stored"])
def test_requests_and_chapters_are_shuffled_once_by_book(spark, name):
    asked, chapters = tables(spark)
    rows = spark.createDataFrame(chapters, f"{KIND}, content string, position long")
    df = getattr(L, name)(spark.createDataFrame(asked, ASKED), rows)
    # by book, and by request id
    assert exchanges(df) == 2 and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
