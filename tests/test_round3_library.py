"""Matching of books and lookup of chapters: rows are shuffled as they are, not once for each key."""

import re

import pytest
from folioflow.operators import library as L

BOOKS = [("s1", "1", "A", "x"), ("s1", "9", " ", ""), ("s1", "9", "b B", "y"), ("s1", "7", "", "x"), ("s1", "8", "a", None), ("s1", None, "A", "x"), ("s2", "1", "A", "x"), ("s3", "1", "", ""), (None, "1", "A", "x"), ("s1", "1", "A", "x")]
HITS = [("s1", "1", "A", "x", 3), ("s1", "2", " A ", "x", 2), ("s1", "4", "bB", "y", 5), ("s1", "4", "bB", "y", 5), ("s1", "8", "q", "q", None), ("s2", "5", "a", "", 1), (None, "1", "A", "x", 0), ("s1", None, "A", "x", 9), ("s4", "1", "A", "x", 1)]


def tables(spark):
    books = spark.createDataFrame([(*b, "", "", "") for b in BOOKS], "site string, book_id string, title string, author string, description string, cover_url string, source_url string")
    hits = spark.createDataFrame([(s, i, t, a, f"about {o}", "c", f"u{o}", o) for s, i, t, a, o in HITS], "site string, book_id string, title string, author string, description string, cover_url string, url string, ord long")
    return books, hits


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("most", [100_000, 3])
def test_matches_inside_sites_are_those_by_keys(spark, monkeypatch, most):
    monkeypatch.setattr(L, "SITE_ROWS", most)
    books, hits = tables(spark)
    got = L.fallback_match(books, hits)
    assert rows(got) == rows(L._match_by_keys(books, hits))
    by = {(r.site, r.book_id, r.title, r.author): r.match and r.match.book_id for r in got.collect()}
    assert by == {("s1", "1", "A", "x"): "1", ("s1", "9", " ", ""): "2", ("s1", "9", "b B", "y"): "2", ("s1", "7", "", "x"): "2", ("s1", "8", "a", None): None, ("s1", None, "A", "x"): None,
                  ("s2", "1", "A", "x"): None, ("s3", "1", "", ""): None, (None, "1", "A", "x"): None}


def test_hits_are_listed_by_their_keys_behind_the_shuffle(spark):
    plan = L.fallback_match(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate posexplode[\s\S]*RepartitionByExpression", plan) and not re.search(r"RepartitionByExpression[\s\S]*Generate", plan)


def test_requests_are_read_once_and_keep_their_rows(spark):
    stored = spark.createDataFrame([("s", "b", "1", "u1", "t", 1, "x"), ("s", "b", "1", "u1", "t", 2, " "), ("s", "b", "2", "u2", "t", 3, "y"), ("s", "b", "3", "u3", "", 4, "z")],
                                   "site string, book_id string, chapter_id string, url string, title string, order_index long, content string")
    asked = [("r1", "1", "", ""), ("r2", "2", "u1", ""), ("r3", "", "", "t"), ("r4", "", "", ""), ("r5", "8", "", ""), ("r6", "3", "", ""), ("r6", "", "u2", ""), (None, "3", "", ""), ("r1", "1", "", "")]
    requests = spark.createDataFrame([(r, "s", "b", i, u, t) for r, i, u, t in asked], "request_id string, site string, book_id string, chapter_id string, url string, title string").repartition(2, "request_id")
    found = L.lookup_stored(requests, stored)
    assert found.columns == [*requests.columns, "stored_id", "stored_order"]
    want = [("r1", "1", "1", 1), ("r1", "1", "1", 1), ("r2", "2", "2", 3), ("r3", "", "1", 1), ("r4", "", None, None), ("r5", "8", None, None), ("r6", "3", "3", 4), ("r6", "", "3", 4), (None, "3", None, None)]
    assert sorted(repr((r.request_id, r.chapter_id, r.stored_id, r.stored_order)) for r in found.collect()) == sorted(map(repr, want))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_line_entries_are_computed_once(spark):
    from folioflow.llm import lines as M
    rows = spark.createDataFrame([(i, f"a line of some length, number {i // 2 * 7}{'x' * (i % 2)}") for i in range(8)], "k long, line string")
    found = M.candidates(rows.withColumn("k", M.name_of(M.F.col("line"), M.F.col("k"))), 2)
    assert found.count() >= 4
    # lengths are columns, not computed for each of the 15 entries: 3 of the index and 12 probes
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("xxhash64(") == 15 and len(re.findall(r"(?<!octet_)length\(line", text)) <= 6
    docs = spark.createDataFrame([(1, "a\n\n b"), (2, None), (3, "")], "doc_id long, text string")
    lines = M.lines_of(docs, "doc_id", "text")
    assert sorted((r.id, r.line_no, r.line) for r in lines.collect()) == [(1, 0, "a"), (1, 2, "b")]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
