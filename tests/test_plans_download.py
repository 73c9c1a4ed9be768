from folioflow.plans import download as D
from test_pages import CH

FETCHED = "site string, book_id string, chapter_id string, content string, error string"


def test_update_of_a_library(spark):
    rows = [("s", b, str(i), f"t{i}", "", "", i, False) for b in "ab" for i in range(1, 5)]
    listing = spark.createDataFrame(rows, CH).selectExpr("*", "'v' AS volume")
    stored = spark.createDataFrame([("s", "a", "2", "x", "kept", "", 2, True)], CH)
    requests = spark.createDataFrame([("s", "a", "", "3", []), ("s", "b", "", "2", [])], "site string, book_id string, start_id string, end_id string, ignore_ids array<string>")
    merged, todo = D.plan_work(requests, listing, stored)
    assert sorted((r.book_id, r.chapter_id) for r in todo.collect()) == [("a", "1"), ("a", "3"), ("b", "1"), ("b", "2")]
    fetched = spark.createDataFrame([("s", "a", "1", " é\r\nnew​ ", ""), ("s", "a", "3", "", "http 500"), ("s", "b", "1", "", "http 500"), ("s", "b", "2", " ", "")], FETCHED)
    filled, totals = D.apply_fetched(merged, fetched)
    got = {r.book_id: (r.pending, r.failed, r.empty, r.all_failed) for r in totals.collect()}
    assert got == {"a": (2, 1, 0, False), "b": (2, 1, 1, True)}
    out = D.finish(filled, [("cleaner", {"remove_invisible": True}), ("custom", {})], "zh-hans", {"é": "e"})
    assert sorted((r.chapter_id, r.content, r.stage) for r in out.collect()) == [("1", "e\nnew", "custom"), ("2", "kept", "custom"), ("3", "", "custom")]
