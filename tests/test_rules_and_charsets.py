"""Selector rules, charsets and broken bytes, ingest and its base, folder cycles."""

from pyspark.sql import functions as F

from folioflow.operators import shelf as S
from folioflow.operators.extraction import extract
from folioflow.sources import pages as P
from folioflow.streaming import upserts as U

PAGE = """<html lang="en"><body><div id="main" class="box wide"><h1>Title</h1><p class="line first">one<br>two</p><div><p class="line">deep</p></div>
<a href="/x?a=b" data-id="7">link</a><a>no address</a></div><p class="line"> </p><p>outside</p></body></html>"""


def found(spark, selector, mode="text", attribute="", take="all"):
    pages = P.with_nodes(spark.createDataFrame([("s", "https://h.example/dir/p.html", PAGE)], "site string, url string, html string"))
    rules = spark.createDataFrame([("s", "f", 1, selector, mode, attribute, take)], "site string, field string, ord int, selector string, mode string, attribute string, take string")
    rows = extract(pages, rules).collect()
    return list(rows[0]["values"]) if rows else []


def test_selectors(spark):
    want = {"p": ["onetwo", "deep", "outside"], "p.line": ["onetwo", "deep"], ".line.first": ["onetwo"], "#main > p": ["onetwo"], "#main p": ["onetwo", "deep"], "div.box.wide>div > p": ["deep"],
            "a[href]": ["link"], "a[data-id=7]": ["link"], "a[data-id=8]": [], "html[lang=en] h1": ["Title"], "* > h1": ["Title"], "div div p": ["deep"], "span": [], "div#main.wide h1": ["Title"], "": []}
    assert {s: found(spark, s) for s in want} == want
    assert found(spark, "p", "lines", take="first") == ["one\ntwo"]
    assert found(spark, "a", "attr", "data-id") == ["7"] and found(spark, "a", "url", "href") == ["https://h.example/x?a=b"]


def test_rules_are_tried_in_order_and_by_site(spark):
    pages = P.with_nodes(spark.createDataFrame([("s", "u", PAGE), ("t", "u", PAGE), ("none", "u", PAGE)], "site string, url string, html string"))
    rules = [("s", "title", 2, "h1", "text", None, "first"), ("s", "title", 1, "h2", "text", None, "first"), ("t", "title", 1, "a", "text", None, "first"), ("t", "gone", 1, "h6", "text", None, "all")]
    got = extract(pages, spark.createDataFrame(rules, "site string, field string, ord int, selector string, mode string, attribute string, take string")).collect()
    assert sorted((r.site, r.field, list(r["values"])) for r in got) == [("s", "title", ["Title"]), ("t", "title", ["link"])]


def test_charsets_and_broken_bytes(spark):
    rows = [("你好".encode("gbk"), "text/html; charset=GB2312", "你好"), (b"\xff\xfe" + "é".encode("utf-16-le"), None, "é"), ("日本".encode("shift_jis"), "charset='Shift_JIS'", "日本"),
            (b"\xc4", "text/html;charset=gbk", "�"), (b"a\x81b", "x; charset=windows-1252", "a\x81b"), (b"\xe9t\xe9", None, "été"), (b"\xe4\xbd\xa0\xff", "charset=utf-8", "你�"),
            (b'<meta charset="euc-kr">' + "한".encode("euc_kr"), "text/html", '<meta charset="euc-kr">한'), (b"plain", "charset=klingon", "plain"), (b"", None, ""), (None, "charset=gbk", None), (b"\xef\xbb\xbfok", "charset=gbk", "ok")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c) for i, (b, c, _) in enumerate(rows)], "i int, body binary, type string")
    got = {r.i: r.t for r in df.select("i", P.decoded("body", "type").alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(rows)}


FETCHED = "site string, book_id string, chapter_id string, title string, content string, url string, volume string, order_index long, fetched_at timestamp, error string"


def test_ingest_keeps_chapters_over_batches_and_bases(spark, tmp_path):
    import datetime as dt
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    batches = [[("s", "b", "1", "t1", "one", "u", "", 1, at(0), None)], [("s", "b", "2", "t2", "two", "u", "", 2, at(1), ""), ("s", "c", "9", "t", "", "u", "", 1, at(1), None)],
               [("s", "b", "1", "new", "one again", "u", "", 1, at(2), None), ("s", "b", "2", "bad", "lost", "u", "", 2, at(2), "http 500")], [("s", "b", "1", "late", "older", "u", "", 1, at(-5), None)],
               [("s", "b", "3", "t3", "three", "u", "", 3, at(9), None)]]
    for every in (1, 2, 100):
        root = str(tmp_path / str(every))
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, FETCHED).coalesce(1).write.mode("append").parquet(f"{root}/in/{n}")
            stream = spark.readStream.schema(FETCHED).parquet(f"{root}/in/*")
            U.ingest_pages(stream, lambda df: df, root, "raw", f"{root}/state", {"availableNow": True}, every).awaitTermination()
        got = {(r.book_id, r.chapter_id): (r.title, r.content) for r in U.chapter_table(spark, root, "raw", every).current().collect()}
        assert got == {("b", "1"): ("new", "one again"), ("b", "2"): ("t2", "two"), ("b", "3"): ("t3", "three")}
        listing = spark.createDataFrame([("s", "b", str(i)) for i in range(5)], "site string, book_id string, chapter_id string")
        assert sorted(r.chapter_id for r in U.still_pending(spark, root, listing).collect()) == ["0", "4"]
        U.chapter_table(spark, root, "raw", every).put(spark.createDataFrame(batches[4], FETCHED).withColumn("downloaded", F.lit(True)).drop("error"), 4)  # a batch that runs again
        assert U.chapters_at(spark, root).count() == 3


def test_cycles_and_unknown_parents(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 2), (5, None), (6, 5), (7, 99), (8, 8)]
    items = spark.createDataFrame([(i, p, "folder") for i, p in rows], "item_id long, parent_id long, kind string")
    got = {r.item_id: (r.path, r.cycle) for r in S.breadcrumbs(items).collect()}
    assert got[6] == ([5, 6], False) and got[7] == ([99, 7], False) and got[8] == ([8, 8], True)
    assert all(got[i][1] and got[i][0][0] in got[i][0][1:] for i in (1, 2, 3, 4)) and got[1][0] == [1, 3, 2, 1][::1]
    below = sorted((r.root_id, r.item_id, r.depth) for r in S.descendants(items, items).collect())
    assert [(a, b) for a, b, _ in below if a == 5] == [(5, 6)] and {b for a, b, _ in below if a == 2} == {1, 3, 4} and len(below) == len(set(below))
