from pyspark.sql import functions as F

from folioflow.functions import markup as M
from folioflow.operators import library as L
from folioflow.operators.urls import resolve_urls
from folioflow.sources.catalogs import volume_catalog
from folioflow.sources.pages import with_nodes

PAGE = "https://h.example.com/list/1.html"


def nodes(spark, html):
    return with_nodes(spark.createDataFrame([(PAGE, html)], "url string, html string"))


def read(spark, html, column):
    return nodes(spark, html).select(column.alias("v")).first().v


def test_unclosed_elements_are_repaired(spark):
    html = "<div><p>one<b>two<p>three</div>tail<ul><li>a<li>b</ul>"
    texts = F.transform(M.select("nodes", ("p", "li")), lambda n: M.node_text("nodes", n))
    assert read(spark, html, texts) == ["onetwo", "three", "a", "b"]


def test_nested_details_restore_the_outer_volume(spark):
    html = ("<div id=c><p>Zero</p><a href='/f/1/10.html'>t0</a><h2>One</h2><a href='/f/1/11.html' data-title='D'>x</a>"
            "<details><summary>Two</summary><a href='/f/1/12.html'>t2</a><h3>Deep</h3><a href='/f/1/13.html'>t3</a></details>"
            "<a href='https://k.example.com/f/1/14.html?x'>t4</a><p>Late</p><a href='/f/1/15.html'>t5</a><a href='/no'>n</a></div>")
    got = read(spark, html, M.chapter_links("nodes", M.first(M.select("nodes", id="c")), r"^/f/\d+/(\d+)\.html$"))
    assert [(c.id, c.title, c.volume) for c in got] == [
        ("10", "t0", "Zero"), ("11", "D", "One"), ("12", "t2", "Two"), ("13", "t3", "Deep"), ("14", "t4", "One"), ("15", "t5", "One")]


def test_visible_text_skips_scripts(spark):
    html = "<article>a<script>var x='<p>';</script><br>b<p>c<noscript>n</noscript></p>d</article>"
    assert read(spark, html, M.chapter_text("nodes", M.first(M.select("nodes", "article")))) == "a\nbc\nd\n"


def test_images_prefer_lazy_attributes(spark):
    html = "<div><img src='s.png' data-original=' /o.png'><img srcset='//c/x.png 1x, y'><img src='/o.png'><img></div>"
    assert read(spark, html, M.image_sources("nodes", M.first(M.select("nodes", "div")), "url")) == ["https://h.example.com/o.png", "https://c/x.png"]


def test_lists_that_do_not_fit_give_no_titles(spark):
    df = spark.createDataFrame([("x='1,2,3'.split(',');y=\"a,b\".split(',')",), ("x='1,2'.split(',');y='a,b'.split(',')",), ("none",)], "m string")
    assert [r.v for r in df.select(M.zipped_titles("m").alias("v")).collect()] == [{"1": "a", "2": "b"}, None, None]


def test_locked_chapters_and_fallback_ids(spark):
    payload = ('{"data":{"vs":[{"vN":"","cs":[{"id":1,"cN":"a"},{"cU":"/c/9/","cN":"b"},{"id":3,"isVip":true,"cN":"c"}]},'
               '{"vN":"VIP卷","cs":[{"id":4,"cN":"d"}]}]}}')
    df = spark.createDataFrame([("b", payload)], "book string, p string")
    rows = volume_catalog(df, "p", ["book"]).orderBy("volume_pos", "item_pos").collect()
    assert [(r.chapter_id, r.volume) for r in rows] == [("1", "卷 1"), ("9", "卷 1")]
    assert volume_catalog(df, "p", ["book"], include_locked=True).count() == 4


def test_own_host_rules_come_before_rules_for_any_host(spark):
    rules = spark.createDataFrame(
        [("b-site", "b.example.com", r"^/n/(\d+)/(\d+)\.html$", 1, 2, 1, False), ("b-site", "b.example.com", r"^/n/(\d+)\.html$", 1, 0, 2, False),
         ("a-site", "a.example.com", r"^/n/(\d+)", 1, 0, 1, True)],
        "site string, host string, path_regex string, book_group int, chapter_group int, priority int, any_host boolean")
    urls = spark.createDataFrame([("https://www.b.example.com/n/5/6.html",), ("b.example.com/n/5.html?x",), ("http://z.example.com/n/8",), ("http://z.example.com/q",)], "url string")
    got = {r.url: (r.site, r.book_id, r.chapter_id) for r in resolve_urls(urls, rules).collect()}
    assert list(got.values()) == [got[u] for u in got]
    assert got["https://www.b.example.com/n/5/6.html"] == ("b-site", "5", "6")
    assert got["b.example.com/n/5.html?x"] == ("b-site", "5", "")
    assert got["http://z.example.com/n/8"] == ("a-site", "8", "")
    assert got["http://z.example.com/q"] == (None, None, None)


CH = "site string, book_id string, chapter_id string, title string, content string, url string, order_index int, downloaded boolean"


def test_stored_bodies_are_reused_only_when_usable(spark):
    plan = spark.createDataFrame([("s", "b", str(i), "" if i == 1 else f"p{i}", "", "", i, False) for i in range(1, 5)], CH)
    stored = spark.createDataFrame([("s", "b", "1", "old1", "normal content", "", 1, True), ("s", "b", "2", "old2", "before\n\n[插图]\n\nafter", "", 2, True),
                                    ("s", "b", "3", "x", "first", "", 3, True), ("s", "b", "3", "y", "last", "", 9, True)], CH)
    merged = {r.chapter_id: (r.title, r.content, r.downloaded) for r in L.merge_stored(plan, stored).collect()}
    assert merged == {"1": ("old1", "normal content", True), "2": ("p2", "", False), "3": ("p3", "last", True), "4": ("p4", "", False)}
    assert sorted(r.chapter_id for r in L.pending(L.merge_stored(plan, stored)).collect()) == ["2", "4"]
    assert sorted(r.chapter_id for r in L.pending_chapters(plan, stored).collect()) == ["2", "4"]


def test_chapter_ranges(spark):
    chapters = spark.createDataFrame([("s", b, str(i), "t", "", "", i, False) for b in "abcd" for i in range(1, 6)], CH)
    requests = spark.createDataFrame([("s", "a", "2", "4", ["3"]), ("s", "b", "4", "2", []), ("s", "c", "x", "3", []), ("s", "d", "", "", ["5"])],
                                     "site string, book_id string, start_id string, end_id string, ignore_ids array<string>")
    got = {}
    for r in L.chapter_range(chapters, requests).orderBy("book_id", "order_index").collect():
        got.setdefault(r.book_id, []).append(r.chapter_id)
    assert got == {"a": ["2", "4"], "b": ["2", "3", "4"], "c": ["1", "2", "3"], "d": ["1", "2", "3", "4"]}


def test_stage_state_after_removals(spark):
    log = [("s", "b", st, i, op) for i, (st, op) in enumerate([("raw", "commit"), ("clean", "commit"), ("x", "commit"), ("raw", "commit"), ("raw", "remove"), ("x", "remove")])]
    log += [("s", "c", "raw", 1, "commit"), ("s", "c", "raw", 2, "remove")]
    df = spark.createDataFrame(log, "site string, book_id string, stage string, seq int, op string")
    got = {r.book_id: (r.latest_stage, r.stages) for r in L.stage_state(df).collect()}
    assert got == {"b": ("clean", ["clean"]), "c": ("", [])}
