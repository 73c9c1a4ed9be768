"""Cases in which an operator could answer plausibly and wrongly."""

from folioflow.functions import convert
from folioflow.operators import library as L
from folioflow.operators import shelf as S


def test_fallback_chapter_comes_before_the_first_match(spark):
    kind = "site string, book_id string, chapter_id string, url string, title string, order_index long, position long"
    chapters = spark.createDataFrame([("s", "b", "1", "u", "A", 1, 0), ("s", "b", "2", "u", "B", 2, 1), ("s", "b", "3", "v", "C", 3, 2)], kind)
    asked = spark.createDataFrame([(1, "s", "b", "", "u", "", 0, 1), (2, "s", "b", "", "u", "", 0, 2), (3, "s", "b", "", "x", "", 0, 9), (4, "s", "none", "", "u", "", 0, 4)],
                                  "request_id long, site string, book_id string, chapter_id string, url string, title string, order_index long, fallback_index long")
    assert {r.request_id: r.matched_index for r in L.same_chapter(asked, chapters).collect()} == {1: 1, 2: 0, 3: 2, 4: 0}


def test_an_empty_end_is_the_end_of_the_list(spark):
    chapters = spark.createDataFrame([("s", "b", c, i) for i, c in enumerate(["a", "", "c"], 1)], "site string, book_id string, chapter_id string, order_index int")
    asked = spark.createDataFrame([("s", "b", "", "c", ["x"])], "site string, book_id string, start_id string, end_id string, ignore_ids array<string>")
    assert sorted(r.order_index for r in L.chapter_range(chapters, asked).collect()) == [1, 2, 3]


def test_phrases_are_converted_in_arrays(spark):
    df = spark.createDataFrame([(["頭髮", None, "髮"], "頭髮"), ([], ""), (None, None)], "tags array<string>, title string")
    got = convert.convert_columns(df, "zh-cn", {"頭髮": "头发", "髮": "发"}, ["title"], ["tags"]).collect()
    assert [(r.tags, r.title) for r in got] == [(["头发", None, "发"], "头发"), ([], ""), (None, None)]


def test_patches_reach_every_field(spark):
    items = spark.createDataFrame([(1, None, "t", "n", "u", "r", None)], "item_id long, parent_id long, title string, name string, source_url string, last_read_chapter_id string, last_read_at string")
    patches = spark.createDataFrame([(1, 1, None, False, " N ", None, " c9", "2024"), (2, 1, None, False, None, "U", None, None)],
                                    "seq long, item_id long, parent_id long, clear_parent boolean, name string, source_url string, last_read_chapter_id string, last_read_at string")
    r = S.fold_patches(items, patches).first()
    assert (r.title, r.name, r.source_url, r.last_read_chapter_id, r.last_read_at) == ("t", "N", "U", "c9", "2024")


def test_trees_deeper_than_any_cap(spark):
    n = 70
    items = spark.createDataFrame([(i, i - 1 if i else None, "folder", False, None) for i in range(n)], "item_id long, parent_id long, kind string, implicit boolean, last_read_at string")
    assert S.descendants(items, items.filter("item_id = 0")).count() == n - 1
    deepest = S.breadcrumbs(items).filter(f"item_id = {n - 1}").first()
    assert deepest.path == list(range(n)) and not deepest.cycle
