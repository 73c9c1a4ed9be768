import io
import zipfile

from pyspark.sql import functions as F

from folioflow.operators import shelf as S
from folioflow.sources import library_store as LS
from folioflow.sources import publish as P

BOOKS = "site string, book_id string, title string, author string, description string, source_url string, cover_url string"
CHAPTERS = "site string, book_id string, chapter_id string, title string, content string, url string, volume string, order_index int, downloaded boolean"


def library(spark, n=3):
    books = spark.createDataFrame([("s", "b", "Book & Co", "Ann", "one\ntwo", "", "/c.png")], BOOKS)
    chapters = spark.createDataFrame([("s", "b", str(i), f"Ch {i}", f"text {i}\n\n[图片] /i{i}.png", "", "", i, True) for i in range(1, n + 1)], CHAPTERS)
    return books, chapters


def test_txt_layout(spark):
    books, chapters = library(spark, 1)
    body = P.txt_parts(books, chapters).first().body
    assert body == "Book & Co\nAuthor: Ann\n\none\ntwo\n\n\n# Ch 1\n\n    text 1\n\n\n[图片] /i1.png\n"


def test_parts_of_a_large_book_join_to_the_whole(spark):
    books, chapters = library(spark, 7)
    for make in (P.txt_parts, P.html_parts):
        [whole] = [r.body for r in make(books, chapters).collect()]
        parts = make(books, chapters, 150).orderBy("part").collect()
        assert len(parts) > 1 and "".join(p.body for p in parts) == whole and (make is P.txt_parts or whole.endswith("</article></body></html>"))
        # a part begins with what passes its bound, so it holds little more than the bound
        assert all(len(p.body.encode()) < 150 + 400 for p in parts)


def test_a_book_of_many_chapters_is_one_volume(spark):
    books, chapters = library(spark, 2500)
    assets = spark.createDataFrame([("/i7.png", "image/png", bytearray(b"seven"))], "url string, media_type string, data binary")
    again = chapters.withColumn("content", F.when(F.col("order_index") % 5 == 0, F.lit("[图片] /i7.png")).otherwise(F.col("content")))
    volumes = P.epub_parts(books, again, assets, "2024-01-01T00:00:00Z")
    entries = P.volume_entries(volumes).collect()
    assert {r.part for r in entries} == {0} and sum(r.entry.endswith(".xhtml") for r in entries) == 2502
    assert [r.bytes for r in entries if r.entry.startswith("OEBPS/pictures")] == [5]


def test_epub_volume(spark):
    books, chapters = library(spark, 5)
    assets = spark.createDataFrame([("/c.png", "image/png", bytearray(b"cover")), ("/i2.png", "image/png", bytearray(b"two"))], "url string, media_type string, data binary")
    parts = P.epub_parts(books, chapters, assets, "2024-01-01T00:00:00Z", part_bytes=96).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1]
    z = zipfile.ZipFile(io.BytesIO(bytes(parts[0].content)))
    first = z.infolist()[0]
    assert (first.filename, first.compress_type, z.read("mimetype")) == ("mimetype", zipfile.ZIP_STORED, b"application/epub+zip")
    names = z.namelist()
    assert {"META-INF/container.xml", "OEBPS/book.opf", "OEBPS/toc.xhtml", "OEBPS/sheet.css", "OEBPS/about.xhtml", "OEBPS/c1.xhtml"} <= set(names)
    opf = z.read("OEBPS/book.opf").decode()
    assert "Book &amp; Co" in opf and 'properties="cover-image"' in opf and opf.count("<itemref") == 5
    assert "<img " in z.read("OEBPS/c2.xhtml").decode()
    assert "[图片] /i1.png" in z.read("OEBPS/c1.xhtml").decode()
    second = zipfile.ZipFile(io.BytesIO(bytes(parts[1].content)))
    assert "OEBPS/c5.xhtml" in second.namelist() and second.testzip() is None


def test_missing_bodies_and_embedded_images(spark):
    books = spark.createDataFrame([("s", "b", "T", "A", None, "", None)], BOOKS)
    chapters = spark.createDataFrame([("s", "b", "1", "One", None, "", "", 1, True), ("s", "b", "2", "Two", "x\n\n[图片] data:image/png;base64,aGk=", "", "", 2, True)], CHAPTERS)
    assets = spark.createDataFrame([], "url string, media_type string, data binary")
    z = zipfile.ZipFile(io.BytesIO(bytes(P.epub_parts(books, chapters, assets, "2024-01-01T00:00:00Z").first().content)))
    assert z.read("OEBPS/pictures/p1") == b"hi" and "base64" not in z.read("OEBPS/c2.xhtml").decode()
    assert "# One" in P.txt_parts(books, chapters).first().body and "<h2>One</h2>" in P.html_parts(books, chapters).first().body


def test_names_and_formats(spark):
    df = spark.createDataFrame([("7", "标题", "", "https://h/book/9/")], "i string, t string, a string, u string")
    name = lambda tpl, stamp=None: df.select(P.output_name(tpl, F.lit("epub"), F.lit("s"), F.col("i"), F.col("t"), F.col("a"), F.col("u"), stamp).alias("n")).first().n
    assert name(None) == "标题_unknown.epub"
    assert name("{site}-{book_id}", "20240101_000000") == "s-7_20240101_000000.epub"


def test_files_are_written(spark, tmp_path):
    books, chapters = library(spark, 1)
    parts = P.txt_parts(books, chapters).withColumn("name", F.concat("site", F.lit("/x.txt")))
    P.write_files(parts, str(tmp_path), "body")
    assert (tmp_path / "s" / "x.txt").read_text().startswith("Book & Co\n")


def test_stage_store_replaces_a_stage_and_keeps_retries_single(spark, tmp_path):
    books, chapters = library(spark, 3)
    books = books.selectExpr("*", "array('t') AS tags", "timestamp'2024-01-01' AS downloaded_at", "timestamp'2024-01-01' AS updated_at")
    root = str(tmp_path)
    LS.save_stage(root, "raw", 1, books, chapters)
    LS.save_stage(root, "raw", 2, books, chapters.filter("order_index < 3"))
    LS.save_stage(root, "raw", 2, books, chapters.filter("order_index < 3"))
    assert [r.chapter_id for r in LS.load_chapters(spark, root, "raw").orderBy("order_index").collect()] == ["1", "2"]
    LS.save_stage(root, "clean", 3, books, chapters)
    assert LS.load_chapters(spark, root).select("stage").distinct().first().stage == "clean"
    assert LS.load_books(spark, root, "raw").count() == 1


def test_parent_cycles_are_reported(spark):
    items = spark.createDataFrame([(1, 2, "folder"), (2, 1, "folder"), (3, None, "folder"), (4, 3, "book"), (5, 99, "book")], "item_id long, parent_id long, kind string")
    got = {r.item_id: (r.path, r.cycle) for r in S.breadcrumbs(items).collect()}
    assert got[4] == ([3, 4], False) and got[1][1] and got[2][1]


def test_read_books_survive_deletion_as_history(spark):
    items = spark.createDataFrame([(1, None, "folder", False, None), (2, 1, "book", False, "2024-01-01"), (3, 1, "book", False, None), (4, None, "book", False, None)],
                                  "item_id long, parent_id long, kind string, implicit boolean, last_read_at string")
    got = {r.item_id: (r.parent_id, r.implicit) for r in S.delete_items(items, items.filter("item_id = 1")).collect()}
    assert got == {2: (None, True), 4: (None, False)}


EVENTS = ("seq long, ts timestamp, op string, site string, book_id string, parent_id long, title string, author string, cover_url string, description string, "
          "latest_chapter string, source_url string, chapter_id string, chapter_index int, chapter_title string")


def test_progress_on_an_unknown_book_makes_a_hidden_row(spark):
    import datetime as dt
    ev = lambda seq, op, title, latest="", index=0: (seq, dt.datetime(2024, 1, seq), op, "s", "b", None, title, "", "", "", latest, "", f"c{seq}", index, "")
    one = S.fold_books(spark.createDataFrame([ev(1, "progress", " ", index=-3)], EVENTS)).first()
    assert (one.title, one.implicit, one.last_read_chapter_id, one.last_read_chapter_index) == ("b", True, "c1", 0)
    two = S.fold_books(spark.createDataFrame([ev(1, "progress", ""), ev(2, "add", "Late", "L2"), ev(3, "add", "x", " ")], EVENTS)).first()
    assert (two.title, two.implicit, two.latest_chapter, two.last_read_chapter_id) == ("b", False, "L2", "c1")
