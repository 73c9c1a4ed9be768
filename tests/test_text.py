import pytest
from pyspark.sql import functions as F

from folioflow.functions import blocks as B
from folioflow.functions import labels
from folioflow.functions import text as T
from folioflow.functions import urls as U
from folioflow.operators import lines as L


def value(spark, column, **fields):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()], F.lit(0).alias("_"))
    return df.select(column.alias("v")).first().v


CASES = [
    (lambda: T.trim_u("x"), " 　 a b \n", "a b"),
    (lambda: T.clean_text("x"), "  a\t b \r\n\n 　 \n c d \n", "a b\nc d"),
    (lambda: T.clean_text("x"), "a\rb", "ab"),
    (lambda: T.compact_whitespace("x"), " a \n\t b c ", "a b c"),
    (lambda: T.norm("x"), "Ab-1 主！é_٣", "ab1主é٣"),
    (lambda: T.norm_index("x"), "妳 祢们", "你你们"),
    (lambda: T.cleaner("x", True), "​ a\r\nb\rc﻿ ", "a\nb\nc"),
    (lambda: T.html_escape("x"), "<a b=\"1\">'&'</a>", "&lt;a b=&#34;1&#34;&gt;&#39;&amp;&#39;&lt;/a&gt;"),
    (lambda: T.file_name("x"), ' a/\\:b?"c ', "a_b_c"),
    (lambda: T.file_name("x"), "  ", "book"),
    (lambda: T.store_name("x"), "a/:b", "a__b"),
    (lambda: T.store_name("x"), " ", "unknown"),
    (lambda: T.strip_category("x"), " [玄幻] 书名 ", "书名"),
    (lambda: T.strip_category("x"), "[open", "[open"),
    (lambda: T.clean_author("x"), "作者：某人作品全集", "某人"),
    (lambda: T.trim_summary_tail("x", F.lit("书")), "简介 [最新书评] 喜欢《书》", "简介"),
    (lambda: T.labelled_field("x", "作者", ["状态"]), "书名：T 作者：甲 状态：完", "甲"),
    (lambda: T.unescape_newlines("x"), r"a\r\nb\n\nc\rd", "a\nb\nc\nd"),
    (lambda: T.strip_nested_html("x"), "<html><HEAD>x</head><body>a</body></html>", "a"),
    (lambda: T.strip_nested_html("x"), "</head>a<head>b</head>c", "</head>a<head>b</head>c"),
    (lambda: T.truncate_chars("x", 5), "主角出场了吗", "主角..."),
    (lambda: T.strip_leading_title("x", F.lit("Chapter  One")), "\n CHAPTER ONE \nbody", "body"),
    (lambda: T.strip_leading_title("x", F.lit("Other")), " Chapter\nbody", "Chapter\nbody"),
    (lambda: B.inline_images("x"), "![a](u.png) <IMG src='s.png' data-src=\"&quot;d.png\"> ![b](javascript:x)", ["u.png", "d.png"]),
    (lambda: B.txt_body("x"), "a\n b\n\n[图片] https://i/x.png\n\ndata ![z](data:image/png;base64,AA)", "    a\n\n\n    b\n\n\n[图片] https://i/x.png\n\n\n[图片] 内嵌图片\n\n\n    data"),
    (lambda: B.image_placeholder("x"), " ", "[图片]"),
    (lambda: labels.eta_label(F.col("x").cast("double")), "3725.9", "1小时2分"),
    (lambda: labels.elapsed_label(F.col("x").cast("double")), "3725.9", "1小时2分5秒"),
    (lambda: U.with_scheme("x"), " h.example.com/a", "https://h.example.com/a"),
    (lambda: U.book_id_from_url("x"), "https://h/x/Info/42/7.html", "42"),
    (lambda: U.book_id_from_url("x"), "https://h/x/../", "x"),
    (lambda: L.is_reusable("x"), "before\n\n[插图]\n\nafter", False),
    (lambda: L.is_reusable("x"), "[图片] https://x", False),
    (lambda: L.is_reusable("x"), "第一段正文", True),
    (lambda: L.is_reusable("x"), "​‌﻿", False),
    (lambda: L.is_reusable("x"), "text [图片] inside a line", True),
    (lambda: L.is_reusable_for("x", 20), "短句", False),
    (lambda: L.is_reusable_for("x", 0), "短句", True),
    (lambda: L.is_lookalike_line("x"), "8NovEL.CoX", True),
    (lambda: L.is_page_indicator("x"), " 第(1/3)页", True),
    (lambda: L.error_class("x"), "read: connection reset by peer", "retry"),
    (lambda: L.error_class("x"), "http 410 gone", "gone"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_text_functions(spark, case):
    make, given, want = CASES[case]
    assert value(spark, make(), x=given) == want


@pytest.mark.parametrize("raw,want", [
    ("/a", "https://h.example.com/a"), ("b.html", "https://h.example.com/x/b.html"), ("../c?q=1", "https://h.example.com/c?q=1"),
    ("./d/../e/", "https://h.example.com/x/e/"), ("//o.example.com/z", "https://o.example.com/z"), ("?p=2", "https://h.example.com/x/y?p=2"),
    ("http://k.example.com", "http://k.example.com"), (" ", ""), ("mailto:a@b", "mailto:a@b"), ("..", "https://h.example.com/"), ("#f", "https://h.example.com/x/y#f")])
def test_absolute_urls_follow_the_standard(spark, raw, want):
    from urllib.parse import urljoin
    base = "https://h.example.com/x/y"
    assert value(spark, U.absolute_url("b", "r"), b=base, r=raw) == want
    if raw.strip() and not raw.startswith("//"):
        assert urljoin(base, raw) == want


@pytest.mark.parametrize("a,b,want", [("1.2.10", "1.2.9", 1), ("1.2", "1.2.0", 0), ("1.2-rc1", "1.2.1", -1), ("", "0.1", -1), ("v1", "0", 0)])
def test_versions(spark, a, b, want):
    assert value(spark, T.version_compare("a", "b"), a=a, b=b) == want


def test_book_uuid_is_name_based(spark):
    import hashlib
    import uuid
    want = str(uuid.UUID(bytes=hashlib.sha1("s:7:名".encode()).digest()[:16], version=5))
    assert value(spark, labels.book_uuid("s", "i", "t"), s="s", i="7", t="名") == want


def test_blocks_keep_image_and_text_order(spark):
    got = value(spark, B.chapter_blocks("x"), x="a\n[插圖] u1\nb ![m](u2)\n\n \n\nc")
    assert [(b.kind, b.paragraph, b.image_url) for b in got] == [
        ("image", "", "u1"), ("image", "", "u2"), ("text", "a\nb", ""), ("text", "c", "")]
