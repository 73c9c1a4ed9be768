"""Publishing: file names, formats, and TXT, HTML and EPUB output.

A book is written in parts that begin every `PART_BYTES` of its text, because one book may be as large
as the library.  The TXT and HTML parts of a book joined in order are exactly the whole file; each EPUB
part is a complete volume.  Books below that size have one part.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import PLACEHOLDER, chapter_blocks, txt_body
from ..functions.labels import book_uuid
from ..functions.text import fallback, file_name, html_escape, html_escape_breaks
from ..functions.urls import book_id_from_url, usable_metadata
from ..operators.library import BOOK
from ..plans.ordering import block_of, join_text, running

PART_BYTES = 64 << 20
BLOCK_ROWS = 10_000
# Formats, default name template and names, style and words of the layouts.
FORMATS = ("txt", "html", "epub")
NAME_TEMPLATE = "{title}_{author}"
HTML_STYLE = ("body{font-family:Georgia,serif;max-width:900px;margin:40px auto;padding:0 16px;line-height:1.8;}h1,h2{line-height:1.2;}"
              "article{margin:24px 0 40px;}pre{white-space:pre-wrap;font-family:inherit;}")
INFO_TITLE, INTRO_TITLE, LANGUAGE = "书籍信息", "简介", "zh-CN"
MIMETYPE = "application/epub+zip"


def output_name(template: str | None, fmt: Column, site: Column, book_id: Column, title: Column, author: Column,
                source_url: Column, stamp: str | None = None) -> Column:
    """File name from a template; metadata that looks like a path is ignored.  The time stamp is an
    argument, so a rerun writes the same names."""
    own_id = usable_metadata(book_id)
    bid = F.when(own_id != "", own_id).otherwise(book_id_from_url(source_url))
    clean_title, clean_author = usable_metadata(title), usable_metadata(author)
    name = F.lit(template if template and template.strip() else NAME_TEMPLATE)
    for key, value in (("{title}", F.when(clean_title != "", clean_title).otherwise(fallback(bid, F.lit("book")))),
                       ("{author}", F.when(clean_author != "", clean_author).otherwise(F.lit("unknown"))),
                       ("{site}", fallback(site, F.lit("site"))), ("{book_id}", fallback(bid, F.lit("id")))):
        name = F.replace(name, F.lit(key), value)
    named = file_name(name)
    if stamp:
        named = F.concat(named, F.lit("_" + stamp))
    return F.concat(named, F.lit("."), F.when(fmt.isin("epub", "html"), fmt).otherwise(F.lit("txt")))


def format_requests(books: DataFrame, requested: str, configured: str) -> DataFrame:
    """One row per book and format: the requested list, else the configured one, else txt.
    `supported` is false for unknown formats, which belong in an error table."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    wanted = F.when(~empty(requested), F.col(requested)).when(~empty(configured), F.col(configured)).otherwise(F.array(F.lit("txt")))
    names = F.filter(F.transform(wanted, lambda f: F.lower(F.btrim(f))), lambda f: f != "")
    return (books.withColumn("format", F.explode(names))
            .withColumn("supported", F.col("format").isin(*FORMATS)))


def with_parts(rows: DataFrame, size: Column, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add the `part` of each row of a book: how often `part_bytes` go into what stands before it."""
    sized = rows.withColumn("_size", size.cast("bigint"))
    upto = running(sized, BOOK, "order_index", block_of("order_index", BLOCK_ROWS), _upto=("sum", F.col("_size")))
    return upto.withColumn("part", F.floor((F.col("_upto") - F.col("_size")) / part_bytes).cast("int")).drop("_size", "_upto")


def _without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """A missing text is an empty one: its chapter or book is still written."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def txt_parts(books: DataFrame, chapters: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(site, book_id, part, body) of the plain-text layout; chapters numbered from 1."""
    books, chapters = _without_nulls(books, "title", "author", "description"), _without_nulls(chapters, "title", "content")
    about = F.when(F.col("description") != "", F.concat(F.lit("\n"), F.col("description"), F.lit("\n"))).otherwise(F.lit(""))
    head = books.select(*BOOK, F.lit(0).cast("bigint").alias("order_index"), F.concat(
        F.col("title"), F.lit("\nAuthor: "), F.col("author"), F.lit("\n"), about).alias("text"))
    body = chapters.select(*BOOK, F.col("order_index").cast("bigint"), F.concat(
        F.lit("\n\n# "), F.col("title"), F.lit("\n\n"), txt_body("content"), F.lit("\n")).alias("text"))
    rows = with_parts(head.unionByName(body), F.octet_length("text"), part_bytes)
    return join_text(rows, BOOK, "order_index", "text", "", F.col("part"))


def html_parts(books: DataFrame, chapters: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(site, book_id, part, body) of the HTML layout; chapters numbered from 1."""
    books, chapters = _without_nulls(books, "title", "author", "description"), _without_nulls(chapters, "title", "content")
    about = F.when(F.col("description") != "", F.concat(
        F.lit('<p style="white-space:pre-line;">'), html_escape_breaks("description"), F.lit("</p>"))).otherwise(F.lit(""))
    head = books.select(*BOOK, F.lit(0).cast("bigint").alias("order_index"), F.concat(
        F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), html_escape("title"), F.lit(f"</title><style>{HTML_STYLE}</style></head><body><h1>"),
        html_escape("title"), F.lit("</h1><p><strong>"), html_escape("author"), F.lit("</strong></p>"), about).alias("text"))
    body = chapters.select(*BOOK, F.col("order_index").cast("bigint"), F.concat(
        F.lit("<article><h2>"), html_escape("title"), F.lit("</h2><pre>"), html_escape("content"), F.lit("</pre></article>")).alias("text"))
    last = chapters.groupBy(*BOOK).agg(F.max("order_index").cast("bigint").alias("_n"))
    tail = (books.select(*BOOK).join(last, BOOK, "left")
            .select(*BOOK, (F.coalesce("_n", F.lit(0)) + 0.5).alias("order_index"), F.lit("</body></html>").alias("text")))
    rows = head.unionByName(body).withColumn("order_index", F.col("order_index").cast("double")).unionByName(tail)
    # the tail sits half a step after the last chapter
    return join_text(with_parts(rows, F.octet_length("text"), part_bytes), BOOK, "order_index", "text", "", F.col("part"))


# ---- EPUB -----------------------------------------------------------------------------------------
# Built as element trees from the EPUB 3 specification; only the mimetype entry and the container path
# are prescribed.

XHTML, OPF, DC, OPS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/ops"
OCF = "urn:oasis:names:tc:opendocument:xmlns:container"
SHEET = "p.line{margin:0;text-indent:1.5em} div.picture{margin:1em 0;text-align:center} img{max-width:100%}"


def _node(tag: str, *inside: ET.Element | str | None, **attributes: str) -> ET.Element:
    """An element with its text or children; an attribute `epub_type` gets its namespace."""
    node = ET.Element(tag, {(f"{{{OPS}}}type" if k == "epub_type" else k.rstrip("_").replace("_", "-")): v for k, v in attributes.items()})
    for part in inside:
        if isinstance(part, str):
            node.text = (node.text or "") + part
        elif part is not None:
            node.append(part)
    return node


def _document(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def _xhtml(title: str, *inside: ET.Element | None) -> bytes:
    head = _node("head", _node("title", title), _node("link", rel="stylesheet", type="text/css", href="sheet.css"))
    return _document(_node("html", head, _node("body", *inside), xmlns=XHTML))


def _clean(text: str | None) -> str:
    """Text without characters that XML forbids."""
    return re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", text or "")


class _Pictures:
    """The image files of a volume by URL; embedded data images become files of their own."""

    def __init__(self, rows: list):
        self.files: dict[str, tuple[str, str, bytes]] = {}
        for row in rows:
            for image in row.images:
                self.add(image["url"], image["media_type"], bytes(image["data"]))

    def add(self, url: str, media: str, data: bytes) -> None:
        self.files.setdefault(url, (f"pictures/p{len(self.files) + 1}", media, data))

    def find(self, url: str) -> str | None:
        """Path of a picture, if its bytes are at hand."""
        if url not in self.files and (m := re.fullmatch(r"(?is)data:(image/[\w.+-]+)(?:;[^,;]+)*;base64,(.*)", url)):
            try:
                self.add(url, m[1].lower(), base64.b64decode(re.sub(r"\s+", "", m[2]), validate=True))
            except ValueError:
                return None
        return self.files[url][0] if url in self.files else None


def _block(block: dict, pictures: _Pictures, alt: str) -> Iterator[ET.Element]:
    if block["kind"] == "text":
        for line in _clean(block["paragraph"]).split("\n"):
            if line.strip():
                yield _node("p", line.strip(), class_="line")
    elif path := pictures.find(block["image_url"] or ""):
        yield _node("div", _node("img", src=path, alt=alt), class_="picture")
    else:
        yield _node("p", PLACEHOLDER + " " + _clean(block["image_url"]), class_="line")


def _volume(rows: list) -> bytes:
    """One EPUB from the rows of one part: the row of order 0 stands for the book, the others are its
    chapters in order with their blocks and images."""
    book, pictures = rows[0], _Pictures(rows)
    title, about = _clean(book.book_title), _clean(book.book_description).strip()
    cover = pictures.find(book.cover_url or "")
    # documents in reading order: (id, heading, bytes)
    documents = [("about", INFO_TITLE, _xhtml(
        title, _node("div", _node("img", src=cover, alt=title), class_="picture") if cover else None, _node("h1", title), _node("p", _clean(book.book_author)),
        *([_node("h2", INTRO_TITLE), *(_node("p", line, class_="line") for line in about.split("\n"))] if about else [])))]
    for row in rows:
        if row.order_index > 0:
            heading = _clean(row.title)
            inside = [x for block in ([] if row.blocks is None else row.blocks) for x in _block(block, pictures, heading)]
            documents.append((f"c{int(row.order_index)}", heading, _xhtml(heading, _node("h2", heading), *inside)))
    manifest = [_node("item", id="toc", href="toc.xhtml", media_type="application/xhtml+xml", properties="nav"), _node("item", id="sheet", href="sheet.css", media_type="text/css")]
    manifest += [_node("item", id=i, href=f"{i}.xhtml", media_type="application/xhtml+xml") for i, _, _ in documents]
    for path, media, _ in pictures.files.values():
        item = _node("item", id=path.rpartition("/")[2], href=path, media_type=media)
        if path == cover:
            item.set("properties", "cover-image")
        manifest.append(item)
    facts = [_node("dc:identifier", f"urn:uuid:{book.uuid}", id="uid"), _node("dc:title", title), _node("dc:language", LANGUAGE), _node("dc:creator", _clean(book.book_author)),
             _node("meta", book.date, property="dcterms:modified")]
    package = _node("package", _node("metadata", *facts, **{"xmlns:dc": DC}), _node("manifest", *manifest), _node("spine", *(_node("itemref", idref=i) for i, _, _ in documents)),
                    xmlns=OPF, version="3.0", unique_identifier="uid")
    contents = _node("nav", _node("ol", *(_node("li", _node("a", heading or i, href=f"{i}.xhtml")) for i, heading, _ in documents)), epub_type="toc")
    container = _node("container", _node("rootfiles", _node("rootfile", full_path="OEBPS/book.opf", media_type="application/oebps-package+xml")), xmlns=OCF, version="1.0")
    entries = [("META-INF/container.xml", _document(container)), ("OEBPS/book.opf", _document(package)), ("OEBPS/toc.xhtml", _xhtml(title, contents)), ("OEBPS/sheet.css", SHEET.encode()),
               *((f"OEBPS/{i}.xhtml", page) for i, _, page in documents), *((f"OEBPS/{path}", data) for path, _, data in pictures.files.values())]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in [("mimetype", MIMETYPE.encode()), *entries]:
            z.writestr(zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Volumes from rows sorted by (site, book, part, order): one part is held at a time."""
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    for (site, book_id, part), group in groupby(rows, key=lambda r: (r.site, r.book_id, r.part)):
        yield pd.DataFrame({"site": [site], "book_id": [book_id], "part": [part], "content": [_volume(list(group))]})


def epub_parts(books: DataFrame, chapters: DataFrame, assets: DataFrame, date: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(site, book_id, part, content) with one EPUB volume per part.

    `assets` is a table (url, media_type, data) of ready images; images without an asset stay text
    placeholders.  Chapters are numbered from 1.  Parsing to blocks happens before the shuffle, and
    the packer gets at most one part of one book.
    """
    chapters = _without_nulls(chapters, "title", "content")
    info = books.select(
        *BOOK, fallback("title", "book_id").alias("book_title"), fallback("author", F.lit("unknown")).alias("book_author"),
        F.col("description").alias("book_description"), F.coalesce("cover_url", F.lit("")).alias("cover_url"),
        book_uuid("site", "book_id", "title").alias("uuid"))
    placed = with_parts(chapters.select(*BOOK, F.col("order_index").cast("bigint"), "title", "content"), F.octet_length("content"), part_bytes)
    rows = placed.select(*BOOK, "part", "order_index", "title", chapter_blocks("content").alias("blocks"),
                         F.col("content").rlike(r"(?i)!\[|<img|\[(?:插图|插圖|图片|圖片|\?\?)\]").alias("_marked"))
    # a row without chapter carries the cover to every part of its book
    covers = (info.select(*BOOK, "cover_url").join(placed.select(*BOOK, "part").distinct(), BOOK, "left")
              .select(*BOOK, F.coalesce("part", F.lit(0)).alias("part"), "cover_url"))
    # bodies without any image mark are not parsed a second time
    marked = rows.filter(F.col("_marked")).select(*BOOK, "part", "order_index", F.explode("blocks").alias("b"))
    wanted = (marked.filter(F.col("b.kind") == "image")
              .select(*BOOK, "part", F.col("b.image_url").alias("url"), "order_index")
              .unionByName(covers.filter("cover_url <> ''").select(*BOOK, "part", F.col("cover_url").alias("url"), F.lit(0).cast("bigint").alias("order_index")))
              # an image comes once a volume, with the first chapter that shows it
              .groupBy(*BOOK, "part", "url").agg(F.min("order_index").alias("order_index")).join(assets, "url")
              .groupBy(*BOOK, "part", "order_index").agg(F.collect_list(F.struct("url", "media_type", "data")).alias("images")))
    heads = covers.select(*BOOK, "part", F.lit(0).cast("bigint").alias("order_index"), F.lit("").alias("title"),
                          F.array().cast("array<struct<kind:string,paragraph:string,image_url:string>>").alias("blocks"))
    full = (rows.select(*heads.columns).unionByName(heads).join(wanted, [*BOOK, "part", "order_index"], "left")
            .join(info, BOOK).withColumn("images", F.coalesce("images", F.array().cast("array<struct<url:string,media_type:string,data:binary>>")))
            .withColumn("date", F.lit(date)))
    types = {f.name: f.dataType.simpleString() for f in full.schema.fields}

    keys = [*BOOK, "part"]
    ordered = full.repartition(*keys).sortWithinPartitions(*keys, "order_index")
    return ordered.mapInPandas(_pack, f"site {types['site']}, book_id {types['book_id']}, part int, content binary")


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                entries = [(r.site, r.book_id, r.part, i, e.filename, e.file_size, hashlib.md5(z.read(e)).hexdigest()) for i, e in enumerate(z.infolist())]
            yield pd.DataFrame(entries, columns=["site", "book_id", "part", "position", "entry", "bytes", "md5"])


def volume_entries(volumes: DataFrame) -> DataFrame:
    """(site, book_id, part, position, entry, bytes, md5) of each file in the volumes of `epub_parts`."""
    types = volumes.schema
    return volumes.mapInPandas(_listed, f"site {types['site'].dataType.simpleString()}, book_id {types['book_id'].dataType.simpleString()}, part int, position int, entry string, bytes long, md5 string")


def write_files(parts: DataFrame, folder: str, content: str = "content") -> None:
    """Write (name, content) rows as single files under a folder every executor can reach."""
    def put(rows: Iterator) -> None:
        from pathlib import Path
        for r in rows:
            target = Path(folder) / r["name"]
            target.parent.mkdir(parents=True, exist_ok=True)
            data = r[content]
            partial = target.with_name(target.name + ".part")
            partial.write_bytes(data.encode() if isinstance(data, str) else bytes(data))
            partial.replace(target)
    parts.select("name", content).foreachPartition(put)
