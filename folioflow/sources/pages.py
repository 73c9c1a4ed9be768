"""Crawl pages: scan, decode, and flatten markup into node arrays.

`with_nodes` turns the markup of a page into one array of nodes in document order; everything after
that (selecting, text, links, volumes) is column expressions in `functions.markup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the markup language: elements without content, elements that end an open
# paragraph, and elements that end an open one of their own kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                           "header hr main nav ol p pre section table ul".split())
ENDS_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
                "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table details".split())
HIDDEN = frozenset("script style noscript".split())
# Elements whose end matters to block-aware text.
CLOSING = frozenset("p div section article blockquote li h1 h2 h3 h4 h5 h6".split())

SLICE_BYTES = 1 << 19  # of markup, whose nodes are held at once

NODE = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("hidden", T.BooleanType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])
_ARROW_NODE = pa.list_(pa.struct([
    ("pos", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
    ("text", pa.string()), ("hidden", pa.bool_()), ("attrs", pa.map_(pa.string(), pa.string()))]))

CRAWL_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("content_type", T.StringType()),
                             T.StructField("body", T.BinaryType()), T.StructField("fetched_at", T.TimestampType())])


class _Flattener(HTMLParser):
    """Nodes of one document: elements (e), texts (t) and ends of block elements (c)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []

    def _add(self, kind: str, tag: str, text=None, attrs=None) -> dict:
        node = {"pos": len(self.nodes), "end": len(self.nodes), "depth": len(self.open), "kind": kind, "tag": tag,
                "text": text, "hidden": bool(self.open) and self.open[-1]["tag"] in HIDDEN, "attrs": attrs or []}
        self.nodes.append(node)
        return node

    def _pop(self) -> None:
        node = self.open.pop()
        if node["tag"] in CLOSING:
            self._add("c", node["tag"])
        node["end"] = len(self.nodes) - 1

    def _close(self, tags, stop) -> None:
        """Close the nearest open element among `tags`, looking no further than `stop`."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i]["tag"] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, frozenset(("table", "td", "th", "button")))
        if tag in ENDS_SIBLING:
            self._close(ENDS_SIBLING[tag], SCOPES)
        first = {}
        for key, value in attrs:
            first.setdefault(key, value or "")
        node = self._add("e", tag, attrs=list(first.items()))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, ())

    def handle_data(self, data):
        self._add("t", self.open[-1]["tag"] if self.open else "", text=data)

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self._pop()
        return self.nodes


def _flatten(markup: str | None) -> list[dict]:
    parser = _Flattener()
    parser.feed(markup or "")
    return parser.finish()


def _slices(batch: pa.RecordBatch, markup: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with about `most` bytes of markup at a time; a longer page comes alone."""
    start = filled = 0
    for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(markup)), 0).to_pylist()):
        if i > start and filled + n > most:
            yield batch.slice(start, i - start)
            start, filled = i, 0
        filled += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_nodes(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Replace the markup column by `nodes`.  Runs where the pages are read; nothing is shuffled.  The
    nodes of a page are many times its size, so a worker holds those of `SLICE_BYTES` of markup at a time,
    whatever the size of its batches."""
    kept = [f for f in pages.schema.fields if f.name != markup]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(markup)
            for part in _slices(batch, at, SLICE_BYTES):
                nodes = pa.array([_flatten(x) for x in part.column(at).to_pylist()], type=_ARROW_NODE)
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, nodes], names=[f.name for f in kept] + ["nodes"])

    return pages.mapInArrow(convert, T.StructType([*kept, T.StructField("nodes", T.ArrayType(NODE))]))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawl table with its fixed schema; no inference."""
    return spark.read.schema(CRAWL_SCHEMA).parquet(path)


# Fixed values of the encoding standard: the decoder of each label a page may name.
DECODERS = {
    "utf-8": "utf-8 utf8 unicode-1-1-utf-8",
    "gb18030": "gbk gb2312 gb_2312 gb_2312-80 gb18030 x-gbk chinese iso-ir-58 csgb2312",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "cp932": "shift_jis shift-jis sjis ms_kanji windows-31j x-sjis csshiftjis ms932",
    "euc_jp": "euc-jp x-euc-jp cseucpkdfmtjapanese",
    "iso2022_jp": "iso-2022-jp csiso2022jp",
    "cp949": "euc-kr korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949 iso-ir-149 cseuckr",
    "utf-16-le": "utf-16 utf-16le unicode ucs-2 iso-10646-ucs-2",
    "utf-16-be": "utf-16be unicodefffe",
    "cp1250": "windows-1250 cp1250 x-cp1250",
    "cp1251": "windows-1251 cp1251 x-cp1251",
    "cp1252": "windows-1252 cp1252 x-cp1252 iso-8859-1 iso8859-1 iso_8859-1 latin1 l1 us-ascii ascii ansi_x3.4-1968",
    "koi8-r": "koi8-r koi8 koi cskoi8r",
}
LABELS = {label: decoder for decoder, labels in DECODERS.items() for label in labels.split()}
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
HEAD_BYTES = 1024


def _decode(body: bytes, decoder: str) -> str:
    """Broken sequences become U+FFFD.  Bytes that windows-1252 does not assign stand for themselves."""
    if decoder == "cp1252":
        try:
            return body.decode(decoder)
        except UnicodeDecodeError:
            return "".join(bytes((b,)).decode(decoder, "ignore") or chr(b) for b in body)
    return body.decode(decoder, "replace")


def _decoded_others(body: pd.Series, decoder: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else _decode(bytes(b), d) for b, d in zip(body, decoder, strict=True)], dtype=object)


def charset_of(body: Column | str, content_type: Column | str) -> Column:
    """Decoder of a page: by its byte order mark, else the charset of the content type, else that of a meta
    tag in the first 1024 bytes; unknown names are passed over.  Without any, UTF-8 where the bytes are
    valid UTF-8, else windows-1252."""
    b = F.col(body) if isinstance(body, str) else body
    ct = F.col(content_type) if isinstance(content_type, str) else content_type
    head = F.decode(F.substring(b, 1, HEAD_BYTES), "ISO-8859-1")
    pattern = r"(?i)charset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)"
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    named = [F.element_at(labels, F.lower(F.regexp_extract(text, pattern, 1))) for text in (F.coalesce(ct, F.lit("")), head)]
    mark = F.coalesce(*[F.when(F.startswith(b, F.lit(m)), F.lit(d)) for m, d in MARKS])
    return F.coalesce(mark, *named, F.when(F.is_valid_utf8(b.cast("string")), F.lit("utf-8")).otherwise(F.lit("cp1252")))


def decoded(body: Column | str, content_type: Column | str) -> Column:
    """Text of raw bytes, without a byte order mark.  No bytes end the job: what the charset cannot read
    becomes U+FFFD.  UTF-8 is read by Spark, the rest in Arrow batches; NULL stays NULL."""
    b = F.col(body) if isinstance(body, str) else body
    charset = charset_of(b, content_type)
    ours = charset == "utf-8"
    other = F.pandas_udf(_decoded_others, "string")(F.when(~ours, b), charset)
    text = F.when(ours, F.make_valid_utf8(b.cast("string"))).otherwise(other)
    return F.regexp_replace(text, "^\ufeff", "")
