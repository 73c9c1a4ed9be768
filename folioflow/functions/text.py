"""Text columns.  Everything here stays in JVM expressions; there is no Python UDF.

White space means the Unicode White_Space property unless a function says ASCII.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters, as a set and as the inside of a regex class.
WS_CHARS = "\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS_INLINE = r" \t\x0B\f\r\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = rf"[{WS_INLINE}\n]"

# Punctuation between a label and its text, and wording that sites put around fields.
LABEL_MARKS = ("：", ":")
AUTHOR_PREFIXES = ("作者：", "作者:")
AUTHOR_SUFFIX = "作品全集"
DESCRIPTION_PREFIXES = ("内容简介：", "内容简介:")
BODY_PREFIXES = ("正文", "正文卷")
TAGS_LABEL = "作品Tags："
SUMMARY_TAIL_MARKERS = ("[最新书评]", "喜欢《", "UBBEditor.Create")
INDEX_VARIANTS = {"妳": "你", "祢": "你"}
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"))
EXPORT_SPACES = ("&nbsp;", "&#160;", "&#xa0;", "\u00a0", "\u202f")
INVISIBLE = ("\u200b", "\ufeff")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_all(c: Column, pairs) -> Column:
    """Literal replacements, applied left to right."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def trim_u(c: Column | str) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def is_blank(c: Column | str) -> Column:
    return trim_u(F.coalesce(_col(c), F.lit(""))) == ""


def nullif_blank(c: Column | str) -> Column:
    """NULL for blank text, else the text unchanged."""
    return F.when(~is_blank(c), _col(c))


def first_non_blank(*cols: Column | str) -> Column:
    """First argument with visible text, untrimmed; empty string when there is none."""
    return F.coalesce(*[nullif_blank(c) for c in cols], F.lit(""))


def fallback(c: Column | str, other: Column | str) -> Column:
    """Trimmed first argument, or the trimmed second when the first is blank."""
    return trim_u(first_non_blank(c, other))


def fields(c: Column | str) -> Column:
    """Split on white-space runs, no empty items."""
    return F.filter(F.split(_col(c), rf"{WS}+"), lambda x: x != "")


def clean_text(c: Column | str) -> Column:
    """Collapse white space inside each line, trim lines, drop blank lines and carriage returns."""
    x = F.replace(_col(c), F.lit("\r"), F.lit(""))
    x = F.regexp_replace(x, rf"[{WS_INLINE}]{{2,}}|[{WS_INLINE.lstrip()}]", " ")
    x = F.regexp_replace(x, r" \n[ \n]*|\n[ \n]+", "\n")
    return F.btrim(x, F.lit(" \n"))


def clean_lines(c: Column | str) -> Column:
    """`clean_text` as an array of lines; empty array for blank text."""
    return F.filter(F.split(clean_text(c), "\n"), lambda x: x != "")


def compact_whitespace(c: Column | str) -> Column:
    """ASCII white-space runs become one space; ends are trimmed."""
    return trim_u(F.regexp_replace(_col(c), r"[ \t\n\f\r]+", " "))


def norm(c: Column | str) -> Column:
    """Search key: lower case, letters, numbers and Han characters only."""
    return F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9\p{L}\p{N}\p{IsHan}]+", "")


def norm_index(c: Column | str, char_map: Mapping[str, str] | None = None) -> Column:
    """Index search key: pronoun variants folded, script converted, then `norm`."""
    x = substitute(_col(c), INDEX_VARIANTS)
    if char_map:
        x = substitute(x, char_map)
    return norm(trim_u(x))


def substitute(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace single characters by a caller-supplied map; replacements may have any length."""
    col = _col(c)
    if not mapping:
        return col
    if all(len(k) == 1 and len(v) == 1 for k, v in mapping.items()):
        return F.translate(col, "".join(mapping), "".join(mapping.values()))
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.array_join(F.transform(F.split(col, ""), lambda ch: F.coalesce(table[ch], ch)), "")


def html_escape(c: Column | str) -> Column:
    return replace_all(_col(c), HTML_ESCAPES)


def html_escape_breaks(c: Column | str) -> Column:
    return F.replace(html_escape(c), F.lit("\n"), F.lit("<br/>"))


def export_spaces(c: Column | str) -> Column:
    return replace_all(_col(c), [(s, " ") for s in EXPORT_SPACES])


def unix_lines(c: Column | str) -> Column:
    return replace_all(_col(c), [("\r\n", "\n"), ("\r", "\n")])


def cleaner(c: Column | str, remove_invisible: bool = False) -> Column:
    """Cleaning stage for chapter bodies: LF line ends, optional invisible removal, trimmed."""
    x = unix_lines(c)
    if remove_invisible:
        x = replace_all(x, [(s, "") for s in INVISIBLE])
    return trim_u(x)


def file_name(c: Column | str) -> Column:
    """File-name form: runs of reserved characters become one underscore; blank becomes `book`."""
    x = trim_u(F.regexp_replace(_col(c), r'[\\/:*?"<>|]+', "_"))
    return F.when(x == "", F.lit("book")).otherwise(x)


def store_name(c: Column | str) -> Column:
    """Store-key form: every reserved character becomes an underscore; blank becomes `unknown`."""
    x = trim_u(F.regexp_replace(_col(c), r'[\\/:*?"<>|]', "_"))
    return F.when(x == "", F.lit("unknown")).otherwise(x)


def strip_prefix(c: Column, prefix: Column | str) -> Column:
    """Remove a prefix once if present, then trim."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when((p != "") & F.startswith(c, p),
                  trim_u(F.substr(c, F.char_length(p) + 1))).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)),
                  trim_u(F.substr(c, F.lit(1), F.char_length(c) - len(suffix)))).otherwise(c)


def strip_category(c: Column | str) -> Column:
    """Drop one leading `[category]`."""
    return trim_u(F.regexp_replace(trim_u(c), r"^\[[^\]]*\]", ""))


def clean_book_title(c: Column | str) -> Column:
    """Clean and drop surrounding title brackets."""
    return trim_u(F.regexp_replace(clean_text(c), r"^[《》]+|[《》]+\z", ""))


def clean_chapter_title(c: Column | str, book_title: Column | str) -> Column:
    """Clean and drop a leading book name, then leading body-volume words."""
    x = strip_prefix(clean_text(c), clean_book_title(book_title))
    for p in BODY_PREFIXES:
        x = strip_prefix(x, p)
    return trim_u(x)


def strip_book_name(c: Column | str, book_name: Column | str) -> Column:
    return trim_u(strip_prefix(clean_text(c), clean_text(book_name)))


def clean_author(c: Column | str) -> Column:
    x = clean_text(c)
    for p in AUTHOR_PREFIXES:
        x = strip_prefix(x, p)
    return trim_u(strip_suffix(x, AUTHOR_SUFFIX))


def clean_description(c: Column | str) -> Column:
    x = clean_text(c)
    for p in DESCRIPTION_PREFIXES:
        x = strip_prefix(x, p)
    return trim_u(x)


def _before(c: Column, marker: Column) -> Column:
    """Text before the first marker, trimmed; the whole text when the marker is absent."""
    at = F.position(marker, c)
    return F.when(at > 0, trim_u(F.substr(c, F.lit(1), at - 1))).otherwise(c)


def trim_summary_tail(c: Column | str, title: Column | str | None = None) -> Column:
    """Cut a summary at the first of the fixed tail markers, and at the preview heading of `title`."""
    x = trim_u(c)
    for m in SUMMARY_TAIL_MARKERS:
        x = _before(x, F.lit(m))
    if title is not None:
        t = _col(title)
        x = F.when(t != "", _before(x, F.concat(F.lit("《"), t, F.lit("》最新章节预览")))).otherwise(x)
    return trim_u(x)


def labelled_field(c: Column | str, label: str, stops: list[str] | tuple[str, ...] = ()) -> Column:
    """Text after `label` up to the first listed stop label that occurs."""
    x = clean_text(c)
    marks = [label + m for m in LABEL_MARKS] if label else []
    start = x
    for m in reversed(marks):
        at = F.position(F.lit(m), x)
        start = F.when(at > 0, F.substr(x, at + len(m))).otherwise(start)
    if label:
        x = start
    cut = x
    for m in reversed([s + m for s in stops for m in LABEL_MARKS]):
        at = F.position(F.lit(m), x)
        cut = F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(cut)
    return trim_u(cut)


def unescape_newlines(c: Column | str) -> Column:
    """Turn literal backslash newlines in a description into line breaks, then clean."""
    return clean_text(replace_all(trim_u(c), [("\\r\\n", "\n"), ("\\n", "\n"), ("\\r", "\n")]))


def clean_markup_summary(c: Column | str) -> Column:
    """Drop non-breaking-space entities, keep break tags as lines, compact each line."""
    x = replace_all(_col(c), [("&nbsp;", ""), ("<br />", "\n")])
    lines = F.transform(F.split(x, "\n"), compact_whitespace)
    return trim_u(F.array_join(lines, "\n"))


def strip_nested_html(c: Column | str) -> Column:
    """Drop nested document tags and every head section that precedes a stray head end."""
    x = replace_all(_col(c), [(t, "") for t in ("<html>", "</html>", "<body>", "</body>")])
    return F.regexp_replace(x, r"(?is)\G((?:(?!</?head>).)*+)<head>.*?</head>", "$1")


def split_tags(c: Column | str) -> Column:
    """Tag line to tags: label removed, split on white space."""
    return fields(F.replace(_col(c), F.lit(TAGS_LABEL), F.lit("")))


def compact_items(items: Column | str) -> Column:
    """Clean every item of an array and drop blanks."""
    return F.filter(F.transform(_col(items), clean_text), lambda x: x != "")


def distinct_tags(items: Column | str) -> Column:
    """Clean items, drop blanks, keep the first of equals in order."""
    return F.array_distinct(compact_items(items))


def ordered_unique(items: Column | str) -> Column:
    """Trim items and trailing slashes, drop blanks, keep the first of equals."""
    stripped = F.transform(_col(items), lambda x: trim_u(F.regexp_replace(x, r"/+\z", "")))
    return F.array_distinct(F.filter(stripped, lambda x: x != ""))


def missing_label(c: Column | str) -> Column:
    return F.coalesce(nullif_blank(c), F.lit("-"))


def truncate_chars(c: Column | str, limit: int) -> Column:
    """At most `limit` characters, the last three being dots when the limit allows."""
    x = _col(c)
    if limit <= 0:
        return F.lit("")
    cut = F.left(x, F.lit(limit)) if limit <= 3 else F.concat(F.left(x, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.char_length(x) <= limit, x).otherwise(cut)


def strip_leading_title(content: Column | str, title: Column | str) -> Column:
    """Drop the first line of a body when it equals the title, ignoring case."""
    body, head = trim_u(content), clean_text(title)
    first = F.regexp_extract(body, r"^[^\n]*", 0)
    rest = trim_u(F.substr(body, F.char_length(first) + 1))
    same = (head != "") & (F.lower(clean_text(first)) == F.lower(head))
    return F.when(same, rest).otherwise(body)


def version_compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by numeric parts; parts that are not numbers count as zero."""
    def parts(c):
        digits = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"(^|[.+-]){WS}+", "$1"),
                                  r"[^0-9.+-][^.+-]*", "")
        numbers = F.split(digits, r"[.+-]").try_cast("array<bigint>")
        return F.transform(numbers, lambda n: F.coalesce(n, F.lit(0).cast("bigint")))
    pad = lambda p, n: F.concat(p, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(p)))
    both = F.struct(parts(a).alias("a"), parts(b).alias("b"))
    padded = lambda v: let(F.greatest(F.size(v["a"]), F.size(v["b"])), lambda n: F.struct(
        pad(v["a"], n).alias("x"), pad(v["b"], n).alias("y")))
    return let(both, lambda v: let(padded(v), lambda w: F.when(w["x"] > w["y"], F.lit(1))
                                   .when(w["x"] < w["y"], F.lit(-1)).otherwise(F.lit(0))))
