"""Chapter bodies as paragraph and image blocks, and their text and markup forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, _col, export_spaces, html_escape, let, nullif_blank, replace_all, trim_u

# Image placeholder words, markup patterns, attribute priority.
PLACEHOLDER = "[图片]"
EMBEDDED_IMAGE = "内嵌图片"
PLACEHOLDER_LINE = r"^\[(?:插图|插圖|图片|圖片|\?\?)\][ \t\n\f\r]*([^ \t\n\f\r]+)[ \t\n\f\r]*\z"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(([^) \t\n\f\r]+)\)"
IMG_TAG = r"(?is)<img\b[^>]*>"
LAZY_ATTRIBUTES = ("data-original", "data-src", "data-lazy-src", "data-echo", "src")
SRCSET_ATTRIBUTES = ("srcset", "data-srcset")
PARAGRAPH_INDENT = "    "
TEXT_BLOCK_GAP = "\n\n\n"
HTML_UNESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def image_placeholder(url: Column | str) -> Column:
    u = trim_u(url)
    return F.when(u == "", F.lit(PLACEHOLDER)).otherwise(F.concat(F.lit(PLACEHOLDER + " "), u))


def is_data_image(url: Column | str) -> Column:
    return F.startswith(F.lower(trim_u(url)), F.lit("data:image/"))


def first_srcset_url(value: Column | str) -> Column:
    """First URL of a srcset list; empty when there is none."""
    first = trim_u(F.split_part(_col(value), F.lit(","), F.lit(1)))
    return F.coalesce(F.get(F.split(first, rf"{WS}+"), F.lit(0)), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    """Last value of a quoted attribute; single-quoted values win over double-quoted ones."""
    def last(pattern):
        return F.try_element_at(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), F.lit(-1))
    lead = rf"(?i)(?<![a-z0-9_:-]){name}[ \t\n\f\r]*=[ \t\n\f\r]*"
    return F.coalesce(last(lead + "'([^']*)'"), last(lead + '"([^"]*)"'), F.lit(""))


def _first_attribute(tag: Column, names) -> Column:
    return F.coalesce(*[trim_u(nullif_blank(_attribute(tag, n))) for n in names], F.lit(""))


def usable_image_url(c: Column) -> Column:
    """Unescaped, unquoted URL; empty for scripts and non-image data."""
    u = trim_u(F.regexp_replace(replace_all(trim_u(c), HTML_UNESCAPES), r"""^["']+|["']+\z""", ""))
    low = F.lower(u)
    bad = (F.startswith(low, F.lit("data:")) & ~F.startswith(low, F.lit("data:image/"))) \
        | F.startswith(low, F.lit("javascript:"))
    return F.when(bad, F.lit("")).otherwise(u)


def inline_images(line: Column | str) -> Column:
    """Distinct image URLs of a line: markdown images first, then image tags."""
    x = _col(line)
    marks = F.regexp_extract_all(x, F.lit(MARKDOWN_IMAGE), F.lit(1))
    tags = F.regexp_extract_all(x, F.lit(IMG_TAG), F.lit(0))
    from_tags = F.flatten(F.transform(tags, lambda t: F.array(
        _first_attribute(t, LAZY_ATTRIBUTES), first_srcset_url(_first_attribute(t, SRCSET_ATTRIBUTES)))))
    urls = F.transform(F.concat(marks, from_tags), usable_image_url)
    none = F.array().cast("array<string>")
    return F.when(x.rlike(r"(?i)!\[|<img"), F.array_distinct(F.filter(urls, lambda u: u != ""))).otherwise(none)


def strip_inline_images(line: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(line), MARKDOWN_IMAGE, ""), IMG_TAG, "")


def placeholder_url(line: Column | str) -> Column:
    """URL of an image-placeholder line; empty for any other line."""
    return trim_u(F.regexp_extract(trim_u(line), PLACEHOLDER_LINE, 1))


def _block(kind: str, paragraph: Column, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), paragraph.alias("paragraph"), url.alias("image_url"))


def chapter_blocks(content: Column | str) -> Column:
    """Blocks of a body: per blank-line section, its images in order, then its text lines as one
    paragraph."""
    sections = F.split(F.replace(_col(content), F.lit("\r\n"), F.lit("\n")), "\n\n")
    none = F.lit("")

    def of_section(s):
        lines = F.filter(F.transform(F.split(s, "\n"), trim_u), lambda x: x != "")
        # per line: (text left, image urls); a placeholder line leaves no text
        read = F.transform(lines, lambda x: let(placeholder_url(x), lambda u: F.when(
            u != "", F.struct(none.alias("t"), F.array(u).alias("u"))).otherwise(
            F.struct(trim_u(strip_inline_images(x)).alias("t"), inline_images(x).alias("u")))))
        return let(read, lambda r: F.concat(
            F.transform(F.flatten(F.transform(r, lambda x: x["u"])), lambda u: _block("image", none, u)),
            F.transform(F.filter(F.array(F.array_join(F.filter(F.transform(r, lambda x: x["t"]), lambda t: t != ""),
                                                      "\n")), lambda p: p != ""),
                        lambda p: _block("text", p, none))))

    return F.flatten(F.transform(sections, of_section))


def _plain(c: Column) -> Column:
    return trim_u(export_spaces(F.replace(c, F.lit("\r\n"), F.lit("\n"))))


def txt_body(content: Column | str) -> Column:
    """Plain-text body: indented lines and image placeholders, embedded images masked."""
    def of_block(b):
        url = trim_u(b["image_url"])
        image = F.when(is_data_image(url), F.lit(f"{PLACEHOLDER} {EMBEDDED_IMAGE}")) \
            .otherwise(F.concat(F.lit(PLACEHOLDER + " "), url))
        lines = F.filter(F.transform(F.split(_plain(b["paragraph"]), "\n"), trim_u), lambda x: x != "")
        return F.when(url != "", F.array(image)).otherwise(
            F.transform(lines, lambda x: F.concat(F.lit(PARAGRAPH_INDENT), x)))
    parts = F.flatten(F.transform(chapter_blocks(content), of_block))
    return let(F.array_join(parts, TEXT_BLOCK_GAP),
               lambda t: F.when(t == "", _plain(_col(content))).otherwise(t))


def paragraph_markup(paragraph: Column | str) -> Column:
    """One marked-up paragraph per non-blank line."""
    lines = F.filter(F.transform(F.split(_plain(_col(paragraph)), "\n"), trim_u), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(
        F.lit('<p class="novel-paragraph">'), html_escape(x), F.lit("</p>"))), "")


def data_image(url: Column | str) -> Column:
    """Decoded `data:image/...` URL as struct(media_type, data); NULL when it is not one."""
    u = trim_u(url)
    at = F.position(F.lit(","), u)
    header = trim_u(F.substr(u, F.lit(1), at - 1))
    payload = trim_u(F.substr(u, at + 1))
    parts = F.transform(F.split(F.regexp_replace(header, r"^(data:|DATA:)", ""), ";"), lambda p: F.lower(trim_u(p)))
    media = F.get(parts, F.lit(0))
    base64 = F.array_contains(F.slice(parts, 2, 1000), "base64")
    data = F.when(base64, F.try_to_binary(payload, F.lit("base64"))).otherwise(
        F.try_url_decode(payload).cast("binary"))
    ok = (at > 0) & is_data_image(header) & (payload != "") & F.startswith(media, F.lit("image/")) & data.isNotNull()
    return F.when(ok, F.struct(media.alias("media_type"), data.alias("data")))
