"""Selecting and reading nodes of the arrays made by `sources.pages.with_nodes`.

`pos` is the index of a node in its array and `end` the index of its last descendant, so a subtree
is a slice and an ancestor test is a range test.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import LAZY_ATTRIBUTES, SRCSET_ATTRIBUTES, first_srcset_url, image_placeholder
from .text import _col, clean_lines, clean_text, let, nullif_blank, strip_category, strip_prefix, trim_u
from .urls import absolute_url

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "summary")
TEXT_BLOCKS = ("div", "section", "article", "blockquote")
_MARK = "\x01"


def attr(node: Column, name: str) -> Column:
    """Trimmed attribute value, empty when absent."""
    return trim_u(F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit("")))


def has_class(node: Column, name: str) -> Column:
    classes = F.translate(F.coalesce(F.try_element_at(node["attrs"], F.lit("class")), F.lit("")), "\t\n\f\r", "    ")
    return F.contains(F.concat(F.lit(" "), classes, F.lit(" ")), F.lit(f" {name} "))


def inside(node: Column, outer: Column) -> Column:
    return (node["pos"] > outer["pos"]) & (node["pos"] <= outer["end"])


def select(nodes: Column | str, tag: str | Sequence[str] | None = None, cls: str | None = None, id: str | None = None,
           where: Callable[[Column], Column] | None = None) -> Column:
    """Elements by tag, class, id or any other test, in document order."""
    def test(n):
        ok = n["kind"] == "e"
        if tag is not None:
            ok = ok & n["tag"].isin(*([tag] if isinstance(tag, str) else tag))
        if cls is not None:
            ok = ok & has_class(n, cls)
        if id is not None:
            ok = ok & (attr(n, "id") == id)
        return ok & where(n) if where is not None else ok
    return F.filter(_col(nodes), test)


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def within(elements: Column, outers: Column) -> Column:
    """Elements that have an ancestor among `outers`."""
    return F.filter(elements, lambda n: F.exists(outers, lambda a: inside(n, a)))


def subtree(nodes: Column | str, node: Column) -> Column:
    return F.when(node.isNotNull(), F.slice(_col(nodes), node["pos"] + 1, node["end"] - node["pos"] + 1))


def children(nodes: Column | str, node: Column, tag: str | Sequence[str] | None = None) -> Column:
    """Child elements of a node."""
    return select(subtree(nodes, node), tag, where=lambda n: n["depth"] == node["depth"] + 1)


def _text(parts: Column, piece: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_join(F.transform(parts, piece), ""), F.lit(""))


def _string(n: Column) -> Column:
    return F.coalesce(n["text"], F.lit(""))


def node_text(nodes: Column | str, node: Column) -> Column:
    """All text below a node."""
    return _text(subtree(nodes, node), _string)


def node_text_breaks(nodes: Column | str, node: Column) -> Column:
    """All text below a node, with line breaks as newlines."""
    return _text(subtree(nodes, node), lambda n: F.when((n["kind"] == "e") & (n["tag"] == "br"), F.lit("\n")).otherwise(_string(n)))


def chapter_text(nodes: Column | str, node: Column) -> Column:
    """Visible text with a newline at every break and at every block end."""
    return _text(subtree(nodes, node), lambda n: F.when(
        ((n["kind"] == "e") & (n["tag"] == "br")) | (n["kind"] == "c"), F.lit("\n"))
        .when(n["hidden"], F.lit("")).otherwise(_string(n)))


def first_text(nodes: Column | str, node: Column) -> Column:
    """The first piece of text below a node."""
    return F.coalesce(F.get(F.filter(subtree(nodes, node), lambda n: n["kind"] == "t"), F.lit(0))["text"], F.lit(""))


def meta_content(nodes: Column | str, name: str, key: str = "property") -> Column:
    """First non-blank content of a meta tag by property, or by name ignoring case."""
    same = (lambda n: attr(n, "property") == name) if key == "property" else (lambda n: F.lower(attr(n, "name")) == name.lower())
    contents = F.transform(select(nodes, "meta", where=same), lambda n: attr(n, "content"))
    return F.coalesce(F.get(F.filter(contents, lambda c: c != ""), F.lit(0)), F.lit(""))


def json_ld_field(nodes: Column | str, pattern: str) -> Column:
    """Cleaned first capture of `pattern` in the structured-data scripts, unquoted."""
    all_nodes = _col(nodes)
    scripts = select(all_nodes, "script", where=lambda n: F.lower(attr(n, "type")) == "application/ld+json")
    raw = F.transform(scripts, lambda s: F.regexp_extract(node_text(all_nodes, s), pattern, 1))
    value = trim_u(F.regexp_replace(trim_u(F.get(F.filter(raw, lambda x: x != ""), F.lit(0))), r",\z", ""))
    quoted = value.rlike(r'(?s)^".*"\z') & (F.char_length(value) >= 2)
    plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"), F.regexp_replace(value, r'^"+|"+\z', ""))
    return F.coalesce(clean_text(F.when(quoted, plain).otherwise(value)), F.lit(""))


def paragraphs(nodes: Column | str, elements: Column, is_ad: Callable[[Column], Column] | None = None) -> Column:
    """Cleaned non-blank texts of elements, adverts left out."""
    all_nodes = _col(nodes)
    texts = F.transform(elements, lambda n: clean_text(node_text_breaks(all_nodes, n)))
    return F.filter(texts, lambda t: (t != "") & ~is_ad(t) if is_ad else t != "")


def loose_lines(nodes: Column | str, node: Column) -> Column:
    """Cleaned lines of a node's text."""
    return F.when(node.isNotNull(), clean_lines(node_text_breaks(nodes, node)))


def flush_lines(nodes: Column | str, node: Column, skip_classes: Sequence[str] = ()) -> Column:
    """Texts between line breaks and paragraph or division borders; marked subtrees are skipped."""
    tree = subtree(nodes, node)
    skipped = F.filter(tree, lambda n: F.lit(False) if not skip_classes else (n["kind"] == "e") & _any(
        [has_class(n, c) for c in skip_classes]))
    border = lambda n: ((n["kind"] == "e") & n["tag"].isin("br", "p", "div")) | ((n["kind"] == "c") & n["tag"].isin("p", "div"))
    joined = let(skipped, lambda out: _text(tree, lambda n: F.when(
        border(n), F.lit(_MARK)).when(n["hidden"] | F.exists(out, lambda a: inside(n, a)), F.lit("")).otherwise(_string(n))))
    return F.filter(F.transform(F.split(joined, _MARK), clean_text), lambda t: t != "")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def readable_paragraphs(nodes: Column | str, node: Column, page_url: Column | str | None = None) -> Column:
    """Paragraphs, and blocks that hold no paragraph, as cleaned texts; with a page URL each is
    followed by placeholders of its images."""
    all_nodes = _col(nodes)
    tree = subtree(all_nodes, node)

    def pick(p_tags):
        whole = select(tree, ("p", *TEXT_BLOCKS), where=lambda n: (n["tag"] == "p") | ~F.exists(p_tags, lambda p: inside(p, n)))
        return let(whole, lambda c: F.filter(c, lambda n: ~F.exists(c, lambda a: inside(n, a))))

    def read(n):
        text = F.filter(F.array(clean_text(node_text_breaks(all_nodes, n))), lambda t: t != "")
        if page_url is None:
            return text
        return F.concat(text, F.transform(image_sources(all_nodes, n, page_url), image_placeholder))

    return F.flatten(F.transform(let(select(tree, "p"), pick), read))


def longest(blocks: Column) -> Column:
    """The block with most bytes, the first of equals; each block is an array of lines."""
    sized = F.transform(blocks, lambda b, i: F.struct(F.octet_length(F.array_join(b, "")).alias("n"), (-i).alias("i"), b.alias("b")))
    return F.coalesce(F.array_max(F.filter(sized, lambda s: s["n"] > 0))["b"], F.array().cast("array<string>"))


def longest_paragraph(nodes: Column | str, main: Column) -> Column:
    """Lines of the longest paragraph child, else of the longest paragraph outside tables."""
    all_nodes = _col(nodes)
    lines = lambda ps: F.transform(ps, lambda p: loose_lines(all_nodes, p))
    direct = longest(lines(children(all_nodes, main, "p")))
    deep = select(subtree(all_nodes, main), "p")
    tables = select(all_nodes, "table")
    free = let(tables, lambda t: F.filter(deep, lambda p: ~F.exists(t, lambda a: inside(p, a))))
    return let(direct, lambda d: F.when(F.size(d) > 0, d).otherwise(longest(lines(free))))


def image_sources(nodes: Column | str, node: Column, page_url: Column | str) -> Column:
    """Distinct absolute image URLs below a node: lazy-loading attributes first, then source sets."""
    def source(n):
        named = F.coalesce(*[nullif_blank(attr(n, a)) for a in LAZY_ATTRIBUTES],
                           nullif_blank(first_srcset_url(F.coalesce(*[nullif_blank(attr(n, a)) for a in SRCSET_ATTRIBUTES],
                                                                    F.lit("")))), F.lit(""))
        return absolute_url(_col(page_url), named)
    return F.array_distinct(F.filter(F.transform(select(subtree(nodes, node), "img"), source), lambda u: u != ""))


def links(nodes: Column | str, elements: Column) -> Column:
    """Link elements as (pos, href, text)."""
    all_nodes = _col(nodes)
    return F.transform(elements, lambda a: F.struct(a["pos"].alias("pos"), attr(a, "href").alias("href"),
                                                    clean_text(node_text(all_nodes, a)).alias("text")))


def chapter_links(nodes: Column | str, container: Column, href_pattern: str) -> Column:
    """Links of a chapter list as (pos, id, href, title, volume).

    The volume is the last heading before the link.  A heading inside a details element counts only
    up to the end of that element; before the first chapter a plain paragraph counts too.
    """
    all_nodes = _col(nodes)
    tree = subtree(all_nodes, container)
    path = lambda href: F.regexp_replace(href, r"^https?://[^/?#]*|[?#].*\z", "")

    def title(a):
        own = clean_text(attr(a, "data-title"))
        return F.when(own != "", own).otherwise(clean_text(node_text(all_nodes, a)))

    chapters = F.filter(F.transform(select(tree, "a"), lambda a: F.struct(
        a["pos"].alias("pos"), F.regexp_extract(path(attr(a, "href")), href_pattern, 1).alias("id"),
        attr(a, "href").alias("href"), title(a).alias("title"))), lambda c: (c["id"] != "") & (c["title"] != ""))

    def with_volumes(found):
        start = F.coalesce(F.get(found, F.lit(0))["pos"], F.lit(0))
        details, anchors = select(tree, "details"), select(tree, "a")

        def heads(d_and_a):
            names = select(tree, (*HEADINGS, "p"), where=lambda n: (n["tag"] != "p") | (
                (n["pos"] < start) & ~F.exists(d_and_a["a"], lambda x: inside(n, x))))
            return F.filter(F.transform(names, lambda h: F.struct(
                h["pos"].alias("pos"), clean_text(node_text(all_nodes, h)).alias("name"),
                F.coalesce(F.array_min(F.transform(F.filter(d_and_a["d"], lambda d: inside(h, d)), lambda d: d["end"])),
                           F.lit(2 ** 31 - 1)).alias("until"))), lambda h: h["name"] != "")

        def volume(c, hs):
            ok = F.filter(hs, lambda h: (h["pos"] < c["pos"]) & (c["pos"] <= h["until"]))
            return F.coalesce(F.try_element_at(ok, F.lit(-1))["name"], F.lit(""))

        return let(let(F.struct(details.alias("d"), anchors.alias("a")), heads), lambda hs: F.transform(
            found, lambda c: F.struct(c["pos"].alias("pos"), c["id"].alias("id"), c["href"].alias("href"),
                                      c["title"].alias("title"), volume(c, hs).alias("volume"))))

    return let(chapters, with_volumes)


def list_entries(nodes: Column | str, lists: Column, is_volume: Callable[[Column], Column], is_item: Callable[[Column], Column],
                 default_volume: str = "") -> Column:
    """Links of flat chapter lists whose children are volume headings or items, as (pos, href,
    title, volume).  Headings count inside their own list only."""
    all_nodes = _col(nodes)

    def of_list(box):
        kids = children(all_nodes, box)
        heads = F.filter(F.transform(F.filter(kids, is_volume), lambda h: F.struct(
            h["pos"].alias("pos"), clean_text(node_text(all_nodes, h)).alias("name"))), lambda h: h["name"] != "")

        def entry(item, hs):
            return let(first(select(subtree(all_nodes, item), "a")), lambda a: F.struct(
                item["pos"].alias("pos"), attr(a, "href").alias("href"), clean_text(node_text(all_nodes, a)).alias("title"),
                F.coalesce(F.try_element_at(F.filter(hs, lambda h: h["pos"] < item["pos"]), F.lit(-1))["name"],
                           F.lit(default_volume)).alias("volume")))

        return let(heads, lambda hs: F.transform(F.filter(kids, is_item), lambda i: entry(i, hs)))

    return F.filter(F.flatten(F.transform(lists, of_list)), lambda e: (e["href"] != "") & (e["title"] != ""))


def search_cards(nodes: Column | str, page_url: Column | str, id_pattern: str, author_label: str, latest_label: str) -> Column:
    """Hits of a search page made of definition lists, as (book_id, title, author, url,
    latest_chapter, cover_url); the title link is the first heading link whose path matches."""
    all_nodes = _col(nodes)
    heads = select(all_nodes, "h3")
    path = lambda href: F.regexp_extract(href, r"^https?://[^/?#]*([^?#]*)", 1)

    def card(box, h3):
        page = _col(page_url)

        def row(tree):
            named = F.transform(F.filter(select(tree, "a"), lambda a: F.exists(h3, lambda h: inside(a, h))), lambda a: let(
                absolute_url(page, attr(a, "href")), lambda u: F.struct(
                    u.alias("url"), F.regexp_extract(path(u), id_pattern, 1).alias("book_id"), a.alias("a"))))
            notes = F.transform(select(tree, "dd", "book_other"), lambda d: F.struct(
                clean_text(node_text(all_nodes, d)).alias("t"),
                clean_text(node_text(all_nodes, first(select(subtree(all_nodes, d), "a")))).alias("a")))
            cover = let(first(select(tree, "img")), lambda i: absolute_url(page, attr(i, "src")))
            return let(F.struct(first(F.filter(named, lambda n: n["book_id"] != "")).alias("link"), notes.alias("notes")), lambda c: F.when(
                c["link"].isNotNull(), F.struct(
                    c["link"]["book_id"].alias("book_id"), strip_category(clean_text(node_text(all_nodes, c["link"]["a"]))).alias("title"),
                    F.coalesce(note(c["notes"], author_label, False), F.lit("")).alias("author"), c["link"]["url"].alias("url"),
                    F.coalesce(note(c["notes"], latest_label, True), F.lit("")).alias("latest_chapter"),
                    F.coalesce(cover, F.lit("")).alias("cover_url"))))

        return let(subtree(all_nodes, box), row)

    def note(notes, label, prefer_link):
        found = first(F.filter(notes, lambda n: F.startswith(n["t"], F.lit(label))))
        plain = lambda n: trim_u(F.substr(n["t"], F.lit(len(label) + 1)))
        return let(found, lambda n: F.when(n["a"] != "", n["a"]).otherwise(plain(n)) if prefer_link else plain(n))

    boxes = let(select(all_nodes, "dt"), lambda dts: select(all_nodes, "dl", where=lambda n: F.exists(dts, lambda t: inside(t, n))))
    return F.filter(let(heads, lambda h3: F.transform(boxes, lambda b: card(b, h3))), lambda c: c.isNotNull())


def store_boxes(nodes: Column | str, page_url: Column | str, id_pattern: str, box: str = "bookbox", name: str = "bookname",
                info: str = "bookilnk", intro: str = "bookintro", image: str = "bookimg") -> Column:
    """Hits of a listing page made of boxes, as (book_id, title, author, description, url,
    cover_url); boxes whose title link does not match are left out."""
    all_nodes = _col(nodes)

    text = lambda n: clean_text(node_text(all_nodes, n))

    def of_tree(tree):
        under = lambda tag, cls: let(select(tree, cls=cls), lambda outer: first(within(select(tree, tag), outer)))
        author = text(first(select(subtree(all_nodes, first(select(tree, "div", info))), "span")))
        cover = let(under("img", image), lambda i: F.coalesce(nullif_blank(attr(i, "data-original")), attr(i, "src"), F.lit("")))
        about = clean_text(node_text_breaks(all_nodes, first(select(tree, "div", intro))))
        return let(under("a", name), lambda a: F.struct(
            F.regexp_extract(F.regexp_replace(attr(a, "href"), r"^https?://[^/?#]*|[?#].*\z", ""), id_pattern, 1).alias("book_id"),
            text(a).alias("title"), author.alias("author"), about.alias("description"),
            absolute_url(_col(page_url), attr(a, "href")).alias("url"), absolute_url(_col(page_url), cover).alias("cover_url")))

    of_box = lambda b: let(subtree(all_nodes, b), of_tree)
    return F.filter(F.transform(select(all_nodes, "div", box), of_box), lambda h: h["book_id"] != "")


def detail_page(nodes: Column | str, page_url: Column | str, book_id: Column | str, author_label: str) -> Column:
    """Book fields of a detail page, each with its fallback: the id for the title, `Unknown` for
    the author."""
    all_nodes = _col(nodes)
    title = trim_u(first_text(all_nodes, first(select(all_nodes, "h2", "text-normal"))))
    rows = F.filter(F.transform(select(all_nodes, "li"), lambda li: F.struct(
        clean_text(node_text(all_nodes, li)).alias("t"),
        F.coalesce(first(F.filter(F.transform(children(all_nodes, li, "a"), lambda a: clean_text(node_text(all_nodes, a))),
                                  lambda t: t != "")), F.lit("")).alias("a"))), lambda r: F.contains(r["t"], F.lit(author_label)))
    bare = lambda t: strip_prefix(strip_prefix(t, author_label + ":"), author_label)
    authors = F.filter(F.transform(rows, lambda r: F.when(r["a"] != "", r["a"]).otherwise(bare(r["t"]))), lambda a: a != "")
    cover = let(first(within(select(all_nodes, "img"), select(all_nodes, cls="product-gallery"))),
                lambda i: absolute_url(_col(page_url), attr(i, "src")))
    about = let(first(select(all_nodes, cls="description")), lambda d: F.array_join(F.filter(F.transform(
        children(all_nodes, d, "p"), lambda p: clean_text(node_text(all_nodes, p))), lambda t: t != ""), "\n"))
    return F.struct(
        _col(book_id).alias("book_id"), F.when(title != "", title).otherwise(_col(book_id)).alias("title"),
        F.coalesce(first(authors), F.lit("Unknown")).alias("author"), F.coalesce(about, F.lit("")).alias("description"),
        _col(page_url).alias("source_url"), F.coalesce(cover, F.lit("")).alias("cover_url"))


def fragment(markup: Column | str, marker: str) -> Column:
    """Container markup cut out of a broken page: from the tag holding the marker to the first
    section end, else the first division end; empty when there is none."""
    m = _col(markup)
    at = F.position(F.lit(marker), m)
    head = F.substr(m, F.lit(1), at - 1)
    start = F.char_length(F.regexp_extract(head, r"(?s)^.*<", 0))
    rest = F.substr(m, start)

    def upto(tag):
        p = F.position(F.lit(tag), rest)
        return F.when(p > 0, F.substr(rest, F.lit(1), p + len(tag) - 1))

    return F.when((at > 0) & (start > 0), F.coalesce(upto("</section>"), upto("</div>"), F.lit(""))).otherwise(F.lit(""))


def max_page(markup: Column | str, pattern: str, ceiling: int | None = None) -> Column:
    """Largest page number any match names, at least 1; numbers above the ceiling are ignored."""
    found = F.transform(F.regexp_extract_all(_col(markup), F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int"))
    kept = F.filter(found, lambda n: n.isNotNull() & (F.lit(True) if ceiling is None else n <= ceiling))
    return F.greatest(F.lit(1), F.array_max(kept))


def page_total(stats: Column, last_link: Column, pattern: str) -> Column:
    """Pages of a listing from `current/total` text, else from the number in the last link."""
    counted = F.when(clean_text(stats) == "", F.lit(1)).otherwise(
        F.coalesce(F.regexp_extract(clean_text(stats), r"^\d+/(\d+)", 1).try_cast("int"), F.lit(1)))
    linked = F.regexp_extract(last_link, pattern, 1).try_cast("int")
    return F.greatest(F.lit(1), F.when(counted >= 1, counted).otherwise(F.coalesce(linked, F.lit(1))))


def zipped_titles(markup: Column | str) -> Column:
    """Map of id to title from two comma-joined script lists: one all digits, one not, the digits
    one longer.  NULL when the lists are missing or do not fit."""
    lists = F.regexp_extract_all(_col(markup), F.lit(r"""["']([^"']+)["'][ \t\n\f\r]*\.split[ \t\n\f\r]*\([ \t\n\f\r]*["'][ \t\n\f\r]*,[ \t\n\f\r]*["'][ \t\n\f\r]*\)"""), F.lit(1))
    split = F.transform(lists, lambda x: F.filter(F.transform(F.split(x, ","), trim_u), lambda i: i != ""))
    filled = F.filter(split, lambda x: F.size(x) > 0)
    numeric = lambda x: F.forall(x, lambda i: i.rlike(r"^\d+\z"))

    def pair(all_lists):
        # lists are read in order until both kinds are seen; a later list replaces an earlier of its kind
        kinds = F.transform(all_lists, numeric)
        switch = F.array_position(kinds, ~F.get(kinds, F.lit(0)))
        seen = F.when(switch > 0, F.slice(all_lists, F.lit(1), switch.cast("int"))).otherwise(all_lists)
        return F.struct(F.try_element_at(F.filter(seen, numeric), F.lit(-1)).alias("ids"),
                        F.try_element_at(F.filter(seen, lambda x: ~numeric(x)), F.lit(-1)).alias("titles"))

    def build(p):
        fits = F.size(p["ids"]) == F.size(p["titles"]) + 1
        entries = F.transform(p["titles"], lambda t, i: F.struct(F.get(p["ids"], i).alias("k"), t.alias("v")))
        # an id listed twice keeps its last title
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
        return F.when(fits, F.map_from_entries(last))

    return let(let(filled, pair), build)
