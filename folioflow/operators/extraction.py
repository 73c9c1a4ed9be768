"""Extract fields of pages by rules that are rows of a table.

A rule (site, field, ord, selector, mode, attribute, take) says where a field of a source's pages is found.
Rules of one field are tried by `ord`; the first that yields a value fills it.

A selector is a list of steps: `tag`, `#id`, `.class` and `[attribute]` or `[attribute=value]`, any of them
or `*`.  A blank between steps asks for a descendant, `>` for a child.  Modes: `text` (all text, cleaned),
`lines` (line breaks kept), `blocks` (visible text with a line for every block), `attr` (the attribute) and
`url` (the attribute, made absolute).  `take` is `first` (the first value that is not blank) or `all`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import clean_text
from ..functions.urls import absolute_url
from ..sources.pages import NODE

NAME = r"[\w-]+"


def steps_of(selector: Column) -> Column:
    """A selector as an array of steps (child, tag, id, classes, attribute, value); an empty text is no
    condition, and the value is NULL where any will do."""
    def step(t: Column) -> Column:
        plain = F.regexp_replace(t, r"\[[^\]]*\]", "")
        tag = F.lower(F.regexp_extract(plain, rf"^>?({NAME})", 1))
        return F.struct(
            F.startswith(t, F.lit(">")).alias("child"), tag.alias("tag"), F.regexp_extract(plain, rf"#({NAME})", 1).alias("id"),
            F.regexp_extract_all(plain, F.lit(rf"\.({NAME})"), F.lit(1)).alias("classes"), F.lower(F.regexp_extract(t, rf"\[({NAME})", 1)).alias("attribute"),
            F.when(F.contains(t, F.lit("=")), F.regexp_extract(t, r"=[\"']?([^\]\"']*)", 1)).alias("value"))

    tokens = F.split(F.regexp_replace(F.trim(selector), r"\s*>\s*", " >"), r"\s+(?![^\[]*\])")
    return F.transform(F.filter(tokens, lambda t: t != ""), step)


def matched(nodes: Column, steps: Column) -> Column:
    """Elements that a selector's steps lead to, in document order."""
    outside = F.array(F.struct(*[F.lit(-1 if f.name in ("pos", "depth") else (1 << 31) - 1 if f.name == "end" else None).cast(f.dataType).alias(f.name) for f in NODE.fields]))

    def holds(n: Column, s: Column) -> Column:
        given = F.try_element_at(n["attrs"], s["attribute"])
        classes = F.split(F.coalesce(F.try_element_at(n["attrs"], F.lit("class")), F.lit("")), r"[ \t\n\f\r]+")
        return ((n["kind"] == "e") & ((s["tag"] == "") | (n["tag"] == s["tag"])) & ((s["id"] == "") | (M.attr(n, "id") == s["id"]))
                & ((F.size(s["classes"]) == 0) | (F.size(F.array_except(s["classes"], classes)) == 0))
                & ((s["attribute"] == "") | (given.isNotNull() & (s["value"].isNull() | (given == s["value"])))))

    def further(scopes: Column, s: Column) -> Column:
        return F.filter(nodes, lambda n: holds(n, s) & F.exists(scopes, lambda a: M.inside(n, a) & (~s["child"] | (n["depth"] == a["depth"] + 1))))

    return F.when(F.size(steps) > 0, F.aggregate(steps, outside.cast(f"array<{NODE.simpleString()}>"), further))


def compiled(rules: DataFrame) -> DataFrame:
    """(site, rules): the rules of a source by field and order, their selectors as steps."""
    rule = F.struct("field", "ord", steps_of(F.col("selector")).alias("steps"), "mode", F.lower(F.coalesce("attribute", F.lit(""))).alias("attribute"), "take")
    return rules.select("site", rule.alias("r")).groupBy("site").agg(F.array_sort(F.collect_list("r")).alias("rules"))


def extract(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(columns of `pages`, field, values) for each field that a rule of the page's `site` fills.

    `pages` has `nodes` (see `sources.pages.with_nodes`), which are left out.  A page without rules, or
    whose rules find nothing, yields no row.  Nodes and rules meet by site; all rules of a page are
    applied beside each other in one row, so its nodes are never copied.
    """
    nodes = F.col("nodes")

    def value(n: Column, r: Column) -> Column:
        attribute = F.coalesce(M.trim_u(F.try_element_at(n["attrs"], r["attribute"])), F.lit(""))
        return (F.when(r["mode"] == "text", clean_text(M.node_text(nodes, n))).when(r["mode"] == "lines", clean_text(M.node_text_breaks(nodes, n)))
                .when(r["mode"] == "blocks", clean_text(M.chapter_text(nodes, n))).when(r["mode"] == "attr", attribute)
                .when((r["mode"] == "url") & (attribute != ""), absolute_url(url, attribute)))

    def found(r: Column) -> Column:
        values = F.filter(F.transform(matched(nodes, r["steps"]), lambda n: value(n, r)), lambda v: F.coalesce(v, F.lit("")) != "")
        return F.struct(r["field"].alias("field"), F.when(r["take"] == "first", F.slice(values, 1, 1)).otherwise(values).alias("values"))

    filled = F.filter(F.transform("rules", found), lambda f: F.size(f["values"]) > 0)
    kept = [c for c in pages.columns if c != "nodes"]
    rows = pages.join(compiled(rules), "site").select(*kept, filled.alias("_found"))
    # rules are in order of field and ord: the first of a field counts
    once = F.filter("_found", lambda f, i: (i == 0) | (F.get(F.col("_found"), i - 1)["field"] != f["field"]))
    return rows.select(*kept, F.explode(once).alias("_f")).select(*kept, "_f.field", "_f.values")
