"""Resolve URLs to source, book and chapter by a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import bare_host, host_of, path_of

PREFIX = 24  # characters of a path by which rules for any host are found


def literal_prefix(pattern: Column) -> Column:
    """What every path that matches a pattern begins with, at most `PREFIX` characters; empty where the
    pattern is not bound to the beginning or has alternatives at its top."""
    top = pattern
    for _ in range(4):  # groups inside groups
        top = F.regexp_replace(top, r"\([^()]*\)", "")
    # a character that a repeat count follows may be missing
    plain = F.regexp_extract(pattern, r"^\^((?:[^\\\[\](){}.*+?|^$](?![*?{]))*)", 1)
    return F.when(F.contains(top, F.lit("|")), F.lit("")).otherwise(F.substring(plain, 1, PREFIX))


def resolve_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Match URLs against rules (site, host, path_regex, book_group, chapter_group, priority, any_host).

    Rules of the URL's own host, or of the host without www, come first; then, of the rules that may match
    any host, every source in alphabetical order.  Within a source the lowest priority wins;
    `chapter_group` 0 means the rule yields no chapter.  URLs that no rule matches keep NULLs.

    Both sides list their keys as rows: a URL its hosts and the beginnings of its path, a rule its host
    and, for any host, the literal beginning of its pattern.  So all alternatives are one equi-join, and
    only patterns that can match are tried.
    """
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    rule = F.struct("site", "priority", "path_regex", "book_group", "chapter_group")
    own = rules.select(key("host", F.col("host")).alias("_k"), rule.alias("_rule"))
    any_ = rules.filter("any_host").select(key("path", literal_prefix(F.col("path_regex"))).alias("_k"), rule.alias("_rule"))
    parts = urls.select(url).distinct().select(url, host_of(url).alias("_h"), bare_host(url).alias("_b"), path_of(url).alias("_path"))
    begins = F.transform(F.sequence(F.lit(0), F.least(F.char_length("_path"), F.lit(PREFIX))), lambda n: F.struct(F.lit(2).alias("tier"), key("path", F.substring("_path", F.lit(1), n)).alias("k")))
    hosts = F.array(F.struct(F.lit(0).alias("tier"), key("host", F.col("_h")).alias("k")), F.struct(F.lit(1).alias("tier"), key("host", F.col("_b")).alias("k")))
    asked = parts.select(url, "_path", F.explode(F.concat(hosts, begins)).alias("_a")).select(url, "_path", F.col("_a.tier").alias("_tier"), F.col("_a.k").alias("_k"))
    hit = (asked.join(own.unionByName(any_), "_k").filter(F.regexp_like("_path", F.col("_rule.path_regex")))
           .groupBy(url).agg(F.min(F.struct("_tier", "_rule"))["_rule"].alias("_r")))
    at = lambda group: F.expr(f"regexp_extract(_path, _r.path_regex, _r.{group})")
    found = F.col("_r").isNotNull()
    resolved = parts.join(hit, url, "left").select(
        url, F.col("_r.site").alias("site"), F.when(found, at("book_group")).alias("book_id"),
        F.when(found, F.when(F.col("_r.chapter_group") > 0, at("chapter_group")).otherwise(F.lit(""))).alias("chapter_id"),
        F.when(found, F.concat(F.lit("https://"), "_b", "_path")).alias("canonical"))
    return urls.join(resolved, url, "left")
