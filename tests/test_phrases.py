"""Phrases against a leftmost-longest scan, URL rules with and without a literal beginning."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from folioflow.functions.phrases import PhraseTrie, replaced
from folioflow.operators.urls import literal_prefix, resolve_urls


def scan(text, mapping):
    out, i = [], 0
    while i < len(text):
        hit = max((p for p in mapping if p and text.startswith(p, i)), key=len, default=None)
        out.append(mapping[hit] if hit else text[i])
        i += len(hit) if hit else 1
    return "".join(out)


def test_phrases_equal_a_scan():
    rng = random.Random(5)
    for letters in ("ab", "aé漢😀"):
        mapping = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): f"<{i}>" for i in range(12)} | {"": "never"}
        trie = PhraseTrie(mapping)
        texts = ["", None, "b", *("".join(rng.choice(letters + "x") for _ in range(rng.randint(0, 40))) for _ in range(300))]
        for most in (1, 50, 1 << 20):
            got = replaced(pd.Series(texts, dtype=object), trie, most).tolist()
            assert got == [None if t is None else scan(t, mapping) for t in texts]
    assert replaced(pd.Series(["abc", None], dtype=object), PhraseTrie({})).tolist() == ["abc", None]


def test_literal_beginnings_of_patterns(spark):
    patterns = {r"^/book/(\d+)": "/book/", r"^/b?x": "/", r"^/(a|b)/": "/", r"^/a|^/b": "", "/no/start": "", r"^/((a|b)|c)/x": "/", r"^/aé\.html$": "/aé", "^/" + "z" * 40: "/" + "z" * 23}
    got = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", literal_prefix(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == patterns


def test_rules_for_any_host_equal_a_loop(spark):
    rules = [("b", "b.com", r"^/x/(\d+)", 1, 0, 1, True), ("a", "a.com", r"^/x/(\d+)$", 1, 0, 2, True), ("a", "a.com", r"/(\d+)/(\d+)$", 1, 2, 1, True), ("c", "c.com", r"^/x/(\d+)", 1, 0, 1, False),
             ("d", "d.com", r"^/y(?:/z)?/(\d+)", 1, 0, 1, True)]
    paths = ["/x/12", "/x/12/13", "/y/4", "/y/z/4", "/q", "", "/x/"]
    urls = [f"https://{h}{p}" for h in ("c.com", "www.c.com", "other.net") for p in paths]
    got = {r.url: (r.site, r.book_id) for r in resolve_urls(
        spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "site string, host string, path_regex string, book_group int, chapter_group int, priority int, any_host boolean")).collect()}
    for u in urls:
        host, path = re.match(r"https://([^/]*)(.*)", u).groups()
        hits = [(0 if r[1] == host else 1 if r[1] == host.removeprefix("www.") else 2, r[0], r[5], r) for r in rules if (r[6] or r[1] in (host, host.removeprefix("www."))) and re.search(r[2], path)]
        best = min(hits, default=None)
        assert got[u] == ((best[3][0], re.search(best[3][2], path).group(best[3][3])) if best else (None, None)), u
