"""Plan shape of the registered queries that must scale."""

import re

import pytest

from folioflow.queries import QUERIES, load_all

load_all()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["federated_search", "keyword_index_match", "merge_stored_chapters", "stored_chapter_lookup", "fallback_match", "windowed_rate",
                                  "shelf_fold", "chapter_range", "resolve_urls"])
def test_no_cross_join_and_no_python(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert not re.search(r"EvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas|BatchEvalPython", p)


@pytest.mark.parametrize("name", ["top_hits_per_source", "index_top_matches", "task_messages"])
def test_rank_limits_are_applied_before_the_shuffle(spark, sf, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(QUERIES[name](spark, sf)))


def test_scans_read_only_what_they_need(spark, sf):
    p = plan(QUERIES["pending_chapters"](spark, sf))
    assert "n_chars" not in "".join(re.findall(r"ReadSchema: [^\n]*", p))


@pytest.mark.parametrize("name", ["dedupe_chapters", "context_window", "chapter_range", "chapter_page", "renumber_chapters"])
def test_ordered_queries_read_their_table_once(spark, sf, name):
    # what is numbered is written once; a plain table is read a second time for its keys and blocks alone
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan(QUERIES[name](spark, sf)).split("== Physical Plan ==")[-1])
    wide = [s for s in scans if "l_orderkey" in s and s.count(",") > 2]
    assert len(wide) <= 1
