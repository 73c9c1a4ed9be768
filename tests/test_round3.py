"""Findings of the third round: whole pages and work that grows no faster than its input."""

from folioflow.queries import QUERIES, load_all

load_all()


def test_the_second_result_page_has_five_results(spark, tmp_path):
    parts = spark.range(1, 13).selectExpr("id AS p_partkey", "concat('cold widget ', id) AS p_name", "concat('b', id) AS p_brand", "'t' AS p_type", "1 AS p_size")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "s1")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    parts.selectExpr("p_partkey AS l_partkey", "1L AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(r.position for r in QUERIES["result_page"](spark, str(tmp_path)).collect()) == [6, 7, 8, 9, 10]


def test_nodes_are_made_of_few_pages_at_a_time():
    import pyarrow as pa

    from folioflow.sources.pages import _slices
    batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3, 4, 5, 6], "html": ["a" * 40, None, "b" * 70, "c" * 500, "", "d"]})
    parts = list(_slices(batch, 1, 100))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2], [3], [4], [5, 6]]
    assert list(_slices(batch.slice(0, 0), 1, 100)) == []


def test_small_files_are_dealt_by_what_becomes_of_them(spark, tmp_path):
    from folioflow.plans.sizing import estimated_bytes, in_pieces
    spark.range(10_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    cut = in_pieces(t, t, estimated_bytes(t) // 4)
    assert cut.rdd.getNumPartitions() >= 4 and cut.count() == cut.distinct().count() == 10_000


def test_hits_and_markup_do_not_grow_in_one_task(spark, sf, monkeypatch):
    from folioflow.queries import pages, views
    monkeypatch.setattr(views, "HIT_BYTES", 1 << 12)
    monkeypatch.setattr(pages, "MARKUP_BYTES", 1 << 8)
    assert "REPARTITION_BY_NUM" in views.hits(spark, sf)._jdf.queryExecution().toString()
    assert pages._cards(spark, sf).rdd.getNumPartitions() > 4 and pages._store(spark, sf).rdd.getNumPartitions() > 4


def test_rates_are_read_in_slices_and_in_order():
    import pandas as pd

    from folioflow.streaming.progress import _sorted_slices
    batches = [pd.DataFrame({"seq": s, "done": [x * 10 for x in s], "task_id": "t"}) for s in ([5, 1], [4, 2, 3])]
    parts = list(_sorted_slices(iter(batches), ["seq", "done"], most=2))
    assert [p["seq"].tolist() for p in parts] == [[1, 2], [3, 4], [5]] and parts[2]["done"].tolist() == [50]


def test_phrases_are_replaced_in_slices():
    import pyarrow as pa

    from folioflow.functions.phrases import PhraseTrie, replaced_in_slices
    texts = pa.array(["ab" * 30, None, "", "b", "ab" * 200, "xaby"])
    want = [None if t is None else t.replace("ab", "-") for t in texts.to_pylist()]
    assert replaced_in_slices(texts, PhraseTrie({"ab": "-"}), 50).to_pylist() == want
    assert replaced_in_slices(texts.slice(0, 0), PhraseTrie({"ab": "-"})).to_pylist() == []


def test_tokens_of_all_texts_are_counted(spark):
    from folioflow.llm import ngram_join
    docs = spark.createDataFrame([(i, i, f"{'one two' if i % 7 else 'three four'} only{i}") for i in range(70)], "id long, code long, text string")
    tokens, times = ngram_join.frequencies(docs, 2).value
    want = {int(ngram_join.token_set(t, 2)[0]): n for t, n in (("one two", 60), ("three four", 10))}
    assert dict(zip(tokens.tolist(), times.tolist(), strict=True)) == want


def test_ranges_of_tokens_are_cut_and_added():
    import numpy as np

    from folioflow.llm import ngram_join
    tokens = np.array([0, 5, 1 << 62, (1 << 64) - 1], np.uint64)
    rows = ngram_join.dealt(tokens, np.array([1, 2, 3, 4]), 3).to_pylist()
    assert [r["part"] for r in rows] == [0, 2] and b"".join(r["tokens"] for r in rows) == tokens.tobytes()
    assert np.frombuffer(b"".join(r["times"] for r in rows), np.uint32).tolist() == [1, 2, 3, 4]
    distinct, times = ngram_join.added(np.array([7, 3, 7, 9], np.uint64), np.array([1, 2, 5, 1], np.uint32))
    assert distinct.tolist() == [3, 7, 9] and times.tolist() == [2, 6, 1]


def test_either_search_of_the_pipeline_merges_documents(spark, monkeypatch):
    import corpus_pipeline as p
    from pyspark.sql import functions as F
    words = [" ".join(f"{a}{i}" for i in range(40)) for a in "abcd"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([words[0], words[0] + " more", words[1], words[2], words[3], "", None])], "doc_id long, text string")
    kept = lambda: sorted(r.doc_id for r in p.drop_near_duplicates(spark, docs, "").collect())
    assert kept() == [0, 2, 3, 4, 5]
    real = p.simhash.near_duplicates

    def third_and_fourth(rows, key, text, width):
        found = real(rows, key, text, width)
        least = F.least(*(F.lit(r["__key"]) for r in rows.where("doc_id in (2, 3)").select("__key").collect()))
        return found.withColumn("component_id", F.when(F.col("__key").rlike("^[23]:"), least).otherwise(F.col("component_id")))

    monkeypatch.setattr(p.simhash, "near_duplicates", third_and_fourth)
    assert kept() == [0, 2, 4, 5]
