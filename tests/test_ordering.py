"""Skew-safe ordering against plain definitions, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from folioflow.plans import ordering as O


def rows(n=600):
    rnd = random.Random(5)
    return [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 9)}", i, rnd.choice([None, None, f"v{i}"]), rnd.randint(0, 5)) for i in range(n)]


def by_key(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_positions_and_running_values(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o long, v string, n int").repartition(9)
    want_no, want_last, want_sum, want_prev = {}, {}, {}, {}
    for k, group in by_key(data).items():
        last, total, prev = None, 0, None
        for i, (_, o, v, n) in enumerate(group, 1):
            last, total = v or last, total + n
            want_no[o], want_last[o], want_sum[o], want_prev[o] = i, last, total, prev
            prev = n
    for size in (1, 37, 10_000):
        block = O.block_of("o", size)
        assert {r.o: r.no for r in O.number_rows(df, ["k"], [F.col("o")], "no", block).collect()} == want_no
        run = O.running(df, ["k"], "o", block, last=("last", F.col("v")), total=("sum", F.col("n"))).collect()
        assert {r.o: r["last"] for r in run} == want_last
        assert {r.o: r.total for r in run} == want_sum
        assert {r.o: r.p for r in O.with_previous(df, ["k"], "o", block, p="n").collect()} == want_prev


def test_positions_for_any_order(spark):
    data = rows(300)
    df = spark.createDataFrame(data, "k string, o long, v string, n int")
    got = {r.o: r.no for r in O.number_rows_any(df, ["k"], [F.col("n").desc(), F.col("o")], "no").collect()}
    want = {}
    for group in by_key(data).values():
        for i, r in enumerate(sorted(group, key=lambda r: (-r[3], r[1])), 1):
            want[r[1]] = i
    assert got == want


def test_parts_join_to_the_whole_text(spark):
    df = spark.createDataFrame([("a", i, f"t{i}") for i in range(1, 26)], "k string, o long, t string").repartition(6)
    parts = O.join_text(df, ["k"], "o", "t", "|", F.floor((F.col("o") - 1) / 10)).orderBy("part").collect()
    assert len(parts) == 3
    assert "|".join(p.body for p in parts) == "|".join(f"t{i}" for i in range(1, 26))
