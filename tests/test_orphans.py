"""Orphans against brute force, with hot keys, nulls and empty tables."""

import datetime as dt
import random

from codeloom.operators.orphans import MOST_BLOCKS, blocks_for, bloom_filter, merge_intervals, orphan_references, orphan_report, probe
from pyspark.sql import functions as F

D = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = []
    for t, k, i, at in refs:
        alive = at is not None and k is not None and any(p == k and q == t and s is not None and s <= at and (e is None or at < e) for q, p, s, e in parents)
        if not alive:
            out.append((t, i))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    random.seed(5)
    keys = [f"k{i}" for i in range(30)] + [None]
    refs = [(random.choice("ab"), "k0" if i % 3 == 0 else random.choice(keys), i, None if i % 41 == 0 else D(random.randrange(100))) for i in range(500)]
    parents = [(random.choice("ab"), random.choice(keys), None if i % 19 == 0 else D(random.randrange(80)), None if i % 2 else D(random.randrange(100))) for i in range(60)]
    r = spark.createDataFrame(refs, "t string, k string, id long, at timestamp").withColumn("since", F.lit(1))
    p = spark.createDataFrame(parents, "t string, k string, since timestamp, until timestamp")
    for hot in (10, 50_000):
        got = orphan_references(r, p, ["t", "k"], ["t", "id"], "at", "since", "until", blocks=64, hot_rows=hot)
        assert sorted([(x["t"], x["id"]) for x in got.collect()], key=str) == brute(refs, parents)


def test_empty_parents_and_refs(spark):
    r = spark.createDataFrame([("a", "k", 1, D(1))], "t string, k string, id long, at timestamp")
    p = spark.createDataFrame([], "t string, k string, since timestamp, until timestamp")
    assert orphan_references(r, p, ["t", "k"], ["t", "id"], "at", "since", "until").count() == 1
    assert orphan_references(r.where("false"), p, ["t", "k"], ["t", "id"], "at", "since", "until").count() == 0


def test_bloom_never_loses_a_parent(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    probed = probe(keys.unionByName(spark.range(5000, 9000).select(F.xxhash64("id").alias("key"))), "key", bloom_filter(keys, "key", 256), "maybe", 256)
    assert probed.where("maybe").join(keys, "key", "left_semi").count() == 5000
    assert probed.where("not maybe").count() > 3000


def test_merged_intervals(spark):
    rows = [("a", D(1), D(3)), ("a", D(3), D(5)), ("a", D(7), None), ("a", D(9), D(9)), ("b", None, D(4)), ("b", D(2), D(4))]
    df = spark.createDataFrame(rows, "k string, s timestamp, e timestamp")
    got = sorted((r["k"], r["s"]) for r in merge_intervals(df, ["k"], "s", "e", chunks=3).collect())
    assert got == [("a", D(1)), ("a", D(7)), ("b", D(2))]


def test_report(spark):
    df = spark.createDataFrame([("t", D(1)), ("t", D(2)), ("t", D(40)), ("u", None)], "table_name string, at timestamp")
    assert {tuple(r) for r in orphan_report(df, "table_name", "at").collect()} == {("t", "2024-01", 2), ("t", "2024-02", 1), ("u", None, 1)}


def test_the_filter_still_rejects_with_ten_million_keys(spark):
    n = 10_000_000
    blocks = blocks_for(n)
    assert blocks == MOST_BLOCKS == blocks_for(10**12) and blocks_for(0) == 1 and blocks_for(17) == 2
    key = F.xxhash64("id").alias("key")
    bloom = bloom_filter(spark.range(n).select(key), "key", blocks)
    others = probe(spark.range(n, n + 200_000).select(key), "key", bloom, "maybe", blocks)
    assert others.where("maybe").count() < 2_000
    assert probe(spark.range(0, n, 1000).select(key), "key", bloom, "maybe", blocks).where("not maybe").count() == 0
