"""Tree aggregation gives what a plain aggregation gives, whatever the tree."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators.skew import chunk_count, count_state, heavy_keys, max_state, min_state, profile_keys, sum_state, tree_aggregate, tree_rounds


def rows(spark, n=600):
    random.seed(3)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 17}", random.choice([None, "a", "b", f"p{i}"]), i % 40) for i in range(n)]
    return spark.createDataFrame(data, "key string, partner string, at int").withColumn("__chunk", F.lit(1))


@pytest.mark.parametrize("chunk_rows,fan_in", [(4, 2), (16, 3), (1 << 18, 32)])
def test_equals_plain_aggregation(spark, chunk_rows, fan_in):
    df = rows(spark)
    states = [count_state("n"), sum_state("s", "at"), min_state("lo", "at"), max_state("hi", "at")]
    got = tree_aggregate(df, ["key"], states, chunk_count(600, 4, chunk_rows), chunk_rows, fan_in)
    want = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("s"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_heavy_keys_and_nulls(spark):
    df = rows(spark)
    got = {tuple(r) for r in heavy_keys(df, ["key", "partner"], 0.2, chunk_rows=8, fan_in=2).collect()}
    count = {}
    for r in df.collect():
        for f in ("key", "partner"):
            count[f, r[f]] = count.get((f, r[f]), 0) + 1
    assert got == {(f, v, n) for (f, v), n in count.items() if v is not None and n >= 0.2 * 600}


def test_profile_counts_distinct_partners(spark):
    got = {r["key_value"]: r for r in profile_keys(rows(spark), "key", "partner", "at", chunk_rows=8, fan_in=2).collect()}
    data = rows(spark).collect()
    for key in {r["key"] for r in data}:
        own = [r for r in data if r["key"] == key]
        assert got[key]["n_rows"] == len(own)
        assert got[key]["n_partners"] == len({r["partner"] for r in own if r["partner"] is not None})
        assert got[key]["first_at"] == min(r["at"] for r in own)


def test_empty(spark):
    empty = rows(spark).where("false")
    assert heavy_keys(empty, ["key"], 0.01).count() == 0
    assert profile_keys(empty, "key", "partner", "at").count() == 0
    assert tree_rounds(1) == 1 and tree_rounds(33) == 2
