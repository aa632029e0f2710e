"""Traversals, components and figures on small graphs."""

import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.operators.components import connected_components
from codeloom.operators.graph import communities, degrees, modularity, reach, two_hops, undirected, weakest_link_paths
from codeloom.plans import registry

EDGES = [("a", "b", 0.9), ("a", "c", 0.5), ("b", "d", 0.8), ("c", "d", 0.9), ("d", "a", 0.7), ("d", "d", 1.0), ("b", "d", 0.6), ("x", "y", 1.0), (None, "a", 1.0)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, w double")


def test_reach_is_least_depth(spark):
    got = {r["node"]: r["depth"] for r in reach(edges(spark), spark.createDataFrame([("a",)], "start string"), "src", "dst", 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    both = reach(edges(spark), spark.createDataFrame([("a",), ("x",)], "start string"), "src", "dst", 1, carry_start=True)
    assert {(r["start"], r["node"]) for r in both.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}


def test_weakest_link(spark):
    got = {(r["node"], r["depth"], r["confidence"]) for r in weakest_link_paths(edges(spark), spark.createDataFrame([("d",)], "target string"), "src", "dst", "w", 2, least=0.55).collect()}
    assert ("b", 1, 0.8) in got and ("b", 1, 0.6) in got and ("a", 2, 0.8) in got and ("c", 1, 0.9) in got
    assert not any(n == "a" and c == 0.5 for n, _, c in got)


def test_components_against_union_find(spark):
    random.seed(7)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(3, 3), (None, 4)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    used = set()
    for a, b in pairs:
        if a is not None and a != b:
            used |= {a, b}
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "p long, q long"), "p", "q").collect()}
    assert got == {n: find(n) for n in used}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_degrees_and_modularity(spark):
    pairs = undirected(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "s string, d string"), "s", "d")
    assert {r["node"]: r["degree"] for r in degrees(pairs).collect()} == {"a": 2.0, "b": 3.0, "c": 3.0}
    member = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, community int")
    m = 4.0
    want = ((2 - 2 * 3 / (2 * m)) + (1 - 3 * 3 / (2 * m))) / m
    assert abs(modularity(pairs, member).first()[0] - want) < 1e-6


def test_two_cliques_split(spark):
    rows = [(1, a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [(1, "d", "w")]
    found = communities(spark.createDataFrame(rows, "repo int, s string, d string"), "repo", "s", "d")
    label = {r["node"]: r["community"] for r in found.collect()}
    assert len({label[n] for n in "abcd"}) == 1 and len({label[n] for n in "wxyz"}) == 1 and label["a"] != label["z"]


def test_reach_stops_at_the_limit_of_a_start(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y")], "src string, dst string")
    starts = spark.createDataFrame([("n0",), ("x",), (None,)], "start string")
    got = reach(chain, starts, "src", "dst", 9, carry_start=True, most=3).collect()
    assert sorted(r["depth"] for r in got if r["start"] == "n0") == [0, 1, 2, 3] and {r["node"] for r in got if r["start"] == "x"} == {"x", "y"}


def test_communities_go_on_until_nothing_moves(spark):
    # A long chain of cliques needs more rounds than a few.
    rows = [(1, f"{g:02d}{a}", f"{g:02d}{b}") for g in range(12) for a in "abcde" for b in "abcde" if a < b] + [(1, f"{g:02d}e", f"{g + 1:02d}a") for g in range(11)]
    found = communities(spark.createDataFrame(rows, "repo int, s string, d string"), "repo", "s", "d")
    label = {r["node"]: r["community"] for r in found.collect()}
    assert all(len({label[f"{g:02d}{a}"] for a in "abcde"}) == 1 for g in range(12))


def test_groups_in_tasks_and_in_rounds_move_alike(spark):
    random.seed(5)
    rows = [(g, f"n{random.randrange(30)}", f"n{int(30 * random.random() ** 2)}") for g in (1, 2, 3) for _ in range(25 * g)] + [(3, "é", "n1"), (3, None, "n2")]
    df = spark.createDataFrame(rows, "repo int, s string, d string")
    tasks, split = ({(r["repo"], r["node"]): r["community"] for r in communities(df, "repo", "s", "d", task_pairs=most).collect()} for most in (10_000, 40))
    assert tasks == split and {n for _, n in tasks} >= {"é", "n1"}


def test_many_small_groups_take_few_jobs(spark):
    # Jobs grew with the rounds when all groups moved in rounds of joins.
    rows = [(r, f"{g}{a}", f"{g}{b}") for r in range(20) for g in range(6) for a in "abcd" for b in "abcd" if a < b] + [(r, f"{g}d", f"{g + 1}a") for r in range(20) for g in range(5)]
    df = spark.createDataFrame(rows, "repo int, s string, d string")
    context = spark.sparkContext
    context.setJobGroup("communities", "counted")
    found = communities(df, "repo", "s", "d").collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("communities"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 20 * 24 and all(r["community"] is not None for r in found) and 0 < jobs < 20


def test_community_list_takes_few_jobs(spark):
    # Jobs grew with the rounds when all repositories moved in rounds of joins.
    query = registry.queries()["code_community_list"]
    context = spark.sparkContext
    context.setJobGroup("list", "counted")
    found = query(spark, "/root/testdata/sf0.001")
    jobs = len(context.statusTracker().getJobIdsForGroup("list"))
    context.setLocalProperty("spark.jobGroup.id", None)
    rows = found.collect()
    assert rows and 0 < jobs < 30 and all(r["member_count"] > 1 and 1 <= len(r["members"]) <= 3 for r in rows)


def test_numbered_groups_move_alike(spark):
    random.seed(6)
    rows = [(g, f"n{random.randrange(40)}", f"n{int(40 * random.random() ** 2)}") for g in (1, 2, 3) for _ in range(30 * g)] + [(3, "é", "n1"), (3, "é", "é"), (3, None, "n2")]
    df = spark.createDataFrame(rows, "repo int, s string, d string")
    named, numbered, mixed = ({(r["repo"], r["node"]): r["community"] for r in communities(df, "repo", "s", "d", **most).collect()} for most in ({}, {"named_pairs": 40}, {"named_pairs": 40, "task_pairs": 75}))
    assert named == numbered == mixed and {g for g, _ in named} == {1, 2, 3}


def test_rating_in_parts_moves_alike(monkeypatch):
    draw = np.random.default_rng(4)
    u, v = draw.integers(0, 90, 300), draw.integers(0, 90, 300)
    h = draw.integers(0, 2**63, 90).astype(np.uint64)
    whole = graph._moved(u, v, np.ones(300), h, 400)
    monkeypatch.setattr(graph, "RATED", 20)
    assert graph._moved(u, v, np.ones(300), h, 400).tolist() == whole.tolist()


def test_a_large_group_takes_few_jobs(spark):
    # A group of more than 500,000 pairs moved in rounds of joins, several jobs each.
    clique = spark.range(46).select(F.col("id").alias("a"))
    rows = spark.range(500).crossJoin(clique).crossJoin(clique.toDF("b")).where("a < b")
    df = rows.select(F.lit(1).alias("repo"), F.format_string("%03d.%02d", "id", "a").alias("s"), F.format_string("%03d.%02d", "id", "b").alias("d"))
    context = spark.sparkContext
    context.setJobGroup("large", "counted")
    found = communities(df, "repo", "s", "d").collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("large"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 40 and {(int(r["node"][:3]), r["community"]) for r in found} == {(i, i) for i in range(500)} and len(found) == 500 * 46


def test_two_hops(spark):
    left = spark.createDataFrame([("p", 1), ("q", 1), ("r", 2)], "a string, via int")
    assert {tuple(r) for r in two_hops(left, left.toDF("b", "via"), "a", "via", "b").collect()} == {("p", "q"), ("q", "p")}
