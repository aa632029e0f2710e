"""Traversals and figures of directed multigraphs given as edge tables."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

#: Joined pairs of a group up to which one task moves its nodes; larger groups move in rounds over all tasks.
TASK_PAIRS = 5_000_000
#: Joined pairs of a group up to which its task gets the nodes' names; above, Spark numbers the nodes and the task holds numbers only.
NAMED_PAIRS = 500_000
#: Neighbours that a task rates at once.
RATED = 1_000_000


def reach(edges: DataFrame, starts: DataFrame, src: str, dst: str, depth: int, start: str = "start", carry_start: bool = False, most: int | None = None) -> DataFrame:
    """Least number of steps from the start nodes to every node within ``depth``.

    ``starts`` holds the column ``start``; with ``carry_start`` each start has its
    own distances.  Gives ``(start,) node, depth``; starts have depth 0.  Each round
    joins the frontier with the edges, computed once, and drops visited nodes; only
    the frontier is computed and cut to the checkpoint folder, the visited set being
    the frontiers so far.  With ``most`` a start goes no further once it has more than ``most``
    nodes: those of the level in which that happens are complete.
    """
    keys = ["start", "node"] if carry_start else ["node"]
    first = starts.select(F.col(start).alias("node")).where(F.col("node").isNotNull()).distinct()
    if carry_start:
        first = first.withColumn("start", F.col("node"))
    steps = cut_lineage(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct())
    seen = front = cut_lineage(first.select(*keys).withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        if most is not None and carry_start and level > 1:
            front = front.join(seen.groupBy("start").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most), "start", "left_anti")
        after = front.join(steps, "node").select(*[F.col("next").alias("node") if k == "node" else F.col(k) for k in keys]).distinct()
        front = cut_lineage(after.join(seen, keys, "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def weakest_link_paths(edges: DataFrame, targets: DataFrame, src: str, dst: str, weight: str, depth: int, least: float = 0.0, target: str = "target") -> DataFrame:
    """Callers of the targets within ``depth`` steps: ``(node, depth, confidence)``.

    ``confidence`` is the smallest weight along a path.  Edges below ``least`` are
    left out before the walk.  Per level only distinct (node, confidence) remain,
    so walks through cycles and parallel edges do not multiply.
    """
    back = edges.where(F.col(weight) >= least).select(F.col(dst).alias("node"), F.col(src).alias("caller"), F.col(weight).cast("double").alias("w"))
    back = back.distinct()
    front = targets.select(F.col(target).alias("node")).distinct().withColumn("confidence", F.lit(1.0))
    levels = None
    for level in range(1, depth + 1):
        front = front.join(back, "node").select(F.col("caller").alias("node"), F.least("confidence", "w").alias("confidence")).distinct()
        front = cut_lineage(front)
        found = front.select("node", F.lit(level).alias("depth"), "confidence")
        levels = found if levels is None else levels.unionByName(found)
    return levels


def two_hops(left: DataFrame, right: DataFrame, a: str, via: str, b: str) -> DataFrame:
    """Distinct pairs ``(a, b)`` joined by a common ``via``; pairs of one node with itself are left out."""
    return left.select(a, via).distinct().join(right.select(via, b).distinct(), via).where(F.col(a) != F.col(b)).select(a, b).distinct()


def undirected(edges: DataFrame, src: str, dst: str, weight: Column | None = None) -> DataFrame:
    """``(u, v, w)`` with ``u <= v``: parallel edges and both directions add up."""
    return (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        .select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"), (weight if weight is not None else F.lit(1.0)).alias("w"))
        .groupBy("u", "v")
        .agg(F.sum("w").alias("w"))
    )


def degrees(pairs: DataFrame) -> DataFrame:
    """``(node, degree)`` of undirected pairs ``(u, v, w)``; a loop counts twice."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "w"), F.struct(F.col("v").alias("node"), "w"))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.w").alias("degree"))


def modularity(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """One row ``(modularity)``: sum over inner edges of ``w - d_u d_v / 2m``, divided by ``m``.

    ``member`` maps ``node`` to ``community``.  Null without edges.
    """
    degree = degrees(pairs)
    info = member.join(degree, "node", "left").select("node", "community", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    both = pairs.join(info.toDF("u", "cu", "du"), "u").join(info.toDF("v", "cv", "dv"), "v")
    inner = F.when(F.col("cu") == F.col("cv"), F.struct(F.col("w").alias("w"), (F.col("du") * F.col("dv")).alias("d")))
    sums = both.select("w", inner.alias("i")).agg(F.sum("w").alias("m"), F.sum("i.w").alias("iw"), F.sum("i.d").alias("id"))
    m = F.col("m")
    return sums.select(F.round((F.coalesce("iw", F.lit(0.0)) - F.coalesce("id", F.lit(0.0)) / (2 * m)) / m, 6).alias("modularity"))


def communities(edges: DataFrame, group: str, src: str, dst: str, rounds: int = 400, task_pairs: int = TASK_PAIRS, named_pairs: int = NAMED_PAIRS) -> DataFrame:
    """``(group, node, community)``: nodes move to the neighbouring community that raises modularity most.

    Groups of up to ``task_pairs`` joined pairs are moved whole in one task each, those above
    ``named_pairs`` as numbers given by Spark; still larger ones in rounds of joins and
    aggregates, so that a graph of any size is spread over all tasks.  All take the
    same steps.  In each round one half of the nodes, drawn anew by hash, may move, which keeps
    neighbours from swapping places.  Parallel edges add up and a loop counts twice
    in the degree.  Ties go to the smallest community; communities are numbered by
    their smallest node, so the result is the same on every run.  It ends when no
    node of any half wants to move; after ``rounds`` it warns and gives what there is.
    """
    g = F.col(group).alias("g")
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(group).isNotNull())
    pairs = cut_lineage(ends.select(g, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).groupBy("g", "u", "v").agg(F.count(F.lit(1)).cast("double").alias("w")))
    large = cut_lineage(pairs.groupBy("g").count().where(F.col("count") > min(task_pairs, named_pairs)))
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    hashed = pairs.join(large, "g", "left_anti").select("g", "u", "v", "w", F.xxhash64("g", "u").alias("hu"), F.xxhash64("g", "v").alias("hv"))
    found = hashed.groupBy("g").applyInArrow(_move_group(rounds), f"g {kind['g']}, node {kind['u']}, community int")
    numbered, spread = large.where(F.col("count") <= task_pairs), large.where(F.col("count") > task_pairs)
    if not numbered.isEmpty():
        found = found.unionByName(_move_numbered(pairs.join(numbered, "g", "left_semi"), rounds))
    if not spread.isEmpty():
        found = found.unionByName(_move_in_rounds(pairs.join(spread, "g", "left_semi"), rounds))
    return found.select(F.col("g").alias(group), "node", "community")


def _may_move(h: np.ndarray, turn: int) -> np.ndarray:
    """Whether Spark's ``xxhash64(g, u, turn)`` is even, from ``xxhash64(g, u)``."""
    p1, p2, p3, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = (h + (p5 + np.uint64(4))) ^ (np.full(1, turn, np.uint64) * p1)
    x = (x << np.uint64(23) | x >> np.uint64(41)) * p2 + p3
    x = (x ^ x >> np.uint64(33)) * p2
    x = (x ^ x >> np.uint64(29)) * p3
    return (x ^ x >> np.uint64(32)) & np.uint64(1) == 0


def _moved(u: np.ndarray, v: np.ndarray, w: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    """The community of each node; nodes are numbered in their order.

    A node is rated again only after a community that it or a neighbour is in has changed.
    """
    n = len(h)
    k, m = np.bincount(u, w, n) + np.bincount(v, w, n), w.sum()
    apart = u != v
    u, v, w = u[apart], v[apart], w[apart]
    start = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n) + np.bincount(v, minlength=n))])
    order = np.argsort(np.concatenate([u, v]), kind="stable")
    near, link = np.concatenate([v, u])[order], np.concatenate([w, w])[order]
    del order, u, v, w, apart
    c = np.arange(n)
    best, total, stale = c.copy(), k.copy(), np.ones(n, bool)

    def parts(nodes: np.ndarray):
        """Parts of the nodes, with the places of their neighbours and whose each is."""
        many = start[nodes + 1] - start[nodes]
        part = np.cumsum(many) // RATED
        for own in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(part)) + 1):
            of = np.repeat(np.arange(len(own)), many[own])
            first = start[nodes[own]] - (np.cumsum(many[own]) - many[own])
            yield nodes[own], first[of] + np.arange(len(of)), of

    def rate(nodes: np.ndarray) -> None:
        for own, at, of in parts(nodes):
            key = np.concatenate([of * n + c[near[at]], np.arange(len(own)) * n + c[own]])
            place = np.argsort(key)
            key = key[place]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            inner = np.add.reduceat(np.concatenate([link[at], np.zeros(len(own))])[place], new)
            node, choice = np.divmod(key[new], n)
            home, degree = choice == c[own][node], k[own][node]
            gain = inner * 2 * m - (total[choice] - np.where(home, degree, 0.0)) * degree
            # keys are sorted by node, then community; of equal gains one's own community is first
            begin = np.searchsorted(node, np.arange(len(own)))
            top = gain == np.maximum.reduceat(gain, begin)[node]
            least = np.minimum.reduceat(np.where(top, np.where(home, -1, choice), n), begin)
            best[own] = np.where(least < 0, c[own], least)
        stale[nodes] = False

    for turn in range(rounds):
        may = _may_move(h, turn)
        if (due := np.flatnonzero(stale & may)).size:
            rate(due)
        moves = np.flatnonzero(may & (best != c))
        if not moves.size:
            if (due := np.flatnonzero(stale)).size:
                rate(due)
            if (best == c).all():
                break
            continue
        touched = np.zeros(n, bool)
        touched[c[moves]] = touched[best[moves]] = True
        c[moves] = best[moves]
        total = np.bincount(c, k, n)
        inside = touched[c]
        stale |= inside
        for _, at, _ in parts(np.flatnonzero(inside)):
            stale[near[at]] = True
    else:
        warnings.warn(f"communities still move after {rounds} rounds", stacklevel=2)
    least = np.full(n, n)
    np.minimum.at(least, c, np.arange(n))
    return np.unique(least[c], return_inverse=True)[1]


def _move_group(rounds: int):
    """The rounds of one group in one task."""

    def run(pairs: pa.Table) -> pa.Table:
        both = pa.concat_arrays([*pairs["u"].chunks, *pairs["v"].chunks])
        coded = both.dictionary_encode()
        # nodes numbered in their order, so that the smallest number is the smallest node
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        names, n = coded.dictionary.take(pa.array(order)), len(order)
        at = number[coded.indices.to_numpy()].astype(np.int64)
        u, v, w = at[: len(pairs)], at[len(pairs) :], pairs["w"].to_numpy()
        h = np.empty(n, np.uint64)
        h[u], h[v] = pairs["hu"].to_numpy().view(np.uint64), pairs["hv"].to_numpy().view(np.uint64)
        community = _moved(u, v, w, h, rounds)
        return pa.table({"g": pairs["g"].take(pa.array(np.zeros(n, np.int64))), "node": names, "community": pa.array(community, pa.int32())})

    return run


def _move_numbered(pairs: DataFrame, rounds: int) -> DataFrame:
    """The rounds of one group in one task that gets numbers for the nodes: ``(g, node, community)``."""
    ends = pairs.select("g", F.explode(F.array("u", "v")).alias("node")).distinct()
    number = F.row_number().over(Window.partitionBy("g").orderBy("node")) - 1
    nodes = cut_lineage(ends.select("g", "node", number.alias("i"), F.xxhash64("g", "node").alias("h")))
    at = nodes.select("g", "node", "i")
    numbered = pairs.join(at.toDF("g", "u", "a"), ["g", "u"]).join(at.toDF("g", "v", "b"), ["g", "v"]).select(F.col("g").alias("of"), "a", "b", "w")

    def run(nodes: pa.Table, pairs: pa.Table) -> pa.Table:
        i = nodes["i"].to_numpy()
        h = np.empty(len(i), np.uint64)
        h[i] = nodes["h"].to_numpy().view(np.uint64)
        community = _moved(pairs["a"].to_numpy(), pairs["b"].to_numpy(), pairs["w"].to_numpy(), h, rounds)
        return pa.table({"g": nodes["g"], "i": nodes["i"], "community": pa.array(community[i], pa.int32())})

    kind = nodes.schema["g"].dataType.simpleString()
    moved = nodes.select("g", "i", "h").groupBy("g").cogroup(numbered.groupBy("of")).applyInArrow(run, f"g {kind}, i int, community int")
    return nodes.join(moved, ["g", "i"]).select("g", "node", "community")


def _move_in_rounds(pairs: DataFrame, rounds: int) -> DataFrame:
    """The rounds of groups of any size by joins and aggregates: ``(g, node, community)``."""
    pairs = cut_lineage(pairs)
    both = cut_lineage(pairs.where("u <> v").unionByName(pairs.where("u <> v").select("g", F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    total = pairs.groupBy("g").agg(F.sum("w").alias("m"))
    degree = pairs.select("g", F.explode(F.array(F.struct(F.col("u").alias("n"), "w"), F.struct(F.col("v").alias("n"), "w"))).alias("e")).groupBy("g", F.col("e.n").alias("u")).agg(F.sum("e.w").alias("k"))
    label = cut_lineage(degree.join(total, "g").select("g", "u", "k", "m", F.col("u").alias("c")))
    for turn in range(rounds):
        weight = label.groupBy("g", "c").agg(F.sum("k").alias("total"))
        inner = both.join(label.select("g", F.col("u").alias("v"), "c"), ["g", "v"]).groupBy("g", "u", "c").agg(F.sum("w").alias("inner"))
        choice = inner.unionByName(label.select("g", "u", "c", F.lit(0.0).alias("inner"))).groupBy("g", "u", "c").agg(F.sum("inner").alias("inner"))
        own = label.select("g", "u", "k", "m", F.col("c").alias("own"))
        rated = choice.join(own, ["g", "u"]).join(weight, ["g", "c"])
        at_home = F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("inner") * 2 * F.col("m") - (F.col("total") - at_home) * F.col("k")  # whole numbers, so equal gains are equal
        best = rated.withColumn("gain", gain).groupBy("g", "u", "k", "m", "own").agg(
            F.min_by("c", F.struct((-F.col("gain")).alias("a"), (F.col("c") != F.col("own")).alias("b"), F.col("c").alias("d"))).alias("best")
        )
        may = F.pmod(F.xxhash64("g", "u", F.lit(turn)), F.lit(2)) == 0
        after = cut_lineage(best.select("g", "u", "k", "m", F.when(may, F.col("best")).otherwise(F.col("own")).alias("c"), (F.col("best") != F.col("own")).alias("wants")))
        label = after.drop("wants")
        if after.where("wants").isEmpty():
            break
    else:
        warnings.warn(f"communities still move after {rounds} rounds", stacklevel=2)
    first = label.groupBy("g", "c").agg(F.min("u").alias("least"))
    number = first.withColumn("community", F.dense_rank().over(Window.partitionBy("g").orderBy("least")) - 1)
    return label.join(number, ["g", "c"]).select("g", F.col("u").alias("node"), "community")
