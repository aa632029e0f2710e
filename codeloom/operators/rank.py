"""Ranking, latest rows and fusion of result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``; give it a unique last column to settle ties.

    The rank filter lets Spark drop all but one row per key and partition before
    the shuffle, so a hot key costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of a total order with their rank from 1.

    The limit runs before the global rank, so one task ranks ``k`` rows at most.
    """
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(legs: Sequence[DataFrame], key: str, limit: int, k: int = 60) -> DataFrame:
    """``(key, score)``: sum of ``1 / (k + rank)`` over the legs, best ``limit`` rows, ties by key.

    A leg holds ``key`` and ``rank`` (from 1).  A key in one leg only keeps that
    leg's share; an empty leg changes nothing.
    """
    parts = [leg.select(key, (F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank")).cast("double")).alias("part")) for leg in legs]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(key).agg(F.round(F.sum("part"), 8).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def mode_per_group(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null value of each group and its count; ties go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return latest_per_key(counts, group, [F.desc("n"), F.asc(value)])


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two numeric arrays in double precision; null if one is null, zero or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest_to(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, least: float | None = None) -> DataFrame:
    """``(key, score, rank)`` of the ``k`` vectors most similar to ``query``; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).where(F.col("score").isNotNull())
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return top_k(scored, k, F.desc("score"), F.asc(key))
