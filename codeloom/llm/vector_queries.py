"""Queries on symbol vectors (problems 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.forest import nearest_neighbours, similar_pairs
from codeloom.llm.grouping import describe_groups, similarity_groups
from codeloom.llm.vectors import latest_packed, latest_usable
from codeloom.session import table

#: Length of a result list and least cosine of a pair.
NEIGHBOURS = 5
MIN_COSINE = 0.80


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's five most similar, with a cosine of 0.80 or more."""
    usable = latest_packed(table(spark, sf_dir, "symbol_embeddings"))
    return similar_pairs(nearest_neighbours(usable, NEIGHBOURS, MIN_COSINE))


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked result lists of the symbols whose id is divisible by 100, with what a SearchResult shows."""
    vectors = table(spark, sf_dir, "symbol_embeddings")
    found = nearest_neighbours(latest_packed(vectors), NEIGHBOURS, queries="symbol_id % 100 = 0")
    shown = vectors.groupBy("symbol_id").agg(F.max_by(F.struct("file", "kind", "name", "line", "service"), F.struct("created_at", F.xxhash64("embedding"))).alias("p"))
    return found.join(shown.withColumnRenamed("symbol_id", "neighbour_id"), "neighbour_id").select(
        F.col("symbol_id").alias("query_symbol_id"), "rank", F.col("neighbour_id").alias("symbol_id"), F.round("score", 6).alias("score"), "p.file", "p.kind", "p.name", "p.line", "p.service"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in a group of two or more, with the group's smallest symbol_id."""
    groups, _, _, _ = similarity_groups(latest_usable(table(spark, sf_dir, "symbol_embeddings")), MIN_COSINE)
    return groups


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with size, medoid and the qualified names of their most typical members."""
    _, classes, degrees, links = similarity_groups(latest_usable(table(spark, sf_dir, "symbol_embeddings")), MIN_COSINE)
    return describe_groups(classes, degrees, table(spark, sf_dir, "symbols"), links, MIN_COSINE)


QUERIES = {f.__name__: f for f in (p2_found, p2_search, p5_found, p5_clusters)}

_PAIRS = f"""u AS (SELECT symbol_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT DISTINCT ON (symbol_id) symbol_id, embedding FROM symbol_embeddings WHERE symbol_id IS NOT NULL ORDER BY symbol_id, created_at DESC NULLS LAST)
 WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 10) AS s FROM u a JOIN u b ON a.id <> b.id) WHERE s >= {MIN_COSINE})"""

#: Exact: all pairs are compared.
SQL = {
    "p2_found": f"""WITH {_PAIRS}, k AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {NEIGHBOURS})
SELECT DISTINCT least(a, b) AS symbol_id_a, greatest(a, b) AS symbol_id_b FROM k""",
    "p2_search": f"""WITH {_PAIRS.replace(f"WHERE s >= {MIN_COSINE}", "WHERE a % 100 = 0")}, k AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM p QUALIFY rank <= {NEIGHBOURS}),
l AS (SELECT DISTINCT ON (symbol_id) symbol_id, file, kind, name, line, service FROM symbol_embeddings ORDER BY symbol_id, created_at DESC NULLS LAST)
SELECT a AS query_symbol_id, rank, symbol_id, round(s, 6) AS score, file, kind, name, line, service FROM k JOIN l ON l.symbol_id = k.b""",
    "p5_found": f"""WITH RECURSIVE {_PAIRS}, r(id, to_id) AS (SELECT a, b FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.to_id = p.a)
SELECT id AS symbol_id, least(id, min(to_id)) AS cluster_id FROM r GROUP BY id""",
}
