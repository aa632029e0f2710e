"""Text tokens and ranked keyword search over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters or digits, in lower case.
TOKEN = r"[\p{L}\p{N}]+"

# English words without search value.
STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def tokens(column: Column | str) -> Column:
    """Lower-case tokens of a text in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def identifier_tokens(column: Column | str) -> Column:
    """Tokens of identifiers: camel case, snake case and dots are borders."""
    return tokens(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|_", " "))


def match_all(df: DataFrame, column: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose text holds every term as a token; no terms match nothing."""
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return df.where(F.lit(False))
    return df.where(F.size(F.array_intersect(tokens(column), F.array(*map(F.lit, wanted)))) == len(wanted))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("__t", lambda x: x == F.lit(term)))


def bm25(df: DataFrame, key: str, column: str, terms: Sequence[str], least: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(key, score)`` of rows that hold at least ``least`` of the terms (default all), by Okapi BM25.

    Term counts need no explode: each row counts its query terms with array
    functions, and one aggregate gives the corpus figures (rows, mean length and
    the document frequency of each term).  Null texts count as empty rows.
    """
    wanted = sorted({t.lower() for t in terms})
    lean = df.select(key, tokens(column).alias("__t")).select(
        key, F.size("__t").alias("__len"), *[_occurrences(t).alias(f"__f{i}") for i, t in enumerate(wanted)]
    )
    figures = lean.agg(
        F.count(F.lit(1)).alias("n"), F.avg("__len").alias("mean"), *[F.sum((F.col(f"__f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))]
    ).first()
    n, mean = figures["n"], figures["mean"] or 1.0
    score, held = F.lit(0.0), F.lit(0)
    for i in range(len(wanted)):
        d = figures[f"d{i}"] or 0
        idf = F.log(F.lit(1.0) + F.lit((n - d + 0.5) / (d + 0.5)))
        f = F.col(f"__f{i}").cast("double")
        score = score + idf * f * F.lit(k1 + 1) / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("__len") / F.lit(float(mean))))
        held = held + (F.col(f"__f{i}") > 0).cast("int")
    need = len(wanted) if least is None else least
    return lean.where(held >= need).select(key, score.alias("score"))


def postings(df: DataFrame, key: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """``(token, key, n, length)`` of each token of a row, and one row ``(rows, mean)``.

    ``words`` is an array of tokens.  The first table answers any search from the
    rows of its words alone; store it sorted or partitioned by token.
    """
    lean = df.select(key, words.alias("__t")).withColumn("__len", F.size("__t"))
    each = lean.select(key, "__len", F.explode("__t").alias("token")).groupBy("token", key, F.col("__len").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return each.select("token", key, "n", "length"), lean.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg("__len"), F.lit(0.0)).alias("mean"))


def bm25_of_postings(index: DataFrame, figures: DataFrame, key: str, terms: Sequence[str], least: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """What ``bm25`` gives, from the tables of ``postings``; only rows of the terms are read."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.where(F.col("token").isin(wanted))
    often = hits.groupBy("token").agg(F.count(F.lit(1)).alias("d"))  # at most one row for each term
    rated = hits.join(F.broadcast(often), "token")
    rows, mean = figures.first()
    idf = F.log(F.lit(1.0) + (F.lit(rows) - F.col("d") + 0.5) / (F.col("d") + 0.5))
    f = F.col("n").cast("double")
    part = idf * f * F.lit(k1 + 1) / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(mean or 1.0)))
    need = len(wanted) if least is None else least
    return rated.groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= need).select(key, "score")
