"""Queries on documents (problems 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.mixture import mix_sources, mixture_report
from codeloom.llm.residue import residue
from codeloom.llm.tokens import count_tokens, encode_texts
from codeloom.session import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return mix_sources(sized, table(spark, sf_dir, "source_weight"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, shortfalls included."""
    return mixture_report(*_mixed(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, error messages or script notices."""
    return residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the kinds of residue they hold."""
    return residue(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p9_mixture, p9_shares, p10_found, p10_kinds)}

SQL: dict[str, str] = {}
