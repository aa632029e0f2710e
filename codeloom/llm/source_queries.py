"""Queries on source text (problems 1, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.docpairs import documented_symbols
from codeloom.llm.foreign import foreign_files
from codeloom.llm.syntax import invalid_rates, unparsable
from codeloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a tool produced, that were squeezed, copied from others, or hold data."""
    return foreign_files(table(spark, sf_dir, "source_file")).select("file_id").distinct()


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such files with their kind."""
    return foreign_files(table(spark, sf_dir, "source_file"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content is not valid in the language of their extension."""
    return unparsable(table(spark, sf_dir, "source_file"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of invalid files per repository, language and module."""
    sources = table(spark, sf_dir, "source_file")
    return invalid_rates(sources, table(spark, sf_dir, "files"), unparsable(sources))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed functions with real documentation."""
    return documented_symbols(table(spark, sf_dir, "source_file"), table(spark, sf_dir, "symbols")).select("file_id", "qualified_name").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation and code of indexed functions."""
    return documented_symbols(table(spark, sf_dir, "source_file"), table(spark, sf_dir, "symbols"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p3_found, p3_rates, p4_found, p4_pairs)}

SQL: dict[str, str] = {}
