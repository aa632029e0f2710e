"""Feature sections and components of specification texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FEATURE = r"(?i)^#{2,3}\s+.*\bfeature(?::|\s)"
_VERB = r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/[^\s`'\"),;]*)"


def feature_sections(specs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, feature, name, raw_text)``: each runs from its feature heading to the next one.

    Headings of level two or three that name a feature begin a section; other
    headings stay inside.  Text before the first is dropped.
    """
    lines = specs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    numbered = lines.withColumn("feature", F.sum(F.col("line").rlike(_FEATURE).cast("int")).over(order)).where("feature > 0")
    parts = numbered.groupBy(key, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda e: e["line"]).alias("rows"))
    name = F.trim(F.regexp_replace(F.element_at("rows", 1), r"(?i)^#{2,3}\s+(?:feature:?\s*)?", ""))
    return parts.select(key, "feature", name.alias("name"), F.array_join("rows", "\n").alias("raw_text"))


def feature_components(sections: DataFrame, key: str) -> DataFrame:
    """``(key, feature, name, kind, method, path)``: endpoints written as ``VERB /path`` in a section."""
    found = F.explode(F.array_distinct(F.arrays_zip(F.regexp_extract_all("raw_text", F.lit(_VERB), F.lit(1)).alias("method"), F.regexp_extract_all("raw_text", F.lit(_VERB), F.lit(2)).alias("path"))))
    return sections.select(key, "feature", "name", F.lit("api").alias("kind"), found.alias("c")).select(key, "feature", "name", "kind", F.upper("c.method").alias("method"), "c.path")


_COMPONENTS = "struct<backend:array<struct<type:string,identifier:string>>,frontend:array<struct<type:string,identifier:string>>>"


def components_from_json(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, side, kind, identifier)`` from JSON answers of a language model, fenced or not.

    An answer is an object with the lists ``backend`` and ``frontend`` of objects
    with ``type`` (api_endpoint, service_method, ui_screen, api_call) and
    ``identifier``.  Answers that are no such JSON, and empty ones, give no rows.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    parsed = answers.select(key, F.from_json(bare, _COMPONENTS).alias("p"))
    rows = None
    for side in ("backend", "frontend"):
        own = parsed.select(key, F.lit(side).alias("side"), F.explode(f"p.{side}").alias("c")).select(key, "side", F.col("c.type").alias("kind"), F.col("c.identifier").alias("identifier"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.where("identifier is not null")
