"""Queries on referential integrity and key skew of the code index (problems 6 and 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.orphans import orphan_references, orphan_report
from codeloom.operators.skew import heavy_keys, profile_keys
from codeloom.session import table

#: White space that is not part of a name.
BLANKS = " \t\n\r\f\u000b "
#: Calls below this confidence name no target.
MIN_CONFIDENCE = 0.8
#: A key is heavy from this share of all rows on.
HEAVY_SHARE = 0.01


def _name(column: str) -> Column:
    return F.btrim(F.col(column), F.lit(BLANKS))


def _package(qualified: Column) -> Column:
    """The part before the first dot; null without a dot."""
    return F.when(F.instr(qualified, ".") > 0, F.substring_index(qualified, ".", 1))


def call_references(calls: DataFrame, files: DataFrame, external: DataFrame) -> DataFrame:
    """Calls that name a target: ``(table_name, repo_id, package, name, id, loaded_at)``."""
    named = calls.where(F.col("confidence").cast("double") >= F.lit(MIN_CONFIDENCE)).select(
        F.lit("function_calls").alias("table_name"), "id", "file_id", "loaded_at", _name("callee_package").alias("package"), _name("callee_name").alias("name")
    )
    return _in_repo(named.where(F.col("package") != ""), files, external, F.col("package"))


def impl_references(impls: DataFrame, files: DataFrame, external: DataFrame) -> DataFrame:
    """Implementations as references to an interface by its qualified name."""
    bare = F.regexp_replace(_name("interface_name"), r"^\*+|\[[^\]]*\]|<[^>]*>", "")
    named = impls.select(
        F.lit("interface_impls").alias("table_name"), "id", "file_id", "loaded_at", F.lit("").alias("package"), F.btrim(bare, F.lit(BLANKS)).alias("name")
    )
    return _in_repo(named, files, external, F.substring_index("name", ".", 1))


def _in_repo(named: DataFrame, files: DataFrame, external: DataFrame, package: Column) -> DataFrame:
    """Adds repo_id and removes references into external packages.

    ``external`` is a fixed list of a few dozen packages, hence the broadcast.
    """
    outside = external.select(F.col("package").alias("__outside")).where(F.col("__outside").isNotNull()).distinct()
    inside = named.join(F.broadcast(outside), package == F.col("__outside"), "left_anti")
    where = files.select(F.col("id").alias("__file"), "repo_id")
    return inside.join(where, inside["file_id"] == where["__file"], "left").select("table_name", "repo_id", "package", "name", "id", "loaded_at")


def symbol_targets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """What references can point to, with the time each target exists.

    Every symbol is a target of calls under (package, name); an interface is also
    a target of implementations under its qualified name.
    """
    qualified = _name("qualified_name")
    own = symbols.select(
        "file_id",
        F.col("loaded_at").alias("since"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("function_calls").alias("table_name"), _package(qualified).alias("package"), _name("name").alias("name")),
                    F.when(F.col("kind") == "interface", F.struct(F.lit("interface_impls").alias("table_name"), F.lit("").alias("package"), qualified.alias("name"))),
                ),
                lambda t: t.isNotNull() & t["package"].isNotNull() & t["name"].isNotNull(),
            )
        ).alias("t"),
    )
    where = files.select(F.col("id").alias("__file"), "repo_id", F.col("deleted_at").alias("until"))
    return own.join(where, own["file_id"] == where["__file"], "inner").select("t.table_name", "repo_id", "t.package", "t.name", "since", "until")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orphan references: ``(table_name, id, loaded_at)``."""
    files, external = table(spark, sf_dir, "files"), table(spark, sf_dir, "external_package")
    refs = call_references(table(spark, sf_dir, "function_calls"), files, external).unionByName(
        impl_references(table(spark, sf_dir, "interface_impls"), files, external)
    )
    targets = symbol_targets(table(spark, sf_dir, "symbols"), files)
    return orphan_references(refs, targets, ["table_name", "repo_id", "package", "name"], ["table_name", "id"], "loaded_at", "since", "until")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan rows of function_calls and interface_impls."""
    return orphans(spark, sf_dir).select("table_name", "id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month of loaded_at."""
    return orphan_report(orphans(spark, sf_dir), "table_name", "loaded_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of callee_name and caller_qualified_name with at least 1 % of all calls."""
    return heavy_keys(table(spark, sf_dir, "function_calls"), ["callee_name", "caller_qualified_name"], HEAVY_SHARE).select("field", "key_value")


def p7_callee_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per callee_name: calls, distinct callers, first and last load."""
    return profile_keys(table(spark, sf_dir, "function_calls"), "callee_name", "caller_qualified_name", "loaded_at")


def p7_caller_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per caller_qualified_name: calls, distinct callees, first and last load."""
    return profile_keys(table(spark, sf_dir, "function_calls"), "caller_qualified_name", "callee_name", "loaded_at")


QUERIES = {f.__name__: f for f in (p6_found, p6_report, p7_found, p7_callee_profile, p7_caller_profile)}

_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"

_ORPHANS = rf"""
WITH t AS (SELECT trim(name, {_BLANK_SQL}) AS name, trim(qualified_name, {_BLANK_SQL}) AS qn, kind, s.loaded_at AS since, f.deleted_at AS until, f.repo_id
           FROM symbols s JOIN files f ON s.file_id = f.id),
c AS (SELECT x.id, x.loaded_at, f.repo_id, trim(callee_package, {_BLANK_SQL}) AS package, trim(callee_name, {_BLANK_SQL}) AS name
      FROM function_calls x LEFT JOIN files f ON x.file_id = f.id WHERE CAST(confidence AS DOUBLE) >= 0.8),
i AS (SELECT x.id, x.loaded_at, f.repo_id, trim(regexp_replace(trim(interface_name, {_BLANK_SQL}), '^\*+|\[[^\]]*\]|<[^>]*>', '', 'g'), {_BLANK_SQL}) AS name
      FROM interface_impls x LEFT JOIN files f ON x.file_id = f.id),
o AS (
SELECT 'function_calls' AS table_name, id, loaded_at FROM c WHERE package <> '' AND package NOT IN (SELECT package FROM external_package)
 AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo_id = c.repo_id AND t.name = c.name AND contains(t.qn, '.') AND split_part(t.qn, '.', 1) = c.package
                 AND t.since <= c.loaded_at AND (t.until IS NULL OR c.loaded_at < t.until))
UNION ALL
SELECT 'interface_impls', id, loaded_at FROM i WHERE coalesce(split_part(name, '.', 1), '') NOT IN (SELECT package FROM external_package)
 AND NOT EXISTS (SELECT 1 FROM t WHERE t.kind = 'interface' AND t.repo_id = i.repo_id AND t.qn = i.name
                 AND t.since <= i.loaded_at AND (t.until IS NULL OR i.loaded_at < t.until)))
"""


def _profile_sql(key: str, partner: str) -> str:
    return (
        f"SELECT {key} AS key_value, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {partner}) AS BIGINT) AS n_partners, "
        f"min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM function_calls GROUP BY {key}"
    )


SQL = {
    "p6_found": _ORPHANS + "SELECT table_name, id FROM o",
    "p6_report": _ORPHANS + "SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_orphans FROM o GROUP BY 1, 2",
    "p7_found": """
SELECT f AS field, v AS key_value FROM (
  SELECT 'callee_name' AS f, callee_name AS v, count(*) AS n FROM function_calls GROUP BY callee_name
  UNION ALL SELECT 'caller_qualified_name', caller_qualified_name, count(*) FROM function_calls GROUP BY caller_qualified_name)
WHERE v IS NOT NULL AND n >= 0.01 * (SELECT count(*) FROM function_calls)""",
    "p7_callee_profile": _profile_sql("callee_name", "caller_qualified_name"),
    "p7_caller_profile": _profile_sql("caller_qualified_name", "callee_name"),
}
