"""Change detection, upserts and deletes on immutable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.rank import latest_per_key


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``keys`` and ``change``: added, changed, deleted or same, by comparing a version column (a hash).

    Null versions are equal to each other.  Keys must be unique on each side.
    """
    a = old.select(*keys, F.col(version).alias("__old"), F.lit(True).alias("__was"))
    b = new.select(*keys, F.col(version).alias("__new"), F.lit(True).alias("__is"))
    change = (
        F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "deleted").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"))


def unchanged_skipped(new: DataFrame, stored: DataFrame, keys: Sequence[str], version: str, force: bool = False) -> DataFrame:
    """Rows of ``new`` that must be processed: those without a stored row of equal key and version."""
    return new if force else new.join(stored.select(*keys, version).distinct(), [*keys, version], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; the result is a new table to be written aside and swapped.

    ``keep_old`` names columns in which a stored non-null value wins.  If a key
    occurs twice in ``new``, any one of its rows is taken; make them unique before.
    """
    fresh = new.dropDuplicates(list(keys))
    kept = old.join(fresh.select(*keys), list(keys), "left_anti")
    if keep_old:
        stored = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep_old]).dropDuplicates(list(keys))
        fresh = fresh.join(stored, list(keys), "left")
        for c in keep_old:
            fresh = fresh.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_latest(versions: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The latest version of each key of an append-only table; null times are oldest, ties go to the greater ``tie``."""
    return latest_per_key(versions, keys, [F.desc_nulls_last(time), F.desc(tie)])


def cascade_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is not among the deleted ``parents``; children without a parent stay."""
    gone = parents.select(F.col(parent_key).alias("__gone")).where(F.col("__gone").isNotNull()).distinct()
    return children.join(gone, F.col(child_key) == F.col("__gone"), "left_anti")


def set_flag(df: DataFrame, keys: DataFrame, key: str, column: str, value, own: str | None = None) -> DataFrame:
    """``df`` with ``column`` set for the rows whose key (named ``own`` in ``df`` if it differs) is in ``keys``."""
    hit = keys.select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, F.col(own or key) == F.col("__key"), "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).select(*df.columns)
