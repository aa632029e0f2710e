"""Relational division: which owners have everything that a set requires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import default_parallelism


#: Members of a class of equal owners that travel as one row, about.
BLOCK = 512


def covers(required: DataFrame, have: DataFrame, need: str, item: str, owner: str) -> DataFrame:
    """``(need, owner)`` where the owner has every item of the requirement.

    ``required`` holds ``(need, item)`` and ``have`` ``(owner, item)``; repeated rows
    count once, null items, needs and owners never match, and a requirement without items covers
    nobody.  Requirements of the same items are one, and so are owners: only the sets are
    divided.  The pairs of their members are made from blocks of about ``BLOCK`` of
    each, spread over the tasks, so that only the result grows with the pairs.
    """
    wanted, needs = _equal_sets(required, need, item)
    held, owners = _equal_sets(have, owner, item)
    sets = _divide(wanted.withColumnRenamed(need, "__set_n"), held.withColumnRenamed(owner, "__set_o"), [], "__set_n", item, "__set_o")
    n, o = _blocks(needs, need, "__n"), _blocks(owners, owner, "__o")
    blocks = sets.join(n, F.col("__set_n") == F.col("__n_set")).join(o, F.col("__set_o") == F.col("__o_set"))
    spread = blocks.repartition(4 * default_parallelism(have.sparkSession), "__set_n", "__n_block", "__set_o", "__o_block")
    return spread.select(F.explode("__n").alias(need), "__o").select(need, F.explode("__o").alias(owner))


def _equal_sets(rows: DataFrame, owner: str, item: str) -> tuple[DataFrame, DataFrame]:
    """``(owner, item)`` of one owner of each set of items, the smallest, and ``(set, owner)`` of all.

    Sets are told apart by their size and two sums of hashes, so no set is gathered in a row.
    """
    own = rows.select(owner, item).where(F.col(owner).isNotNull() & F.col(item).isNotNull()).distinct()
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), item).cast("decimal(20,0)"))
    told = own.groupBy(owner).agg(F.count(F.lit(1)).alias("c"), total(1).alias("s1"), total(2).alias("s2"))
    first = told.groupBy("c", "s1", "s2").agg(F.min(owner).alias("__set"))
    return own.join(first.select(F.col("__set").alias(owner)), owner, "left_semi"), told.join(first, ["c", "s1", "s2"]).select("__set", owner)


def _blocks(members: DataFrame, owner: str, name: str) -> DataFrame:
    """Members of each set in arrays of about ``BLOCK``: ``({name}_set, {name}_block, {name})``."""
    many = members.groupBy("__set").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("m"))
    placed = members.join(many, "__set").withColumn("b", F.pmod(F.xxhash64(owner), F.col("m")))
    return placed.groupBy(F.col("__set").alias(f"{name}_set"), F.col("b").alias(f"{name}_block")).agg(F.collect_list(owner).alias(name))


def _divide(required: DataFrame, have: DataFrame, group: list[str], need: str, item: str, owner: str) -> DataFrame:
    """Division within each ``group``.

    Candidates are the owners of a requirement's rarest item, so an item that most
    owners have pairs nobody by itself; the other items of a candidate are looked
    up by owner and item, and counted against the size of the requirement.
    """
    wanted = required.select(*group, need, item).where(F.col(item).isNotNull()).distinct()
    held = have.select(*group, owner, item).where(F.col(item).isNotNull()).distinct()
    often = held.groupBy(*group, item).agg(F.count(F.lit(1)).alias("__often"))
    rated = wanted.join(often, [*group, item], "left").select(*group, need, item, F.coalesce("__often", F.lit(0)).alias("__often"))
    rarest = rated.groupBy(*group, need).agg(F.min_by(item, F.struct("__often", item)).alias(item), F.count(F.lit(1)).alias("__size"))
    candidates = rarest.join(held, [*group, item]).select(*group, need, owner, "__size")
    matched = candidates.join(wanted, [*group, need]).join(held, [*group, owner, item])
    counted = matched.groupBy(*group, need, owner, "__size").agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") == F.col("__size")).select(*group, need, owner)


def implementations(interface_methods: DataFrame, methods: DataFrame, same_file: float = 0.85, cross_file: float = 0.75) -> DataFrame:
    """Structs that implement interfaces: ``(repo_id, interface_name, struct_name, confidence)``.

    ``interface_methods`` holds ``(repo_id, file_id, interface_name, method_name)``,
    ``methods`` ``(repo_id, file_id, struct_name, method_name)``.  A struct of the
    interface's own file has the higher confidence.  A struct's methods count over
    all files of the repository.
    """
    key = ["repo_id", "interface_name", "struct_name"]
    full = _divide(interface_methods, methods, ["repo_id"], "interface_name", "method_name", "struct_name")
    near = (
        interface_methods.select("repo_id", "file_id", "interface_name").distinct().join(methods.select("repo_id", "file_id", "struct_name").distinct(), ["repo_id", "file_id"]).select(*key).distinct().withColumn("__near", F.lit(True))
    )
    return full.join(near, key, "left").select(*key, F.when(F.col("__near"), F.lit(same_file)).otherwise(F.lit(cross_file)).alias("confidence"))
