"""Per-key results on heavily skewed keys by multi-level tree aggregation.

A plain ``groupBy(key)`` sends every partial state of a key to one reducer.  With
``M`` map tasks a hot key costs that reducer ``M`` states, and states that are
themselves large (sketches, top lists) make it the slowest task of the job.
:func:`tree_aggregate` first combines fixed-size chunks of the input where they
lie and then merges the states through rounds of fan-in ``fan_in``, so no task
ever receives more than ``fan_in`` states of one key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows combined into one state before anything moves.
CHUNK_ROWS = 1 << 18
#: States of one key that one task merges in a round.
FAN_IN = 32

State = tuple[str, Callable[[], Column], Callable[[Column], Column]]

_ROW_BITS = 33  # monotonically_increasing_id: the partition number stands above these bits


def count_state(name: str) -> State:
    """Number of rows."""
    return name, lambda: F.count(F.lit(1)), F.sum


def min_state(name: str, column: str) -> State:
    """Smallest non-null value; null if there is none."""
    return name, lambda: F.min(column), F.min


def max_state(name: str, column: str) -> State:
    """Largest non-null value; null if there is none."""
    return name, lambda: F.max(column), F.max


def sum_state(name: str, column: str) -> State:
    """Sum of the non-null values; null if there is none."""
    return name, lambda: F.sum(column), F.sum


def tree_rounds(chunks: int, fan_in: int = FAN_IN) -> int:
    """Merge rounds needed until one state per key is left."""
    rounds = 1
    while chunks > fan_in:
        chunks, rounds = math.ceil(chunks / fan_in), rounds + 1
    return rounds


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    states: Sequence[State],
    chunks: int,
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``df`` grouped by ``keys`` with mergeable ``states``, without a hot reducer.

    ``chunks`` bounds the number of input chunks (rows / ``chunk_rows`` plus the
    number of input partitions); it only sets the number of rounds.  A chunk is
    a run of ``chunk_rows`` rows of one partition, so the first combine is local
    and its output holds one row per key and chunk.  Each later round maps chunk
    ``c`` to ``c mod ceil(chunks / fan_in)`` and merges.

    Null keys form a group of their own as in SQL.  An empty input gives an empty
    result.  Columns of ``df`` that are not named do not take part, and working
    columns are named so that they cannot clash with ``keys`` or state names.
    """
    work = "__chunk"
    while work in keys or work in {s[0] for s in states} or work in df.columns:
        work += "_"
    position = F.monotonically_increasing_id()
    serial = F.shiftright(position, _ROW_BITS) * F.lit(7919) + F.shiftright(
        position.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), int(math.log2(chunk_rows))
    )
    width = max(1, chunks)
    level = (
        df.withColumn(work, F.pmod(F.xxhash64(serial), F.lit(width)).cast("int"))
        .groupBy(*keys, work)
        .agg(*[first().alias(name) for name, first, _ in states])
    )
    while width > fan_in:
        width = math.ceil(width / fan_in)
        level = (
            level.withColumn(work, F.pmod(F.col(work), F.lit(width)))
            .groupBy(*keys, work)
            .agg(*[merge(F.col(name)).alias(name) for name, _, merge in states])
        )
    return level.groupBy(*keys).agg(*[merge(F.col(name)).alias(name) for name, _, merge in states])


def chunk_count(rows: int, partitions: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """Upper bound of the chunks that ``rows`` in ``partitions`` fall into."""
    return rows // chunk_rows + partitions


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Values that hold at least ``share`` of all rows: ``(field, key_value, n_rows)``.

    All ``fields`` are counted in one pass over the columns named.  Null is not
    a value and never reported, but null rows count in the denominator.  Values
    are taken as stored.  An empty table has no heavy keys.
    """
    rows = df.count()
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields])).alias("p")
    ).select("p.field", "p.key_value")
    pairs = pairs.where(F.col("key_value").isNotNull())
    chunks = chunk_count(rows * len(fields), df.rdd.getNumPartitions(), chunk_rows)
    counts = tree_aggregate(pairs, ["field", "key_value"], [count_state("n_rows")], chunks, chunk_rows, fan_in)
    return counts.where(F.col("n_rows") >= F.lit(share) * F.lit(rows))


def profile_keys(df: DataFrame, key: str, partner: str, time: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Per value of ``key``: rows, distinct partners, first and last time.

    Rows are first reduced to ``(key, partner)`` pairs, which hash on both
    columns, so a hot key spreads over all tasks; the pair states are then merged
    up the tree.  The distinct count is exact: a pair occurs once after the first
    step.  Null partners and times are ignored, a null key is a group of its own.
    """
    rows = df.count()
    parts = df.rdd.getNumPartitions()
    pairs = (
        df.select(F.col(key).alias("key_value"), F.col(partner).alias("partner"), F.col(time).alias("at"))
        .groupBy("key_value", "partner")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        .withColumn("has", F.when(F.col("partner").isNotNull(), 1).otherwise(0).cast("long"))
    )
    return tree_aggregate(
        pairs,
        ["key_value"],
        [sum_state("n_rows", "n"), sum_state("n_partners", "has"), min_state("first_at", "lo"), max_state("last_at", "hi")],
        chunk_count(rows, parts, chunk_rows),
        chunk_rows,
        fan_in,
    )
