"""References whose target record does not exist at the time of the reference.

Two stages.  A blocked Bloom filter of all parent keys, built by ``bit_or``
aggregation entirely in the JVM, is sized from the number of keys up to a bound and
is therefore broadcast safely at any data size; a reference it rejects is an orphan
without further work.  Only the references it lets through are checked exactly
against the time intervals in which their target existed.  Parents and references
are read once each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

#: Keys wanted per block of 256 bits: about one in 400 other keys passes then.
BLOCK_KEYS = 16
#: Blocks of the filter at most: a broadcast of 2**20 rows of 36 bytes serves 16 million keys at that rate.  Beyond, the
#: filter keeps its size and lets more references through to the exact join (a third of the others at 100 million keys).
MOST_BLOCKS = 1 << 20
#: A key with more references than max(HOT_ROWS, references / HOT_SHARE) is salted; at most HOT_SHARE keys can be hot.
HOT_ROWS = 50_000
HOT_SHARE = 1_000
#: Salted chunks in the first of the two interval-merging steps.
MERGE_CHUNKS = 16

_WORDS = ("__w0", "__w1", "__w2", "__w3")
_FAR = "9999-12-31 00:00:00"


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit of word ``word`` that a key sets: six bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def blocks_for(keys: int) -> int:
    """Blocks of a filter for that many keys: a power of two, ``MOST_BLOCKS`` at most."""
    return min(MOST_BLOCKS, 1 << max(0, math.ceil(keys / BLOCK_KEYS) - 1).bit_length())


def bloom_filter(parents: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter of a 64-bit key column: one row per used block.

    Four bits are set in one 256-bit block per key.  The row count is at most
    ``blocks`` whatever the number of parents; beyond its capacity the filter
    only lets more references through to the exact check.
    """
    return (
        parents.select(_block(F.col(key), blocks).alias("__block"), *[_bit(F.col(key), i).alias(w) for i, w in enumerate(_WORDS)])
        .groupBy("__block")
        .agg(*[F.bit_or(w).alias(w) for w in _WORDS])
    )


def probe(refs: DataFrame, key: str, bloom: DataFrame, flag: str, blocks: int) -> DataFrame:
    """``refs`` with ``flag``: false if the key is certainly not a parent."""
    joined = refs.withColumn("__block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "__block", "left")
    hit = F.lit(True)
    for i, w in enumerate(_WORDS):
        hit = hit & (F.col(w).bitwiseAND(_bit(F.col(key), i)) != 0)
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__block", *_WORDS)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, chunks: int = MERGE_CHUNKS) -> DataFrame:
    """Half-open intervals of each key merged into disjoint ones.

    Merged in two steps, first within salted chunks of a key and then across
    them, so that a key with very many intervals is never one task's work:
    chunks collapse to few intervals before they meet.  Rows without a start
    never exist; a null end means "still there"; empty intervals vanish.
    """

    def islands(part: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(start, end)
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = part.withColumn("__new", F.when(reach >= F.col(start), 0).otherwise(1))
        numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")

    clean = (
        df.select(*keys, start, F.coalesce(F.col(end), F.lit(_FAR).cast(df.schema[end].dataType)).alias(end))
        .where(F.col(start).isNotNull() & (F.col(start) < F.col(end)))
        .groupBy(*keys, start)
        .agg(F.max(end).alias(end))
        .withColumn("__salt", F.pmod(F.xxhash64(start), F.lit(chunks)).cast("int"))
    )
    return islands(islands(clean, [*keys, "__salt"]).drop("__salt"), list(keys))


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    keys: Sequence[str],
    ref_id: Sequence[str],
    ref_time: str,
    parent_from: str,
    parent_to: str,
    blocks: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows of ``refs`` for which no parent exists at their ``ref_time``.

    ``refs`` and ``parents`` share the key columns ``keys``; a parent exists from
    ``parent_from`` (included) to ``parent_to`` (excluded; null: still there).
    Returns ``ref_id`` and ``ref_time`` columns.  A reference with a null key part
    has no possible target and is an orphan, as is one without a time; drop such
    rows before if they do not count.  Repeated rows stay repeated.  With an empty
    parent table every reference is an orphan.  ``blocks`` is by default what the
    number of parent lifetimes asks for.

    Hot keys: keys with more than ``hot_rows`` references are spread over salts,
    and only their few merged intervals are repeated per salt.
    """
    key = F.xxhash64(*keys)
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    spans = cut_lineage(merge_intervals(parents.where(complete).select(*keys, F.col(parent_from).alias("__from"), F.col(parent_to).alias("__to")), keys, "__from", "__to"))
    blocks = blocks_for(spans.count()) if blocks is None else blocks
    bloom = bloom_filter(spans.select(key.alias("__key")), "__key", blocks)
    probed = probe(refs.select(*dict.fromkeys([*keys, *ref_id, ref_time]), key.alias("__key")), "__key", bloom, "__hit", blocks)
    probed = cut_lineage(probed.withColumn("__maybe", F.col("__hit") & complete & F.col(ref_time).isNotNull()).drop("__hit"))
    surely, maybe = probed.where(~F.col("__maybe")).select(*ref_id, ref_time), probed.where("__maybe").drop("__maybe")

    counts = maybe.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    limit = max(hot_rows, maybe.count() // HOT_SHARE)
    hot = counts.where(F.col("__n") > limit).select("__key", F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__salts"))
    salted = maybe.join(F.broadcast(hot), "__key", "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*ref_id, F.lit(7)), F.coalesce("__salts", F.lit(1))).cast("int")
    )
    copies = (
        spans.withColumn("__key", key)
        .join(F.broadcast(hot), "__key", "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
        .drop("__key", "__salts")
    )
    on = (salted["__salt"] == copies["__salt"]) & (salted[ref_time] >= copies["__from"]) & (salted[ref_time] < copies["__to"])
    for k in keys:
        on = on & (salted[k] == copies[k])
    checked = salted.join(copies, on, "left_anti").select(*ref_id, ref_time)
    return surely.unionByName(checked)


def orphan_report(orphans: DataFrame, table_name: str, time: str) -> DataFrame:
    """Orphans counted for each table and month of ``time`` (null: no time)."""
    month = F.date_format(F.date_trunc("month", F.col(time)), "yyyy-MM")
    return orphans.groupBy(F.col(table_name).alias("table_name"), month.alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
