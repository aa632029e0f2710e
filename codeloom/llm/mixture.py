"""Mixing sources to target shares of tokens by balanced sampling.

Every record of a source is used ``floor(rate)`` times, and once more with
probability ``rate - floor(rate)``; which records are used once more is decided by
the cube method (Deville and Tillé 2004, in the fast form of Chauvet and Tillé
2006): the probabilities walk in the null space of the constraints, so that the
numbers of documents and of tokens keep their expected totals, until only as many
undecided records are left as there are constraints.  Undecided records of many
chunks meet in rounds of fan-in ``CHUNK_ROWS``, so no task holds a whole source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

#: Records one flight phase works through in a task.
CHUNK_ROWS = 20_000
#: Records of a source held back for the last round.
RESERVE_ROWS = 5_000


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping their sum and their size-weighted sum; at most two stay undecided.

    Three undecided records span one direction orthogonal to both constraints,
    the cross product of (1, 1, 1) and their sizes.  A step goes along it until a
    record is decided, to either end with the odds that keep the expectation.
    """
    p = p.astype(float).copy()
    near = 1e-9
    draws = iter(rng.random(len(p) + 8))
    live: list[int] = []
    for i in range(len(p)):
        if p[i] < near or p[i] > 1 - near:
            p[i] = round(p[i])
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for k, v in zip(live, u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < 0:
                    up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
            step = up if next(draws) * (up + down) < down else -down
            for k, v in zip(live, u, strict=True):
                p[k] += step * v
            rest = [k for k in live if near < p[k] < 1 - near]
            for k in live:
                if k not in rest:
                    p[k] = round(p[k])
            live = rest
    return p


def _systematic(p: np.ndarray, start: float) -> np.ndarray:
    """Decides the last records so that their number differs from its expectation by less than one."""
    reach = np.concatenate([[0.0], np.cumsum(p)]) + start
    return np.minimum(1, np.floor(reach[1:] + 1e-12) - np.floor(reach[:-1] + 1e-12))


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides all records, the large ones first.

    Records are taken in classes of halving size.  Each class flies and lands by
    itself; what its landing adds or lacks in tokens is spread over the
    probabilities of the smaller ones, so that the error left at the end is that
    of the smallest records.
    """
    p, out, error = p.astype(float), np.zeros(len(p)), 0.0
    rank = np.floor(np.log2(np.maximum(size, 1))).astype(int)
    for level in np.unique(rank)[::-1]:
        own, later = rank == level, rank <= level
        free = later & (p > 0) & (p < 1)
        room = float(size[free].sum())
        if error and room:
            moved = np.clip(p[free] - error / room, 0, 1)
            error += float(((moved - p[free]) * size[free]).sum())
            p[free] = moved
        wanted = float((p[own] * size[own]).sum())
        done = flight(p[own], size[own], rng)
        open_ = (done > 0) & (done < 1)
        done[open_] = _systematic(done[open_], rng.random())
        out[own] = done
        error += float((done * size[own]).sum()) - wanted
    return out


def _fly(last: bool, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["doc_id"].to_numpy(), kind="stable")))
        rng = np.random.default_rng([seed, group["chunk"][0].as_py(), group.num_rows])
        decide = settle if last else flight
        p = decide(group["p"].to_numpy(), group["n_tokens"].to_numpy().astype(float), rng)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p))

    return run


def balanced_extra(records: DataFrame, seed: int = 17, chunk_rows: int = CHUNK_ROWS, reserve_rows: int = RESERVE_ROWS) -> DataFrame:
    """``(doc_id, source, n_tokens, extra)`` for records with an inclusion probability ``p``.

    ``extra`` is 0 or 1.  Within each source the numbers of records and of tokens
    taken keep their expectation up to the landing of the smallest records.  A
    reserve of about ``reserve_rows`` records per source, drawn by hash, joins only
    in the last round, where it takes up what the landing of large records costs.
    """
    schema = "doc_id long, source string, n_tokens long, p double, chunk int"
    now = records.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("p").cast("double").alias("p"))
    counts = now.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 0
    done, turn, reserve = [], 0, None
    if most > chunk_rows:
        share = F.least(F.lit(1.0), F.lit(float(reserve_rows)) / F.col("__n"))
        held = now.join(counts, "source").withColumn("__held", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1 << 20)) < share * (1 << 20))
        reserve = held.where("__held").select(now.columns)
        now = held.where("not __held").select(now.columns)
    while most > chunk_rows:
        width = math.ceil(most / chunk_rows)
        now = now.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(width)).cast("int"))
        flown = cut_lineage(now.groupBy("source", "chunk").applyInArrow(_fly(False, seed + turn), schema))
        done.append(flown.where("p = 0 or p = 1"))
        now = flown.where("p > 0 and p < 1").select("doc_id", "source", "n_tokens", "p")
        most, turn = now.groupBy("source").count().agg(F.max("count")).first()[0] or 0, turn + 1
    rest = now.unionByName(reserve) if reserve is not None else now
    out = cut_lineage(rest.withColumn("chunk", F.lit(0)).groupBy("source").applyInArrow(_fly(True, seed + turn), schema))
    for part in done:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "n_tokens", F.round("p").cast("int").alias("extra"))


def source_plan(records: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source with a target: its tokens, wanted tokens, rate of use and whether the cap bites.

    ``total_tokens`` is the size of the mixture, by default the tokens of all
    records of sources with a target.  A source that cannot fill its share with
    ``max_repeats`` uses of every record is used that often and falls short.
    Sources are few by nature (one row each of ``weights``); a source named twice
    has its shares added and its smallest cap.
    """
    target = (
        weights.where(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    have = records.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_records"))
    plan = target.join(have, "source", "left").select(
        "source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), F.coalesce("source_records", F.lit(0)).alias("source_records")
    )
    everything = plan.agg(F.sum("source_tokens")).first()[0] if total_tokens is None else total_tokens
    wanted = F.col("target_share") * F.lit(float(everything or 0))
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("max_repeats").cast("double"), wanted / F.col("source_tokens"))).otherwise(0.0)
    return plan.withColumn("wanted_tokens", wanted).withColumn("rate", rate)


def mix_sources(records: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(doc_id, source, n_tokens, repeats)`` and its plan.

    ``records`` holds ``(doc_id, source, n_tokens)``.  Records without tokens and
    sources without a target take no part; a null source is no source.  Records
    used zero times are not in the result.  Equal input gives an equal mixture.
    """
    usable = cut_lineage(records.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens"))
    plan = cut_lineage(source_plan(usable, weights, total_tokens))
    rated = usable.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("base", F.floor("rate").cast("int"))
    extra = balanced_extra(rated.withColumn("p", F.col("rate") - F.col("base")), seed)
    mixed = extra.join(F.broadcast(plan.select("source", F.floor("rate").cast("int").alias("base"))), "source")
    return mixed.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra")).alias("repeats")).where(F.col("repeats") > 0), plan


def mixture_report(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and actual share, tokens used, greatest repetition and shortfall in tokens.

    ``actual_share`` is of what the mixture holds, ``share_of_wanted`` of what it
    was to hold: where a source falls short the first rises for all others.
    """
    used = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_repeats")
    )
    total = mixture.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0
    wanted = plan.agg(F.sum("wanted_tokens")).first()[0] or 0
    row = plan.join(used, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return row.select(
        "source",
        "target_share",
        "max_repeats",
        "source_records",
        "source_tokens",
        tokens.alias("tokens"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(tokens / F.lit(float(max(1, total))), 6).alias("actual_share"),
        F.round(tokens / F.lit(float(max(1, wanted))), 6).alias("share_of_wanted"),
        F.round(F.greatest(F.lit(0.0), F.col("wanted_tokens") - F.coalesce("tokens", F.lit(0))), 0).cast("long").alias("shortfall_tokens"),
    )
