"""From source files to the tables of the code index, whole or only what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import go, java, python, rows, script
from codeloom.extract.patterns import DEFAULT_PATTERNS, PatternSet
from codeloom.functions.lexer import language
from codeloom.operators.cdc import unchanged_skipped
from codeloom.operators.division import implementations
from codeloom.session import cut_lineage, ship_package, spread
from codeloom.sources.store import Store

#: Language to extractor; all take (path, text, patterns).
HANDLERS = {"go": go.extract_go, "java": java.extract_java, "python": python.extract_python, "ts": script.extract_script, "js": script.extract_script}
#: Tables derived from files; their rows go when a file goes.
FACTS = tuple(rows.TABLES)


def _extracted(patterns: PatternSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                results = []
                for path, text in zip(piece["path"].to_pylist(), piece["content"].to_pylist(), strict=True):
                    lang = language(path)
                    if lang is None or not text:
                        results.append(rows.FileResult())
                    else:
                        family = "ts" if lang == "js" else lang
                        results.append(HANDLERS[lang](path, text, patterns.of(family, path)))
                arrays = [piece[c] for c in ("file_id", "repo", "path")] + [pa.array([r.module for r in results], pa.string())]
                names = ["file_id", "repo", "path", "module"]
                for name, fields in rows.TABLES.items():
                    kind = pa.list_(pa.struct([(f, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for f, t in fields.items()]))
                    arrays.append(pa.array([getattr(r, name) for r in results], kind))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def extract_files(sources: DataFrame, patterns: PatternSet = DEFAULT_PATTERNS) -> DataFrame:
    """Nested facts of each file: ``file_id, repo, path, module`` and an array of structs per table.

    Each file is read once for all tables.  Null and empty texts, and files in
    other languages, have empty arrays.
    """
    ship_package(sources.sparkSession)
    own = sources.select(F.col("file_id").cast("long").alias("file_id"), F.col("repo").cast("string").alias("repo"), F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content"))
    return spread(own).mapInArrow(_extracted(patterns), f"file_id long, repo string, path string, module string, {rows.schema()}")


def facts(extracted: DataFrame, name: str) -> DataFrame:
    """One table of the nested facts, with a stable id."""
    flat = extracted.select("repo", "file_id", F.inline(name))
    return flat.withColumn("id", F.xxhash64(F.lit(name), *flat.columns))


def interface_rows(extracted: DataFrame) -> DataFrame:
    """Implementations found by comparing method sets: ``(repo, interface_name, struct_name, confidence)``."""
    wanted = facts(extracted, "interface_methods").withColumnRenamed("repo", "repo_id")
    have = facts(extracted, "receiver_methods").withColumnRenamed("repo", "repo_id")
    return implementations(wanted, have).withColumnRenamed("repo_id", "repo")


def index_sources(spark: SparkSession, sources: DataFrame, root: str, force: bool = False, patterns: PatternSet = DEFAULT_PATTERNS, full: bool = True) -> dict[str, int]:
    """Brings the index under ``root`` up to ``sources`` (``repo, path, content, hash``) and counts what was done.

    Files whose hash is stored are skipped unless ``force``.  Facts of changed
    files are replaced file by file, so that those of skipped files stay, links
    to other services included.  With ``full`` files that are no longer there are
    removed with all their facts.  Files without a repository are those of ''.  Only the repositories of changed or removed
    files are rewritten, and readers see all tables change at once.  The counts
    are those of the files, of the new rows per table, and of removed files.
    """
    store = Store(spark, root)
    state = store.manifest()
    own = sources.withColumn("repo", F.coalesce("repo", F.lit(""))).withColumn("file_id", F.xxhash64("repo", "path"))
    stored = store.read("files", state=state)
    empty = own.select("repo", "path", "hash").where(F.lit(False))
    changed = cut_lineage(unchanged_skipped(own, stored if stored is not None else empty, ["repo", "path"], "hash", force))
    gone = empty.select("repo", F.lit(0).cast("long").alias("file_id"))
    if full and stored is not None:
        seen = own.select("repo").distinct()
        gone = cut_lineage(stored.join(seen, "repo", "left_semi").join(own.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "file_id"))
    replaced = changed.select("repo", "file_id").unionByName(gone)
    counts = {r["repo"]: (r["new"], r["old"]) for r in _touched(changed, gone)}
    done = {"changed": sum(n for n, _ in counts.values()), "removed": sum(n for _, n in counts.values())}
    if not counts:
        return done | dict.fromkeys(FACTS, 0)
    extracted = cut_lineage(extract_files(changed, patterns))
    sizes = extracted.agg(*[F.sum(F.size(name)).alias(name) for name in FACTS]).first()
    now = changed.select("repo", "file_id", "path", "hash").join(extracted.select("file_id", "module"), "file_id").withColumn("last_scanned", F.current_timestamp())
    tables = {}
    for name in (*FACTS, "files"):
        fresh = now if name == "files" else facts(extracted, name)
        old = store.read(name, counts, state)
        tables[name] = fresh if old is None else old.join(replaced, ["repo", "file_id"], "left_anti").unionByName(fresh)
    store.write(tables, counts)
    return done | {name: sizes[name] or 0 for name in FACTS}


def _touched(changed: DataFrame, gone: DataFrame) -> list:
    """Changed and removed files per repository: one row for each repository of the batch, as in the manifest."""
    both = changed.select("repo", F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(gone.select("repo", F.lit(0).alias("new"), F.lit(1).alias("old")))
    return both.groupBy("repo").agg(F.sum("new").alias("new"), F.sum("old").alias("old")).collect()
