"""The tables of the code index under one root: written by repository, read as one snapshot.

A root holds one folder per write and a manifest for each state of the index.  A
write puts its rows into a fresh folder, partitioned by repository, and the next
manifest says for each table which folder has each repository.  Nothing that a
manifest names is ever changed, so a write may read what it replaces, a crash at
any point leaves the state before, and a batch rewrites only its repositories.
All file access goes through Hadoop's file systems: the root may be a path or a URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What the partition of rows without a repository is called.
NO_REPO = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Manifest:
    """State of an index: per table its schema and the folder that holds each repository."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)

    def repos(self, name: str) -> dict[str, str]:
        """Repository to folder, of one table."""
        return self.tables.get(name, {}).get("repos", {})


class Store:
    """Tables by name under ``root``; every table has a column ``repo``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._jvm = jvm

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The latest state; an empty one where nothing was written."""
        found = [int(n[9:-5]) for n in self._names(self.root) if n.startswith("manifest-") and n.endswith(".json")]
        if not found:
            return Manifest()
        return Manifest(max(found), json.loads(self._read_text(f"{self.root}/manifest-{max(found):09d}.json")))

    def read(self, name: str, repos: Iterable[str | None] | None = None, state: Manifest | None = None) -> DataFrame | None:
        """A table, or only some repositories of it ('' for none); None if it was never written or holds no rows."""
        state = state or self.manifest()
        held = state.repos(name)
        if repos is not None:
            wanted = {_partition(r) for r in repos}
            held = {r: at for r, at in held.items() if r in wanted}
        if not held:
            return None
        schema = StructType.fromJson(state.tables[name]["schema"])
        paths = [f"{self.root}/{at}/{name}/{r}" for r, at in sorted(held.items())]
        parts: dict[str, list[str]] = {}
        for path, at in zip(paths, (held[r] for r in sorted(held)), strict=True):
            parts.setdefault(at, []).append(path)
        out = None
        for at, own in sorted(parts.items()):
            one = self.spark.read.schema(schema).option("basePath", f"{self.root}/{at}/{name}").parquet(*own)
            out = one if out is None else out.unionByName(one)
        return out.withColumn("repo", F.coalesce("repo", F.lit("")))

    def write(self, tables: Mapping[str, DataFrame], repos: Iterable[str | None]) -> Manifest:
        """Replaces the given repositories in all given tables, in one step for all readers.

        A repository without rows in a table has none there afterwards; other
        repositories stay.  Fails if another write came between.
        """
        state = self.manifest()
        folder = f"data-{state.number + 1:09d}-{uuid.uuid4().hex[:8]}"
        gone = {_partition(r) for r in repos}
        for name, df in tables.items():
            df.write.mode("overwrite").partitionBy("repo").parquet(f"{self.root}/{folder}/{name}")
            held = {r: at for r, at in state.repos(name).items() if r not in gone}
            held |= {r: folder for r in self._names(f"{self.root}/{folder}/{name}") if r.startswith("repo=")}
            order = [c for c in df.columns if c != "repo"] + ["repo"]
            state.tables[name] = {"schema": json.loads(df.select(*order).schema.json()), "repos": held}
        self._commit(state)
        return state

    def _commit(self, state: Manifest) -> None:
        state.number += 1
        aside, final = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{state.number:09d}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(state.tables).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another write to {self.root} came between")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last ``keep`` states names; how many."""
        numbers = sorted(int(n[9:-5]) for n in self._names(self.root) if n.startswith("manifest-") and n.endswith(".json"))
        live: set[str] = set()
        for number in numbers[-keep:]:
            tables = json.loads(self._read_text(f"{self.root}/manifest-{number:09d}.json"))
            live |= {at for t in tables.values() for at in t["repos"].values()}
        old = [n for n in self._names(self.root) if n.startswith("data-") and n not in live and int(n[5:14]) <= numbers[-1]] if numbers else []
        for name in old:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest-{number:09d}.json"), False)
        return len(old)


def _partition(repo: str | None) -> str:
    """Folder of a repository, escaped as Spark does."""
    if repo is None or repo == "":
        return f"repo={NO_REPO}"
    special = set("\"#%'*/:=?\\\x7f{[]^") | {chr(c) for c in range(1, 32)}
    return "repo=" + "".join(f"%{ord(c):02X}" if c in special else c for c in repo)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the index under ``root``, or None if it was never written or holds no rows."""
    return Store(spark, root).read(name)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def render_json(df: DataFrame, limit: int) -> str:
    """The first rows (at most ``limit``) as an indented JSON list."""
    return json.dumps([json.loads(r[0]) for r in as_json(df.limit(limit)).collect()], indent=2, ensure_ascii=False)


def render_markdown(df: DataFrame, limit: int) -> str:
    """The first rows (at most ``limit``) as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit).collect()
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in r)} |" for r in rows])
