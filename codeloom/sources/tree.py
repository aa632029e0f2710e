"""Source trees as DataFrames, and what changed in them."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.lexer import LANGUAGES

# Directories that are never scanned.
SKIPPED = ("vendor", "node_modules", ".git", "testdata", "__pycache__", ".venv", "venv", ".tox", ".eggs")
_SKIPPED = rf"(^|/)({'|'.join(d.replace('.', chr(92) + '.') for d in SKIPPED)})/"
_STATUS = {"A": "added", "M": "modified", "D": "deleted"}


def name_filter(extensions: Sequence[str]) -> str:
    """Glob of file names with these extensions in any case, so that other files are not even opened."""
    either = lambda ext: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return f"*{{{','.join(map(either, extensions))}}}"


def scan_tree(spark: SparkSession, root: str, repo: str, extensions: Sequence[str] = tuple(LANGUAGES)) -> DataFrame:
    """``(repo, path, content, hash)`` of the source files below ``root``, read in parallel.

    Paths are relative to the root.  The extension decides, whatever its case;
    directories of ``SKIPPED`` are left out; bytes that are no UTF-8 are replaced.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_filter(extensions)).load(root)
    base = re.sub(r"^[a-z][a-z0-9+.-]*:/+(?=/)|^file:/+", "/", root.rstrip("/") + "/")
    plain = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"%20", " ")
    relative = F.substring(plain, F.instr(plain, base) + len(base), F.length(plain))
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions) & ~F.col("path").rlike(_SKIPPED)
    return (
        files.select(relative.alias("path"), "content")
        .where(wanted)
        .select(F.lit(repo).alias("repo"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("hash"))
    )


def git_head(repository: str) -> str:
    """Commit a checkout stands at; empty if it is none."""
    try:
        done = subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def git_changes(spark: SparkSession, repository: str, old: str, new: str = "HEAD") -> DataFrame | None:
    """``(status, path)`` between two commits; a rename is a deletion and an addition.

    None if the commits cannot be compared, in which case everything is scanned.
    """
    try:
        done = subprocess.run(["git", "-C", repository, "diff", "--name-status", "-z", old, new], capture_output=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    if done.returncode:
        return None
    parts = [p.decode("utf-8", "replace") for p in done.stdout.split(b"\0") if p]
    rows, k = [], 0
    while k < len(parts):
        kind = parts[k][:1]
        if kind in "RC":
            if kind == "R":
                rows.append(("deleted", parts[k + 1]))
            rows.append(("added", parts[k + 2]))
            k += 3
        else:
            rows.append((_STATUS.get(kind, "modified"), parts[k + 1]))
            k += 2
    return spark.createDataFrame(rows, "status string, path string")


def read_lines(sources: DataFrame, repo: str, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Numbered lines of one indexed file, as ``(line, text)``; text reads like ``  12: code``.

    A path that leaves its repository (``..`` or absolute) gives no rows.
    """
    if path.startswith("/") or ".." in path.split("/"):
        return sources.select(F.lit(0).alias("line"), F.lit("").alias("text")).where(F.lit(False))
    rows = sources.where((F.col("repo") == repo) & (F.col("path") == path)).select(F.posexplode(F.split("content", r"\r?\n")).alias("at", "code"))
    number = F.col("at") + 1
    wanted = number >= start if end is None else number.between(start, end)
    return rows.where(wanted).select(number.alias("line"), F.format_string("%4d: %s", number, F.col("code")).alias("text"))
