"""Source files that were not written by hand in their repository.

Four kinds: generated by a tool, minified for delivery, vendored from third
parties, and data kept as code.  Vendored copies are found by Merkle hashes first:
files and directories are hashed bottom-up, and a subtree that occurs in
repositories unrelated to each other is a copy.  Every file carries its hash up its
chain of directories, and the hash of a directory is an order-free sum of what
arrives, so a tree of any depth takes one aggregation.  Copies that the collection
holds once, and the other kinds, are told by a file's own path, header and layout.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.functions import find_functions
from codeloom.functions.lexer import COMMENT, NEWLINE, Token, language, lex
from codeloom.session import cut_lineage, spread

#: Characters of code (without white space and leading comments) from which on an equal copy says something.
MIN_SHARED_CHARS = 200
#: Two repositories that have more than this share of the files of both in common are forks of each other.
FORK_SHARE = 0.5
_ALL = (1 << 64) - 1

# Directories that hold third-party code.
VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|node_modules|third[_-]?party|3rd[_-]?party|godeps|deps|externals?|extern|vendored|site-packages|dist-packages|bower_components|jspm_packages|static/lib)/", re.I)
# Statements of a foreign origin in a file's leading comment.
VENDOR_HEADER = re.compile(
    r"(?:copied|taken|imported|vendored|pulled in)(?: verbatim| unchanged| as is| unmodified)? from (?:the )?[\w./@-]+(?: (?:project|library|package|repository)\b| v?\d)|^\W*upstream: \S+,? (?:release|version|tag|commit)\b|\bvendored (?:copy|from)\b|third[- ]party (?:code|source|library), do not (?:edit|modify)",
    re.I | re.M,
)
# Statements in a leading comment that a tool wrote the file.
TOOL_HEADER = re.compile(
    r"\bcode generated (?:by|from)\b|@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|by|from)\b|\bmachine[- ](?:written|generated)\b|\b(?:was|is|been) (?:created|generated|written|produced) automatically\b|\bautomatically (?:created|generated|written|produced)\b"
    r"|\bcompiled from (?:template )?\S+\.\w+|\bderived from \S+\.\w+ by \S+|\bproduced by \S+ (?:at|during|on|from)\b|\boutput of \S+\s*[;,].*(?:overwritten|regenerated|checksum|do not)|\S+: output of \S+|\S+ wrote this\b.*|\bgenerated (?:by|from|with|using) (?:the )?\S+.*\b(?:do not|don't|never|not) (?:edit|modify|change|touch)"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bfichier (?:généré|créé|produit)\b|\bgénéré (?:par|automatiquement)\b|\b(?:generado|creado) (?:por|automáticamente)\b|\barchivo generado\b",
    re.I,
)
# What a person writes about generators.
HAND_HEADER = re.compile(r"\bhand-?written\b|\bmaintained by hand\b|\bnothing (?:in here )?is generated\b|\bwas generated once\b|\b(?:never|not) (?:auto-?)?generated\b|\bdriver for the\b|\bgenerator\b.*\bwhich writes\b", re.I)
# File names that only code generators give.
TOOL_NAME = re.compile(r"(?:\.pb\.(?:go|cc|h)|\.pb\.gw\.go|_pb2(?:_grpc)?\.pyi?|_grpc\.pb\.go|_pb\.(?:js|ts|jsx|tsx)|\.g\.(?:ts|tsx|js|dart)|\.(?:generated|gen|auto)\.[a-z]+|_generated\.[a-z]+|OuterClass\.java|Grpc\.java|zz_generated[\w.]*\.go|bindata\.go|\.designer\.[a-z]+)$", re.I)

_LEAD = re.compile(r"\s*(?://[^\n]*(?:\n|$)|#[^\n]*(?:\n|$)|/\*(?s:.*?)\*/|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)''')")
_WORDS = re.compile(r"\w+")
_NAMES = re.compile(r"[A-Za-z_$][\w$]*")


def normal_path(path: str | None) -> str:
    """A path with forward slashes and without empty, ``.`` and leading parts."""
    return "/".join(p for p in re.split(r"[\\/]+", (path or "").strip()) if p not in ("", "."))


def leading_comment(text: str) -> tuple[str, str]:
    """Comments before the first code, and the rest of the text."""
    at = 0
    text = text.lstrip("\ufeff")
    while (m := _LEAD.match(text, at)) and m.end() > at:
        at = m.end()
    return text[:at], text[at:]


def _is_generated_header(lead: str) -> bool:
    return any(TOOL_HEADER.search(line) and not HAND_HEADER.search(line) for line in lead.split("\n"))


def _is_minified(body: str, name: str) -> bool:
    lines = [line for line in body.split("\n") if line.strip()]
    if not lines or len(body) < 400:
        return False
    named = re.search(r"[.-]min\.\w+$|\.bundle\.\w+$", name, re.I) is not None
    if len(body) / len(lines) < (80 if named else 150) or max(map(len, lines)) < 250:
        return False
    blank = sum(body.count(c) for c in " \t\n\r") / len(body)
    names = _NAMES.findall(body)
    short = sum(len(n) <= 3 for n in names) / max(1, len(names))
    return blank < 0.12 and len(names) > 40 and short >= (0.3 if named else 0.45)


#: Share of the text that uniform functions make up at least, and their mean length at most.
UNIFORM_SHARE = 0.35
UNIFORM_CHARS = 250


def _literal_share(tokens: list[Token]) -> tuple[int, float]:
    """Characters in literals and the share they and their separators have of the code."""
    literal = other = 0
    for kind, start, end in tokens:
        if kind in (COMMENT, NEWLINE):
            continue
        if kind in "ds":
            literal += end - start
        elif kind not in ",:+()[]{}u;":
            other += end - start
    return literal, literal / max(1, literal + other)


def _is_uniform(text: str, lang: str, markup: bool, tokens: list[Token]) -> bool:
    """Whether the file is a run of short functions that differ in names only."""
    if text.count("(") + text.count("=>") < max(3, UNIFORM_SHARE * len(text) / UNIFORM_CHARS):  # every function has one or the other
        return False
    functions = find_functions(text, lang, markup, tokens)
    if len(functions) < 3:
        return False
    size = sum(f.end - f.start for f in functions)
    if size / len(functions) > UNIFORM_CHARS or size < UNIFORM_SHARE * len(text):
        return False
    shapes = Counter(re.sub(r"\s+", " ", _WORDS.sub("w", text[f.start : f.end])) for f in functions)
    return shapes.most_common(1)[0][1] >= 0.9 * len(functions)


def judge(path: str, text: str | None) -> str | None:
    """Kind of a file by its own path, header and layout, or None.

    Empty text is hand-written unless its directory is one of third-party code.
    """
    where = normal_path(path)
    if VENDOR_DIR.search(where):
        return "vendored"
    if not text or not text.strip():
        return None
    lead, body = leading_comment(text)
    if VENDOR_HEADER.search(lead):
        return "vendored"
    if _is_generated_header(lead):
        return "generated"
    name = where.rsplit("/", 1)[-1]
    if TOOL_NAME.search(name):
        return "generated"
    if _is_minified(body, name):
        return "minified"
    lang = language(path)
    if lang:
        markup = lang == "js" or path.rstrip().lower().endswith("x")
        tokens = lex(body, lang, markup)
        literal, share = _literal_share(tokens)
        if literal >= 300 and share >= 0.85:
            return "data"
        if _is_uniform(body, lang, markup, tokens):
            return "generated"
    return None


def carried_up(where: str, content: int) -> list[int]:
    """Hashes by which a file's content enters each of its directories, the deepest first.

    On the way up each hash is taken together with the name of the directory it
    leaves; the root of the repository is no directory.
    """
    out = []
    for name in reversed(where.split("/")[:-1]):
        content = xxhash.xxh64_intdigest(f"{content & _ALL:x}/{name}".encode("utf-8", "surrogatepass")) - (1 << 63)
        out.append(content)
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, repos, paths, texts = (batch[c].to_pylist() for c in ("file_id", "repo", "path", "content"))
        rows = []
        for file, repo, path, text in zip(files, repos, paths, texts, strict=True):
            code = "".join(leading_comment(text)[1].split()) if text else ""
            where = normal_path(path)
            own = xxhash.xxh64_intdigest(code.encode("utf-8", "surrogatepass")) - (1 << 63)
            rows.append((file, repo or "", where, judge(path or "", text), own, carried_up(where, own), len(code)))
        cells = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (batch.schema.field("file_id").type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["file_id", "repo", "path", "kind", "hash", "up", "chars"])


def merkle_nodes(files: DataFrame) -> DataFrame:
    """``(repo, path, node, chars, is_file)`` of every file and directory: its place and its hash.

    ``files`` holds ``repo``, ``path`` (normal form), the content ``hash``, the hashes
    ``up`` by which it enters its directories (:func:`carried_up`) and its ``chars``.
    The hash of a directory is an order-free sum over what comes up from below, so a
    tree of any depth and a directory of any size take one aggregation with partial
    sums.  A file node is hashed with the name of its directory (none in the root),
    so equal boilerplate under different roofs is no copy, while a renamed file of a
    copied directory still is.
    """
    parts = F.split("path", "/")
    leaves = files.select("repo", "path", F.xxhash64(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("")), "hash").alias("node"), "chars", F.lit(True).alias("is_file"))
    below = files.select("repo", parts.alias("p"), "chars", F.posexplode("up").alias("n", "h"))
    place = F.array_join(F.slice("p", F.lit(1), F.size("p") - 1 - F.col("n")), "/")
    sums = (
        below.select("repo", place.alias("path"), "h", "chars")
        .groupBy("repo", "path")
        .agg(F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("x"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
        .select("repo", "path", F.xxhash64(F.col("s").cast("string"), "x", "n").alias("node"), "chars", F.lit(False).alias("is_file"))
    )
    return leaves.unionByName(sums)


def families(files: DataFrame) -> DataFrame:
    """``(repo, family)`` of repositories that are forks: they share most of their files with one other repository.

    Every shared content links its repositories to the smallest of them, so a file
    in any number of repositories gives one link each; files without code do not count.  Two repositories are related
    if links join more than ``FORK_SHARE`` of the files of both; the family is the
    smaller name.  Others are their own family and have no row.
    """
    own = files.where("chars > 0").groupBy(F.col("hash").alias("node"), "repo").agg(F.count(F.lit(1)).alias("n"))
    hub = own.groupBy("node").agg(F.min("repo").alias("hub"), F.max("repo").alias("last")).where("hub <> last").select("node", "hub")
    links = own.join(hub, "node").where("repo <> hub").groupBy("repo", "hub").agg(F.sum("n").alias("n"))
    size = own.groupBy("repo").agg(F.sum("n").alias("size"))
    rated = links.join(size, "repo").join(size.toDF("hub", "hub_size"), "hub")
    related = rated.where((F.col("n") > F.lit(FORK_SHARE) * F.col("size")) & (F.col("n") > F.lit(FORK_SHARE) * F.col("hub_size")))
    return related.groupBy("repo").agg(F.min("hub").alias("family"))


def shared_subtrees(files: DataFrame) -> DataFrame:
    """``(repo, path)`` of files that are, or lie below, a subtree that unrelated repositories share.

    ``files`` is as in :func:`merkle_nodes`.  Subtrees with fewer than
    ``MIN_SHARED_CHARS`` characters of code are too common to say anything.  What
    only the members of one family (:func:`families`) share is no copy; what they
    share with others is.  The repository '' stands for all without a name.
    """
    nodes = cut_lineage(merkle_nodes(files).where(F.col("chars") >= MIN_SHARED_CHARS))
    forks = cut_lineage(families(files))
    known = nodes.join(forks, "repo", "left").select("node", F.coalesce("family", "repo").alias("family"))
    spread_out = known.groupBy("node").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b").select("node")
    marked = nodes.join(spread_out, "node", "left_semi")
    direct = marked.where("is_file").select("repo", "path")
    roots = marked.where("not is_file").select("repo", F.col("path").alias("part"))
    # A file is covered if one of its directories is marked.
    parts = F.split("path", "/")
    chain = files.where(F.size(parts) > 1).select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("part"))
    covered = chain.join(roots, ["repo", "part"], "left_semi").select("repo", "path")
    return direct.unionByName(covered).distinct()


def foreign_files(sources: DataFrame) -> DataFrame:
    """``(file_id, kind)`` of files not written by hand where they are.

    ``sources`` holds ``file_id``, ``repo``, ``path`` and ``content``.  The kind is
    vendored for a copy that unrelated repositories share (:func:`shared_subtrees`),
    else what the file's own path, header and layout say: vendored, generated,
    minified or data.  Repeated rows are judged one by one.
    """
    own = sources.select("file_id", F.col("repo").cast("string").alias("repo"), F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content"))
    key = own.schema["file_id"].dataType.simpleString()
    judged = cut_lineage(spread(own).mapInArrow(_judged, f"file_id {key}, repo string, path string, kind string, hash long, up array<long>, chars long"))
    shared = shared_subtrees(judged.select("repo", "path", "hash", "up", "chars"))
    copies = judged.join(shared, ["repo", "path"], "left_semi").select("file_id", F.lit("vendored").alias("kind"))
    marked = judged.where("kind is not null").join(shared, ["repo", "path"], "left_anti").select("file_id", "kind")
    return copies.unionByName(marked)
