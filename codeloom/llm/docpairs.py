"""Functions paired with their documentation.

Functions come from the string- and comment-aware lexers; the documentation is the
comment that ends on the line above the declaration (annotations may stand
between, a blank line may not), in Python the docstring.  Documentation that is
absent or says nothing is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.functions import find_functions
from codeloom.functions.lexer import language
from codeloom.session import spread

#: Words of prose that make a comment documentation.
MIN_WORDS = 4
#: Kinds of symbols that are functions.
KINDS = ("func", "method", "hook", "component")

# Words that carry nothing, directives of tools, markers of unfinished work, section tags.
ARTICLES = frozenset("a an the der die das ein eine einen einem einer le la les un une des el los las una unos unas l d".split())
MARKERS = frozenset("todo fixme xxx hack tbd wip note nb bug optimize".split())
SECTIONS = frozenset("args arguments parameters params returns return raises throws yields example examples attributes notes see deprecated keyword other".split())
GENERIC = frozenset("func function method constructor component hook class doc docs documentation description getter setter helper".split())
DIRECTIVE = re.compile(
    r"^\s*(?:go:\S+|lint:\S+.*|nolint\b.*|\+build\b.*|line \S+:\d+|export \w+$|eslint\S*(?:[ :].*)?|tslint:.*|prettier-ignore\b.*|@ts-\w+.*|@flow\b.*|istanbul .*|c8 ignore.*|noqa\b.*|type:\s*ignore.*|pylint:.*|mypy:.*|pragma:?.*|fmt:\s*\w+|isort:.*|ruff:.*|nosec\b.*|noinspection\b.*|CHECKSTYLE.*|spotless:.*|region\b.*|endregion\b.*|@formatter:\w+|jshint .*|jslint .*|globals? .*|webpack\w+:.*|#__PURE__|sourceMappingURL=.*)$",
    re.I,
)
_CODE_LINE = re.compile(r"^[\w.\[\]()\s*&!]+\s(?:[+\-*/%|&^:]?=|==|!=|<=|>=|:=|\+\+|--|=>|->)\s*\S.*$|.*[;{}]\s*$|^\s*(?:return|if|for|while|import|package|func|def|const|let|var)\b.*[(){}=].*$|^\s*[\w.]+\([^)]*\);?\s*$")
_SPANS = re.compile(r"`[^`]*`|\{@\w+[^}]*\}|<[^<>\n]*>|https?://\S+|\{\{.*?\}\}")
_FIELD = re.compile(r"^\s*(?:[@\\:](param|arg|argument|parameter|property|prop|type|typeparam|template|throws|exception|raises|keyword|key|ivar|cvar|var)\b:?\s*(?:\{[^}]*\}\s*)?(?:\[?([\w.$*]+)[^\s\]]*\]?)?:?|[@\\:]([A-Za-z][\w-]*):?)")
_ITEM = re.compile(r"^\s*(\*{0,2}\w+)\s*(?:\([^)]*\))?\s*:\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_IDENTIFIER = re.compile(r"\S*(?:_|\w\(|\w\.\w|[a-z][A-Z]|\d|::|=|/)\S*")


def comment_text(doc: str) -> list[str]:
    """Lines of a comment without its marks."""
    text = doc.strip()
    if text.startswith("/*"):
        text = re.sub(r"^/\*+!?|\*+/$", "", text)
        return [re.sub(r"^\s*\*(?!\*)\s?", "", line).strip() for line in text.split("\n")]
    return [re.sub(r"^\s*//+!?\s?", "", line).strip() for line in text.split("\n")]


def name_words(name: str) -> set[str]:
    """Words of an identifier in lower case."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+", name)}


def _of_name(word: str, own: set[str]) -> bool:
    if word in own:
        return True
    stems = {word[: -len(end)] for end in ("s", "es", "ed", "d", "ing", "er", "r") if word.endswith(end) and len(word) > len(end) + 2}
    if word.endswith("ies"):
        stems.add(word[:-3] + "y")
    stems |= {s + "e" for s in list(stems)} | {s[:-1] for s in list(stems) if len(s) > 3 and s[-1] == s[-2]}
    return bool(stems & own)


def prose_words(doc: str, name: str, params: tuple[str, ...] = ()) -> int:
    """Words of prose in a comment, beyond the function's name, articles, markers, directives, tags, parameters and code."""
    own = name_words(name)
    known = {p.lower() for p in params}
    count = 0
    for line in comment_text(doc) if doc.lstrip().startswith(("/*", "//")) else [x.strip() for x in doc.split("\n")]:
        if not line or DIRECTIVE.match(line) or _CODE_LINE.match(line):
            continue
        line = _SPANS.sub(" ", line)
        field = _FIELD.match(line)
        if field:
            if field.group(2):
                known.add(field.group(2).strip("*").lower())
            line = line[field.end() :]
        else:
            item = _ITEM.match(line)
            if item and (item.group(1).strip("*").lower() in known or item.group(1).lower() in SECTIONS):
                line = line[item.end() :]
        if re.fullmatch(r"\s*[A-Z]?\w+:\s*", line) and line.strip()[:-1].lower() in SECTIONS:
            continue
        line = re.sub(r"\b(?:TODO|FIXME|XXX|HACK)\b(?:\([^)]*\))?:?", " ", line)
        for token in line.split():
            if _IDENTIFIER.fullmatch(token.strip(".,;:!?()[]\"'")):
                continue
            for word in _WORD.findall(token):
                low = word.lower()
                if low in ARTICLES or low in MARKERS or low in known or _of_name(low, own):
                    continue
                count += 1
    return count


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_id", "name", "receiver", "line", "signature", "doc", "code", "words"]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
    for batch in batches:
        files, paths, texts = (batch[c].to_pylist() for c in ("file_id", "path", "content"))
        rows = []
        for file, path, text in zip(files, paths, texts, strict=True):
            lang = language(path)
            if lang is None or not text:
                continue
            for f in find_functions(text, lang, lang == "js" or path.rstrip().lower().endswith("x")):
                if f.doc:
                    words = prose_words(f.doc, f.name, f.params)
                    if words >= MIN_WORDS:
                        doc = f.doc if lang == "python" else "\n".join(comment_text(f.doc))
                        rows.append((file, f.name, f.receiver, f.line, f.signature, doc.strip(), text[f.start : f.end], words))
        cells = list(zip(*rows, strict=True)) or [()] * 8
        types = (batch.schema.field("file_id").type, *kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, types, strict=True)], names=names)


def documented_functions(sources: DataFrame) -> DataFrame:
    """``(file_id, name, receiver, line, signature, doc, code, words)`` of functions with real documentation.

    ``sources`` holds ``file_id``, ``path`` and ``content``.  Files in other
    languages and null or empty texts give none.
    """
    own = sources.select("file_id", F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content"))
    key = own.schema["file_id"].dataType.simpleString()
    return spread(own).mapInArrow(_pairs, f"file_id {key}, name string, receiver string, line int, signature string, doc string, code string, words int")


def _receiver(qualified: str):
    return F.ltrim(F.regexp_extract(qualified, r"\(([^()]*)\)", 1), F.lit("*"))


def documented_symbols(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """Code and documentation of indexed functions: ``(file_id, qualified_name, signature, doc, code)``.

    A function of the text belongs to the symbol of the same file, name and
    receiver; a fact loaded twice is one symbol.  Symbols without a qualified_name
    and symbols whose function the text does not have are left out.
    """
    index = (
        symbols.where(F.col("kind").isin(*KINDS) & F.col("qualified_name").isNotNull())
        .select("file_id", "name", _receiver("qualified_name").alias("receiver"), "qualified_name")
        .distinct()
    )
    found = documented_functions(sources).withColumn("receiver", F.ltrim("receiver", F.lit("*")))
    return found.join(index, ["file_id", "name", "receiver"]).select("file_id", "qualified_name", "signature", "doc", "code")
