"""Java: symbols, imports, Spring endpoints and connections."""

from __future__ import annotations

import re

from codeloom.extract.patterns import Pattern
from codeloom.extract.rows import FileResult, plain_doc
from codeloom.functions.functions import _Lines, _match, find_functions
from codeloom.functions.lexer import COMMENT, NEWLINE, lex

_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "GET"}


def extract_java(path: str, text: str, patterns: list[Pattern] | None = None) -> FileResult:
    """Rows of a Java file: top-level types, their methods and public constants."""
    tokens = lex(text, "java")
    code = [t for t in tokens if t[0] not in (COMMENT, NEWLINE)]
    lines, pairs = _Lines(text, tokens), _match(code)
    word = lambda k: text[code[k][1] : code[k][2]]
    out = FileResult()
    found = re.search(r"^\s*package\s+([\w.]+)\s*;", text.lstrip("﻿"), re.M)
    out.module = found.group(1).rsplit(".", 1)[-1] if found else ""
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", text, re.M):
        out.use(m.group(1))
    depth, k, owners = 0, 0, []
    types: list[tuple[str, int, int, list[tuple[str, str, int]]]] = []
    marks: list[tuple[str, str, int]] = []
    while k < len(code):
        kind = code[k][0]
        if kind == "@" and k + 1 < len(code) and code[k + 1][0] == "n":
            name, after = word(k + 1), k + 2
            while after + 1 < len(code) and code[after][0] == "." and code[after + 1][0] == "n":
                name, after = word(after + 1), after + 2
            arguments = ""
            if after < len(code) and code[after][0] == "(" and after in pairs:
                arguments = text[code[after][2] : code[pairs[after]][1]]
                after = pairs[after] + 1
            marks.append((name, arguments, lines.of(code[k][1]) + 1))
            k = after
            continue
        if kind == "K" and code[k - 1][0] not in ".@" and k + 1 < len(code) and code[k + 1][0] == "n":
            if depth == 0:
                first = k
                while first and code[first - 1][0] in "m":
                    first -= 1
                out.symbol(word(k), word(k + 1), out.module, lines.of(code[k][1]) + 1, signature=f"{word(k)} {word(k + 1)}", doc=plain_doc(lines.above(marks[0][2] - 1 if marks else lines.of(code[first][1]))[0]))
                body = k
                while body < len(code) and code[body][0] != "{":
                    body += 1
                types.append((word(k + 1), body, pairs.get(body, len(code) - 1), list(marks)))
            marks = []
        if kind in ";{}":
            marks = []
        depth += (kind == "{") - (kind == "}")
        if kind == "m" and depth == 1 and types:
            end = k
            while end < len(code) and code[end][0] in "m":
                end += 1
            words = {word(i) for i in range(k, end)}
            if {"public", "static", "final"} <= words:
                stop = end
                while stop < len(code) and code[stop][0] not in "=;({":
                    stop += 1
                if stop < len(code) and code[stop][0] in "=;" and code[stop - 1][0] == "n":
                    out.symbol("field", word(stop - 1), out.module, lines.of(code[k][1]) + 1, types[-1][0], " ".join(text[code[k][1] : code[stop - 1][2]].split()), plain_doc(lines.above(lines.of(code[k][1]))[0]))
            k = end
            continue
        k += 1
    starts = {t[0]: t for t in types}
    for f in find_functions(text, "java"):
        if f.receiver in starts:
            out.symbol("method", f.name, out.module, f.line, f.receiver, f.signature, plain_doc(f.doc))
            for name, arguments, line in [*_marks_before(text, code, pairs, lines, f), *starts[f.receiver][3]]:
                if name in _MAPPINGS:
                    out.endpoint(_MAPPINGS[name], _value(arguments, ("value", "path")), f.name, "spring_mvc", line)
    _connections(out, text, code, pairs, lines, patterns or [])
    return out


def _marks_before(text, code, pairs, lines, f):
    """Annotations of a member, in order."""
    at = next((i for i, t in enumerate(code) if t[1] == f.start), None)
    if at is None:
        return []
    start = at
    while start and code[start - 1][0] not in ";{}":
        if code[start - 1][0] == ")":
            start = next((o for o, c in pairs.items() if c == start - 1), start - 1)
        else:
            start -= 1
    out, k = [], start
    while k < at:
        if code[k][0] == "@" and code[k + 1][0] == "n":
            name, line = text[code[k + 1][1] : code[k + 1][2]], lines.of(code[k][1]) + 1
            k += 2
            arguments = ""
            if k < at and code[k][0] == "(" and k in pairs:
                arguments = text[code[k][2] : code[pairs[k]][1]]
                k = pairs[k] + 1
            out.append((name, arguments, line))
        else:
            k += 1
    return out


def _value(arguments: str, names: tuple[str, ...]) -> str:
    """String of an annotation: of a named attribute, else of its only value."""
    for name in names:
        m = re.search(rf"\b{name}\s*=\s*\{{?\s*\"([^\"]*)\"", arguments)
        if m:
            return m.group(1)
    m = re.match(r"\s*\{?\s*\"([^\"]*)\"", arguments)
    return m.group(1) if m else ""


def _connections(out, text, code, pairs, lines, patterns):
    imported = [i["import_path"] for i in out.imports]
    usable = [p for p in patterns if any(p.module in i for i in imported)]
    for k in range(1, len(code) - 1):
        if code[k][0] == "@" and code[k + 1][0] == "n":
            name = "@" + text[code[k + 1][1] : code[k + 1][2]]
            for p in usable:
                if name in p.names:
                    inside = text[code[k + 2][2] : code[pairs[k + 2]][1]] if k + 2 in pairs and code[k + 2][0] == "(" else ""
                    out.connect(p.conn_type, p.service or _value(inside, (p.attribute, "value") if p.attribute else ("value",)), lines.of(code[k][1]) + 1)
                    break
        elif code[k][0] == "(" and code[k - 1][0] == "n" and k in pairs:
            name = text[code[k - 1][1] : code[k - 1][2]]
            for p in usable:
                if name in p.names:
                    strings = [text[t[1] + 1 : t[2] - 1] for t in code[k + 1 : pairs[k]] if t[0] == "s"]
                    out.connect(p.conn_type, p.service or (strings[0] if strings else " ".join(text[code[k][2] : code[pairs[k]][1]].split())), lines.of(code[k - 1][1]) + 1)
                    break
