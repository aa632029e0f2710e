"""Go: symbols, imports, calls, type usages, interfaces, routes and connections."""

from __future__ import annotations

import bisect
import re

from codeloom.extract.patterns import Pattern
from codeloom.extract.rows import FileResult, plain_doc
from codeloom.functions.functions import _Lines, _match, find_functions
from codeloom.functions.lexer import COMMENT, NEWLINE, lex

#: Confidence of a call by how its target is named.
SAME_PACKAGE, IMPORTED, GUESSED = 0.90, 0.80, 0.50

# Predeclared types and functions.
BUILTIN_TYPES = frozenset("bool string error any byte rune int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128".split())
BUILTIN_CALLS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split()) | BUILTIN_TYPES
# Web frameworks by import path, the first that fits counts.
FRAMEWORKS = (("go-zero", "go_zero"), ("gin-gonic/gin", "gin"), ("labstack/echo", "echo"), ("go-chi/chi", "chi"), ("net/http", "net_http"))
VERBS = frozenset("GET POST PUT DELETE PATCH HEAD OPTIONS".split())


def extract_go(path: str, text: str, patterns: list[Pattern] | None = None, top_level_only: bool = False) -> FileResult:
    """Rows of a Go file; locals count as symbols unless ``top_level_only``."""
    out = FileResult()
    tokens = lex(text, "go")
    code = [t for t in tokens if t[0] not in (COMMENT, NEWLINE)]
    lines = _Lines(text, tokens)
    pairs = _match(code)
    word = lambda k: text[code[k][1] : code[k][2]]
    line = lambda k: lines.of(code[k][1]) + 1
    package = word(1) if len(code) > 1 and code[0][0] == "P" and code[1][0] == "n" else ""
    out.module = package
    imports: dict[str, str] = {}

    def add_import(k: int) -> None:
        alias = word(k - 1) if code[k - 1][0] in "n." and lines.of(code[k - 1][1]) == lines.of(code[k][1]) else ""
        target = word(k)[1:-1]
        imports[alias or target.rsplit("/", 1)[-1]] = target
        out.use(target, alias)

    functions = find_functions(text, "go")
    for f in functions:
        qualified = out.symbol("method" if f.receiver else "func", f.name, package, f.line, f.receiver, f.signature, plain_doc(f.doc))
        f.qualified = qualified
        if f.receiver:
            out.receiver_methods.append({"struct_name": f.receiver.lstrip("*"), "method_name": f.name})
    depth = 0
    k = 0
    while k < len(code):
        kind = code[k][0]
        depth += (kind == "{") - (kind == "}")
        group = range(k + 2, pairs[k + 1]) if kind in "IVT" and k + 1 in pairs and code[k + 1][0] == "(" else None
        if kind == "I":
            for j in group or range(k + 1, min(k + 3, len(code))):
                if code[j][0] == "s":
                    add_import(j)
            k = pairs[k + 1] if group else k
        elif kind in "VT" and not (top_level_only and depth):
            for j in _declared(code, lines, k, group, pairs):
                if kind == "V":
                    out.symbol("const" if word(k) == "const" else "var", word(j), package, line(j), doc=plain_doc(lines.above(lines.of(code[k if group is None else j][1]))[0]))
                else:
                    _type(out, text, code, pairs, lines, j, package, k if group is None else j)
        k += 1
    for f in functions:
        _calls(out, text, code, pairs, lines, f, package, imports)
        _usages(out, text, code, pairs, lines, f)
    _routes(out, text, code, pairs, lines, imports)
    _connections(out, text, code, pairs, lines, imports, patterns or [])
    return out


def _declared(code, lines, k, group, pairs):
    """Places of the names a const, var or type clause declares."""
    if group is None:
        j = k + 1
        while j < len(code) and code[j][0] == "n":
            yield j
            if j + 1 < len(code) and code[j + 1][0] == "," and code[k][0] == "V":
                j += 2
                continue
            break
        return
    j, seen = group.start, -1
    while j < group.stop:
        if code[j][0] == "n" and lines.of(code[j][1]) != seen and (j == group.start or code[j - 1][0] not in "=.,bu"):
            seen = lines.of(code[j][1])
            yield j
            while j + 2 < group.stop and code[j + 1][0] == "," and code[j + 2][0] == "n" and code[k][0] == "V":
                j += 2
                yield j
        j = pairs.get(j, j) + 1 if code[j][0] in "([{" else j + 1


def _type(out, text, code, pairs, lines, j, package, at):
    word = lambda i: text[code[i][1] : code[i][2]]
    name, after = word(j), j + 1
    if after < len(code) and code[after][0] == "[" and after + 1 < len(code) and code[after + 1][0] == "n" and after in pairs and pairs[after] > after + 2:
        after = pairs[after] + 1
    if after < len(code) and code[after][0] == "=":
        after += 1
    kind = word(after) if after < len(code) and code[after][0] == "S" else "type"
    out.symbol(kind, name, package, lines.of(code[j][1]) + 1, signature=f"type {name} {kind}" if kind != "type" else f"type {name}", doc=plain_doc(lines.above(lines.of(code[at][1]))[0]))
    if kind == "interface" and after + 1 in pairs:
        depth = 0
        for i in range(after + 2, pairs[after + 1]):
            depth += (code[i][0] in "([{") - (code[i][0] in ")]}")
            if code[i][0] == "n" and depth == 0 and code[i + 1][0] == "(" and code[i - 1][0] != ".":
                out.interface_methods.append({"interface_name": f"{package}.{name}" if package else name, "method_name": word(i)})


def _span(code, f):
    starts = [t[1] for t in code]
    return bisect.bisect_left(starts, f.start), bisect.bisect_left(starts, f.end)


def _calls(out, text, code, pairs, lines, f, package, imports):
    first, last = _span(code, f)
    body = first
    while body < last and not (code[body][0] == "{" and code[body - 1][0] != "S"):
        body += 1
    for k in range(body + 1, last):
        if code[k][0] != "(" or code[k - 1][0] != "n":
            continue
        name = text[code[k - 1][1] : code[k - 1][2]]
        if code[k - 2][0] == "F":
            continue
        if code[k - 2][0] != ".":
            target, confidence = package, SAME_PACKAGE
        else:
            owner = text[code[k - 3][1] : code[k - 3][2]] if code[k - 3][0] == "n" and code[k - 4][0] != "." else ""
            target, confidence = (owner, IMPORTED) if owner in imports else (owner, GUESSED)
        at = code[k - 1][1]
        row = lines.of(at)
        out.function_calls.append({"caller_qualified_name": f.qualified, "callee_name": name, "callee_package": target, "line": row + 1, "col": at - lines.starts[row] + 1, "confidence": confidence})


def _type_name(parts: list[str]) -> str:
    """Bare type of a type expression: pointers, slices, variadics and map keys go."""
    text = "".join(parts)
    while True:
        short = re.sub(r"^(?:\*|\.\.\.|\[\d*\]|map\[[^\]]*\]|chan\b|<-|&)", "", text)
        if short == text:
            break
        text = short
    return re.sub(r"\[.*\]$", "", text)


def _usages(out, text, code, pairs, lines, f):
    first, last = _span(code, f)
    k = first + 1
    if code[k][0] == "(":
        k = pairs.get(k, k) + 1
    while k < last and code[k][0] != "(":
        k = pairs.get(k, k) + 1 if code[k][0] == "[" else k + 1
    if k not in pairs:
        return
    close = pairs[k]
    after = close + 1
    results = []
    if after < last and code[after][0] == "(" and after in pairs:
        results = _fields(text, code, pairs, after + 1, pairs[after])
    elif after < last and code[after][0] != "{":
        end = after
        while end < last and not (code[end][0] == "{" and code[end - 1][0] != "S"):
            end = pairs.get(end, end) + 1 if code[end][0] in "([" else end + 1
        results = [(1, _type_name([text[t[1] : t[2]] for t in code[after:end]]))]
    for direction, fields in (("input", _fields(text, code, pairs, k + 1, close)), ("output", results)):
        position = 0
        for count, name in fields:
            plain = not name or name in BUILTIN_TYPES or name.startswith(("func", "struct{", "interface{")) or name.rsplit(".", 1)[-1].endswith("Context")
            for _ in range(1 if plain else count):
                if not plain:
                    out.type_usages.append({"symbol_name": f.qualified, "type_name": name, "direction": direction, "position": position, "line": f.line})
                position += 1


def _fields(text, code, pairs, start, end):
    """``(names, type)`` of a parameter list; names sharing a type count together."""
    groups, part, k = [], [], start
    while k < end:
        if code[k][0] == ",":
            groups.append(part)
            part = []
        else:
            stop = pairs.get(k, k) if code[k][0] in "([{" else k
            part += [(code[i][0], text[code[i][1] : code[i][2]]) for i in range(k, stop + 1)]
            k = stop
        k += 1
    if part:
        groups.append(part)
    named = any(len(g) > 1 and g[0][0] == "n" and g[1][0] not in ".[" or len(g) > 2 and g[0][0] == "n" and g[1][1] == "[" for g in groups)
    out, waiting = [], 0
    for g in groups:
        if named and len(g) == 1:
            waiting += 1
            continue
        words = [w for _, w in (g[1:] if named else g)]
        out.append((waiting + 1, _type_name(words)))
        waiting = 0
    return out


def _text(token_text: str) -> str:
    return token_text[1:-1] if token_text[:1] in "\"'`" else token_text


def _arguments(text, code, pairs, open_):
    """Text of each argument of a call, and the place of its first token."""
    out, start, k = [], open_ + 1, open_ + 1
    end = pairs.get(open_, open_)
    while k <= end:
        if k == end or code[k][0] == ",":
            if k > start:
                out.append((text[code[start][1] : code[k - 1][2]], start))
            start = k + 1
        k = pairs.get(k, k) + 1 if k < end and code[k][0] in "([{" else k + 1
    return out


def _routes(out, text, code, pairs, lines, imports):
    framework = next((name for part, name in FRAMEWORKS if any(part in target for target in imports.values())), None)
    if framework is None:
        return
    word = lambda k: text[code[k][1] : code[k][2]]
    for k in range(2, len(code)):
        if code[k][0] == "(" and code[k - 1][0] == "n" and code[k - 2][0] == ".":
            name = word(k - 1)
            arguments = _arguments(text, code, pairs, k)
            upper = name.upper()
            routed = upper in VERBS and (name == upper or framework == "chi")
            if (routed or name in ("HandleFunc", "Handle")) and len(arguments) >= 2 and code[arguments[0][1]][0] == "s":
                value = _text(arguments[0][0])
                if value.startswith("/") or " /" in value:
                    method = upper if routed else "ANY"
                    handler = arguments[-1][0]
                    out.endpoint(method, value, " ".join(handler.split()), framework, lines.of(code[k - 1][1]) + 1)
        if framework == "go_zero" and code[k][0] == "{" and k in pairs:
            fields = {word(i): i for i in range(k + 1, pairs[k]) if code[i][0] == "n" and i + 1 < len(code) and code[i + 1][0] == ":" and code[i - 1][0] in "{,"}
            if {"Method", "Path"} <= set(fields) and not any(code[i][0] == "{" and i in pairs and fields["Method"] > i and fields["Method"] < pairs[i] for i in range(k + 1, pairs[k])):
                value = lambda f: fields[f] + 2  # noqa: B023, E731
                m = value("Method")
                method = _text(word(m)) if code[m][0] == "s" else word(m + 2).removeprefix("Method") if code[m + 1][0] == "." else word(m)
                target = word(value("Path"))
                handler = ""
                if "Handler" in fields:
                    end = value("Handler")
                    while end < pairs[k] and code[end][0] != ",":
                        end = pairs.get(end, end) + 1 if code[end][0] in "([{" else end + 1
                    handler = " ".join(text[code[value("Handler")][1] : code[end - 1][2]].split())
                if method and _text(target):
                    out.endpoint(method.upper(), _text(target), handler, framework, lines.of(code[k][1]) + 1)


def _connections(out, text, code, pairs, lines, imports, patterns):
    for k in range(3, len(code)):
        if code[k][0] != "(" or code[k - 1][0] != "n" or code[k - 2][0] != "." or code[k - 3][0] != "n":
            continue
        owner, name = (text[code[i][1] : code[i][2]] for i in (k - 3, k - 1))
        target = imports.get(owner)
        if target is None:
            continue
        for p in patterns:
            if p.names and name in p.names and p.module and (target.endswith(p.module) or p.module in target):
                arguments = _arguments(text, code, pairs, k)
                strings = [_text(a) for a, at in arguments if code[at][0] == "s"]
                out.connect(p.conn_type, p.service or (strings[0] if strings else arguments[0][0] if arguments else ""), lines.of(code[k - 1][1]) + 1)
                break
