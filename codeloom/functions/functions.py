"""Functions and methods in source text, with their documentation comments.

Built on the lexers: strings and comments are single tokens, so braces inside them
never count.  A function reaches from its first token to its matching brace (in
Python to the end of its indented block).
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from codeloom.functions.lexer import COMMENT, NEWLINE, Token, lex


@dataclass
class Function:
    """One function: names, first line (from 1), signature, documentation and text range."""

    name: str
    receiver: str
    line: int
    signature: str
    doc: str
    start: int
    end: int
    params: tuple[str, ...]
    qualified: str = ""


class _Lines:
    def __init__(self, text: str, tokens: list[Token]):
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        #: Last line to comment, for comments that stand alone on their lines.
        self.comments: dict[int, tuple[int, int, int]] = {}
        for kind, start, end in tokens:
            if kind == COMMENT:
                first = self.of(start)
                if not text[self.starts[first] : start].strip("﻿ \t\r"):
                    self.comments[self.of(max(start, end - 1))] = (first, start, end)

    def of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def above(self, line: int) -> tuple[str, int]:
        """Comment text that ends on the line above ``line``, and the line it starts on."""
        found = self.comments.get(line - 1)
        if not found:
            return "", line
        first, start, end = found
        piece = self.text[start:end]
        if piece.startswith("/*"):
            return piece, first
        pieces = [piece]
        while (before := self.comments.get(first - 1)) and self.text.startswith("//", before[1]):
            first = before[0]
            pieces.append(self.text[before[1] : before[2]])
        return "\n".join(reversed(pieces)), first


def find_functions(text: str | None, lang: str, markup: bool = False, tokens: list[Token] | None = None) -> list[Function]:
    """Functions of a file in order.  Texts that do not parse give what can be told apart.

    ``tokens`` spares the lexer where the caller has them.
    """
    if not text:
        return []
    tokens = lex(text, lang, markup) if tokens is None else tokens
    code = [t for t in tokens if t[0] not in (COMMENT, NEWLINE)]
    if lang == "python":
        return _python(text, tokens)
    lines = _Lines(text, tokens)
    pairs = _match(code)
    if lang == "go":
        return _go(text, code, pairs, lines)
    if lang == "java":
        return _java(text, code, pairs, lines)
    return _script(text, code, pairs, lines)


def _match(code: list[Token]) -> dict[int, int]:
    pairs: dict[int, int] = {}
    open_: list[int] = []
    for k, (kind, _, _) in enumerate(code):
        if kind in "([{":
            open_.append(k)
        elif kind in ")]}" and open_:
            pairs[open_.pop()] = k
    return pairs


def _word(text: str, token: Token) -> str:
    return text[token[1] : token[2]]


def _parameters(text: str, code: list[Token], start: int, end: int) -> tuple[str, ...]:
    return tuple(_word(text, code[k]) for k in range(start, end) if code[k][0] in "ny")


def _make(text, code, lines, k, last, body, name, receiver, open_, close, doc_line=None) -> Function:
    start = code[k][1]
    stop = code[body][1] if body is not None else code[last][2]
    doc, _ = lines.above(lines.of(start))
    if not doc and doc_line is not None and doc_line != lines.of(start):
        doc, _ = lines.above(doc_line)
    signature = " ".join(text[start:stop].split())
    return Function(name, receiver, lines.of(start) + 1, signature, doc, start, code[last][2], _parameters(text, code, open_, close))


def _go(text: str, code: list[Token], pairs: dict[int, int], lines: _Lines) -> list[Function]:
    out = []
    depth = 0
    for k, (kind, _, _) in enumerate(code):
        if kind == "{":
            depth += 1
        elif kind == "}":
            depth -= 1
        if kind != "F" or depth or k + 1 >= len(code):
            continue
        at, receiver = k + 1, ""
        if code[at][0] == "(" and at in pairs:
            inner = code[at + 1 : pairs[at]]
            depth_in = 0
            names = []
            for t in inner:
                depth_in += (t[0] == "[") - (t[0] == "]")
                if t[0] == "n" and not depth_in:
                    names.append(t)
            star = any(t[0] == "u" for t in inner)
            receiver = ("*" if star else "") + _word(text, names[-1]) if names else ""
            at = pairs[at] + 1
        if at >= len(code) or code[at][0] != "n":
            continue
        open_ = at + 1
        if open_ < len(code) and code[open_][0] == "[":
            open_ = pairs.get(open_, open_) + 1
        if open_ >= len(code) or code[open_][0] != "(" or open_ not in pairs:
            continue
        close = pairs[open_]
        body = close + 1
        line = lines.of(code[close][2] - 1)
        while body < len(code) and not (code[body][0] == "{" and code[body - 1][0] != "S"):
            if code[body][0] in "([{" and body in pairs:
                body = pairs[body]
            elif code[body][0] in "FTVI" and lines.of(code[body][1]) > line:
                body = len(code)
                break
            body += 1
        has = body < len(code) and code[body][0] == "{"
        last = pairs.get(body, len(code) - 1) if has else close
        out.append(_make(text, code, lines, k, last, body if has else None, _word(text, code[at]), receiver, open_, close))
    return out


def _java(text: str, code: list[Token], pairs: dict[int, int], lines: _Lines) -> list[Function]:
    out: list[Function] = []

    def body_of(start: int, end: int, owner: str) -> None:
        k = start
        while k < end:
            if code[k][0] in ";}":
                k += 1
                continue
            first, own = k, None
            name_at = open_ = None
            kind = None
            while k < end and code[k][0] not in ";{=":
                if code[k][0] == "@" and k + 1 < end and code[k + 1][0] == "n":
                    k += 2
                    while k + 1 < end and code[k][0] == "." and code[k + 1][0] == "n":
                        k += 2
                    if k < end and code[k][0] == "(" and k in pairs:
                        k = pairs[k] + 1
                    continue
                own = k if own is None else own
                if code[k][0] == "K" or code[k][0] == "n" and _word(text, code[k]) == "record" and k + 2 < end and code[k + 1][0] == "n" and code[k + 2][0] in "(<":
                    kind, name_at = "type", k + 1
                    while k < end and code[k][0] not in "{;":
                        k = pairs[k] if code[k][0] in "([" and k in pairs else k
                        k += 1
                    break
                if code[k][0] == "(" and open_ is None and code[k - 1][0] == "n":
                    open_, name_at = k, k - 1
                if code[k][0] in "([" and k in pairs:
                    k = pairs[k]
                k += 1
            if k < end and code[k][0] == "{" and k in pairs:
                close = pairs[k]
                if kind == "type" and name_at < end:
                    body_of(k + 1, close, _word(text, code[name_at]))
                elif open_ is not None and own is not None:
                    out.append(_make(text, code, lines, own, close, k, _word(text, code[name_at]), owner, open_, pairs.get(open_, open_), lines.of(code[first][1])))
                k = close + 1
            else:
                if k < end and code[k][0] == ";" and open_ is not None and own is not None and owner:
                    out.append(_make(text, code, lines, own, k, k, _word(text, code[name_at]), owner, open_, pairs.get(open_, open_), lines.of(code[first][1])))
                while k < end and code[k][0] != ";":
                    k = pairs[k] if code[k][0] in "([{" and k in pairs else k
                    k += 1
                k += 1

    body_of(0, len(code), "")
    return out


def _script(text: str, code: list[Token], pairs: dict[int, int], lines: _Lines) -> list[Function]:
    out = []
    size = len(code)
    for k, (kind, start, _) in enumerate(code):
        first = k
        while first and (code[first - 1][0] in "ZD" or _word(text, code[first - 1]) in ("async", "declare")) and lines.of(code[first - 1][1]) == lines.of(start):
            first -= 1
        name = open_ = None
        if kind == "f" and k + 1 < size:
            at = k + 2 if code[k + 1][0] == "u" else k + 1
            if at + 1 < size and code[at][0] in "ny":
                name, open_ = at, at + 1
        elif kind == "V" and k + 2 < size and code[k + 1][0] in "ny":
            at = k + 2
            while at < size and code[at][0] not in "=;{}":
                at = pairs.get(at, at) + 1
            if at < size and code[at][0] == "=" and _word(text, code[at]) == "=":
                at += 1
                if at < size and code[at][0] == "y" and _word(text, code[at]) == "async":
                    at += 1
                if at < size and code[at][0] == "f":
                    at += 1
                    at += at < size and code[at][0] in "ny"
                    name, open_ = k + 1, at
                elif at < size and code[at][0] in "(<" or at + 1 < size and code[at][0] == "n" and code[at + 1][0] == "A":
                    if _arrow(code, pairs, at):
                        name, open_ = k + 1, at
        if name is None or open_ is None or open_ >= size:
            continue
        while open_ < size and code[open_][0] == "<":
            while open_ < size and code[open_][0] != "(":
                open_ += 1
        close = pairs.get(open_, open_)
        body = close + 1
        while body < size and code[body][0] not in "{;A":
            body = pairs.get(body, body) + 1
        if body < size and code[body][0] == "A":
            body += 1
        last = pairs.get(body, body) if body < size and code[body][0] == "{" else None
        if last is None:
            last = min(body, size - 1)
            while last < size - 1 and code[last][0] != ";" and lines.of(code[last + 1][1]) == lines.of(code[last][1]):
                last = pairs.get(last, last) + 1 if code[last][0] in "([{" else last + 1
            last = min(last, size - 1)
        out.append(_make(text, code, lines, first, last, min(body, size - 1), _word(text, code[name]), "", open_, close))
    return out


def _arrow(code: list[Token], pairs: dict[int, int], at: int) -> bool:
    if code[at][0] == "n":
        return True
    while at < len(code) and code[at][0] != "(":
        at += 1
    close = pairs.get(at)
    if close is None:
        return False
    after = close + 1
    for _ in range(12):
        if after >= len(code) or code[after][0] in ";{":
            return False
        if code[after][0] == "A":
            return True
        if after == close + 1 and code[after][0] != ":":
            return False
        after = pairs.get(after, after) + 1
    return False


_LONG = re.compile(r"(?i)^([rbuft]*)(\"\"\"|'''|\"|')")


def _python(text: str, tokens: list[Token]) -> list[Function]:
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_right(starts, at) - 1
    code = [t for t in tokens if t[0] != COMMENT]
    out, scopes = [], []  # scopes: column, class name or None
    depth, new, k = 0, True, 0
    pending: list[tuple[Function, int]] = []
    while k < len(code):
        kind, start, end = code[k]
        if kind == NEWLINE:
            new = new or depth == 0
            k += 1
            continue
        if new and depth == 0:
            column = start - starts[line_of(start)]
            while scopes and scopes[-1][0] >= column:
                scopes.pop()
            still = []
            for f, at in pending:
                if column > at:
                    still.append((f, at))
            pending = still
            at = k + 1 if kind == "y" and k + 1 < len(code) and code[k + 1][0] == "f" else k
            if code[at][0] == "K" and at + 1 < len(code) and code[at + 1][0] == "n":
                scopes.append((column, text[code[at + 1][1] : code[at + 1][2]]))
            elif code[at][0] == "f" and at + 1 < len(code) and code[at + 1][0] == "n":
                name = text[code[at + 1][1] : code[at + 1][2]]
                receiver = scopes[-1][1] or "" if scopes else ""
                scopes.append((column, None))
                j, level = at + 2, 0
                names = []
                while j < len(code) and not (code[j][0] == ":" and level == 0):
                    level += (code[j][0] in "([{") - (code[j][0] in ")]}")
                    if code[j][0] == "n":
                        names.append(text[code[j][1] : code[j][2]])
                    j += 1
                stop = code[j][1] if j < len(code) else len(text)
                body = j + 1
                while body < len(code) and code[body][0] == NEWLINE:
                    body += 1
                doc = ""
                if body < len(code) and code[body][0] == "s":
                    quote = _LONG.match(text[code[body][1] : code[body][2]])
                    after = code[body + 1][0] if body + 1 < len(code) else NEWLINE
                    if quote and not set(quote.group(1).lower()) & set("bft") and after in (NEWLINE, ";"):
                        doc = text[code[body][1] + quote.end() : code[body][2] - len(quote.group(2))]
                f = Function(name, receiver, line_of(start) + 1, " ".join(text[start:stop].split()), doc, start, end, tuple(names))
                out.append(f)
                pending.append((f, column))
                for own, _ in pending:
                    own.end = max(own.end, stop)
                k = j
                depth = 0
                new = False
                continue
        new = False
        if kind in "([{":
            depth += 1
        elif kind in ")]}":
            depth = max(0, depth - 1)
        for own, _ in pending:
            own.end = end
        k += 1
    return out
