"""Lexers for Go, Java, JavaScript/TypeScript and Python source text.

A token is a one-letter class with its place in the text.  Strings, comments,
templates and markup are single tokens, so that nothing written inside them is
taken for code.  A lexer never fails: text that starts no token, and tokens that
do not end, get the class :data:`BAD`.

Classes shared by all languages::

    n name   d number   s string, template, pattern or markup element
    ( ) [ ] { } , ; : . ? @ #   themselves
    = assignment   b binary operator   u operator with one or two operands
    ! prefix operator   i ++ and --   < >   themselves   A arrow   e ellipsis
    X text that is no token

Keyword classes are listed per language in :data:`KEYWORDS`.
"""

from __future__ import annotations

import re
BAD = "X"
COMMENT = "/"
NEWLINE = "\n"


#: Class letter, start and end offset; a plain tuple, as files hold thousands.
Token = tuple[str, int, int]


#: Language by lower-case extension.
LANGUAGES = {".go": "go", ".java": "java", ".py": "python", ".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js"}


def language(path: str | None) -> str | None:
    """Language of a path by its extension, whatever its case; None for others."""
    dot = (path or "").rfind(".")
    return LANGUAGES.get(path[dot:].strip().lower()) if path and dot >= 0 else None


def _words(**groups: str) -> dict[str, str]:
    return {word: kind for kind, words in groups.items() for word in words.split()}


KEYWORDS = {
    "go": _words(P="package", I="import", F="func", T="type", V="var const", S="struct interface", M="map chan", R="return", B="break continue fallthrough goto", C="if for switch select", E="else", K="case", D="default", G="go defer", g="range"),
    "java": _words(P="package", I="import", m="public private protected static final abstract native synchronized transient volatile strictfp", K="class interface enum", x="extends implements throws", t="int long short byte char boolean float double void", C="if for while switch catch", W="else do try finally", R="return throw assert yield", B="break continue", k="case", D="default", N="new", o="instanceof", v="this super true false null"),
    "js": _words(I="import", Z="export", f="function", K="class", V="var let const", C="if for while switch with catch", W="else do try finally", R="return throw", r="new typeof void delete await yield", B="break continue debugger", k="case", D="default", o="in instanceof", v="this super true false null", x="extends", y="async of from as get set static type interface enum implements abstract declare readonly namespace module keyof infer is satisfies public private protected override asserts unique accessor"),
    "python": _words(f="def", K="class", l="lambda", C="if elif while for with except", W="else try finally", I="import", F="from", R="return raise del assert global nonlocal", B="pass break continue", a="as", o="in is and or", t="not", v="None True False", w="await yield", y="async"),
}
KEYWORDS["ts"] = KEYWORDS["js"]

_NUMBER = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"
_NAME = r"[^\W\d]\w*"

_GO = re.compile(
    rf"""[ \t\r\f]*(?:(?P<nl>\n)|(?P<com>//[^\n]*|/\*(?s:.*?)\*/)|(?P<s>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)+')
    |(?P<n>{_NAME})|(?P<d>(?:{_NUMBER})i?(?!\w))|(?P<br>[(){{}}\[\],;])|(?P<op><-|:=|\+\+|--|\.\.\.|<<=|>>=|&\^=|<<|>>|&\^|&&|\|\||[=!<>+\-*/%&|^]=|[.:=<>+\-*&!/%|^~])|(?P<bad>(?s:.)))""",
    re.X,
)
_GO_OPS = {"<-": "w", ":=": "=", "=": "=", "++": "i", "--": "i", "...": "e", ".": ".", ":": ":", "<": "<", ">": ">", "+": "u", "-": "u", "*": "u", "&": "u", "^": "u", "!": "!", "~": "!"}

_JAVA = re.compile(
    rf"""[ \t\r\f]*(?:(?P<nl>\n)|(?P<com>//[^\n]*|/\*(?s:.*?)\*/)|(?P<s>\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\[^\n])+')
    |(?P<n>[^\W\d$][\w$]*|\$[\w$]*)|(?P<d>(?:{_NUMBER})[lLfFdD]?(?!\w))|(?P<br>[(){{}}\[\],;])|(?P<op>->|::|\+\+|--|\.\.\.|>>>=|<<=|>>=|<<|&&|\|\||[=!<>+\-*/%&|^]=|[.:=<>+\-*&!/%|^~?@])|(?P<bad>(?s:.)))""",
    re.X,
)
_JAVA_OPS = {"->": "A", "::": ".", "=": "=", "++": "i", "--": "i", "...": "e", ".": ".", ":": ":", "<": "<", ">": ">", "+": "u", "-": "u", "*": "u", "&": "u", "!": "!", "~": "!", "?": "?", "@": "@"}

_PY = re.compile(
    rf"""(?:[ \t\r\f]|\\\r?\n)*(?:(?P<nl>\n)|(?P<com>\#[^\n]*)
    |(?P<s>(?i:[rbuft]{{0,2}})(?:\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|"(?!\"\")(?:[^"\\\n]|\\(?s:.))*"|'(?!'')(?:[^'\\\n]|\\(?s:.))*'))
    |(?P<n>{_NAME})|(?P<d>(?:{_NUMBER})[jJ]?(?!\w))|(?P<br>[(){{}}\[\],;])|(?P<op>->|:=|\.\.\.|\*\*=|//=|<<=|>>=|\*\*|//|<<|>>|[=!<>+\-*/%&|^@]=|[.:=<>+\-*&/%|^~@])|(?P<bad>(?s:.)))""",
    re.X,
)
_PY_OPS = {"->": "A", ":=": "=", "=": "=", "...": "e", ".": ".", ":": ":", "<": "<", ">": ">", "+": "u", "-": "u", "*": "u", "**": "u", "~": "!", "@": "@"}

_JS = re.compile(
    rf"""(?P<ws>[ \t\r\f\v\u00a0\ufeff]+)|(?P<nl>[\n\u2028\u2029])|(?P<com>//[^\n\u2028\u2029]*|/\*(?s:.*?)\*/)|(?P<s>"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*')
    |(?P<n>\#?(?:[^\W\d]|\$)[\w$]*)|(?P<d>(?:{_NUMBER})n?(?![\w$]))|(?P<br>[(){{}}\[\],;])|(?P<op>=>|\+\+|--|\.\.\.|\?\.(?!\d)|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\*\*|<<|&&|\|\||\?\?|[=!<>+\-*/%&|^]=|[.:=<>+\-*&!/%|^~?@`])""",
    re.X,
)
_JS_OPS = {"=>": "A", "=": "=", "++": "i", "--": "i", "...": "e", ".": ".", "?.": ".", ":": ":", "<": "<", ">": ">", "+": "u", "-": "u", "*": "u", "&": "u", "|": "u", "!": "!", "~": "!", "?": "?", "@": "@"}
_JS_PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JSX_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:\-]*)?")
_JSX_ATTR = re.compile(r"\s+|[A-Za-z_$][\w$\-:.]*|=\s*\"[^\"]*\"|=\s*'[^']*'|/\*(?s:.*?)\*/|//[^\n]*")
_ENDS_OPERAND = frozenset("ndsvy)]}i")


def _assigns(text: str) -> bool:
    return len(text) > 1 and text[-1] == "=" and text not in ("==", "!=", "<=", ">=", "===", "!==")


def _scan(text: str, pattern: re.Pattern, ops: dict[str, str], words: dict[str, str]) -> list[Token]:
    out: list[Token] = []
    add, word_kind, op_kind = out.append, words.get, ops.get
    at, size = (1 if text[:1] == "\ufeff" else 0), len(text)
    while at < size:
        stop = at
        for m in pattern.finditer(text, at):
            kind = m.lastgroup
            if kind == "bad":
                stop = m.start("bad")
                break
            start, stop = m.span(kind)
            if kind == "n":
                add((word_kind(text[start:stop], "n"), start, stop))
            elif kind == "br":
                add((text[start], start, stop))
            elif kind == "op":
                op = text[start:stop]
                add((op_kind(op) or ("=" if _assigns(op) else "b"), start, stop))
            elif kind == "nl":
                add((NEWLINE, start, stop))
            elif kind == "com":
                add((COMMENT, start, stop))
            else:
                add((kind, start, stop))
        while stop < size and text[stop] in " \t\r\f\\" and (text[stop] != "\\" or text[stop + 1 : stop + 2] in "\r\n"):
            stop += 1
        if stop < size:
            end = _bad_end(text, stop)
            add((BAD, stop, end))
            at = end
        else:
            at = size
    return out


def _bad_end(text: str, start: int) -> int:
    """End of text that is no token: an unclosed comment or long string takes the rest, a string its line."""
    rest = text[start : start + 3]
    if rest[:2] == "/*" or rest[:1] == "`" or rest in ('"""', "'''"):
        return len(text)
    if rest[:1] in "\"'":
        line = text.find("\n", start)
        return len(text) if line < 0 else line
    if rest[:1].isdigit():
        return re.compile(r"[\w.]+").match(text, start).end()
    return start + 1


class _Script:
    """JavaScript and TypeScript, with templates, patterns and markup."""

    def __init__(self, text: str, markup: bool):
        self.text, self.markup, self.out = text, markup, []
        self.words = KEYWORDS["js"]

    def run(self) -> list[Token]:
        at = 1 if self.text[:1] == "\ufeff" else 0
        if self.text[at : at + 2] == "#!":
            at = self.text.find("\n", at)
            at = len(self.text) if at < 0 else at
        self.code(at, None)
        return self.out

    def last(self) -> str:
        for t in reversed(self.out):
            if t[0] not in "/\n":
                return t[0]
        return "^"

    def code(self, at: int, until: str | None) -> int:
        """Lexes code from ``at``; with ``until`` up to that closing bracket on the same level, else to the end."""
        text, size, add, words = self.text, len(self.text), self.out.append, self.words
        depth = 0
        while at < size:
            stop, again = at, False
            prev = self.last()
            for m in _JS.finditer(text, at):
                kind, start = m.lastgroup, m.start()
                if start != stop:
                    break
                if kind == "ws":
                    stop = m.end()
                    continue
                if kind == "n":
                    kind = "n" if prev == "." else words.get(m.group(), "n")
                elif kind == "br":
                    kind = text[start]
                    if until:
                        if kind in "([{":
                            depth += 1
                        elif kind in ")]}":
                            if depth == 0:
                                return start
                            depth -= 1
                elif kind == "op":
                    op = m.group()
                    if op == "`":
                        stop, again = self.template(start), True
                        prev = "s"
                        break
                    if op[0] == "/" and prev not in _ENDS_OPERAND:
                        p = _JS_PATTERN.match(text, start)
                        if p:
                            add(("s", start, p.end()))
                            stop, again = p.end(), True
                            break
                    if op == "<" and self.markup and prev not in _ENDS_OPERAND and not text[start + 1 : start + 2].isspace():
                        end = self.element(start)
                        if end:
                            stop, again = end, True
                            break
                    kind = _JS_OPS.get(op) or ("=" if _assigns(op) else "b")
                elif kind == "nl":
                    kind = NEWLINE
                elif kind == "com":
                    kind = COMMENT
                stop = m.end()
                add((kind, start, stop))
                if kind not in "/\n":
                    prev = kind
            if again:
                at = stop
                continue
            if stop < size:
                end = _bad_end(text, stop)
                add((BAD, stop, end))
                at = end
            else:
                at = size
        return size

    def _inner(self, start: int) -> int | None:
        """Checks the code of a ``{...}`` inside a string or markup; gives the place after the bracket."""
        kept, self.out = self.out, []
        end = self.code(start, "}")
        inner, self.out = self.out, kept
        if end >= len(self.text) or self.text[end] != "}" or any(t[0] == BAD for t in inner):
            return None
        return end + 1

    def template(self, start: int) -> int:
        text, at = self.text, start + 1
        while True:
            m = re.compile(r"(?s)(?:[^`\\$]|\\.|\$(?!\{))*").match(text, at)
            at = m.end()
            if text[at : at + 1] == "`":
                self.out.append(("s", start, at + 1))
                return at + 1
            inner = self._inner(at + 2) if text[at : at + 2] == "${" else None
            if inner is None:
                self.out.append((BAD, start, len(text)))
                return len(text)
            at = inner

    def element(self, start: int) -> int | None:
        """A markup element as one token; None if the text is no element (a type parameter, a comparison)."""
        end = self._element(start, 0)
        if end is None:
            return None
        self.out.append(("s", start, end))
        return end

    def _element(self, start: int, depth: int) -> int | None:
        text = self.text
        tag = _JSX_TAG.match(text, start)
        if not tag or depth > 200:
            return None
        name, at = tag.group(1), tag.end()
        while True:
            attr = _JSX_ATTR.match(text, at)
            if attr and attr.end() > at:
                at = attr.end()
            elif text[at : at + 1] == "{":
                at = self._inner(at + 1)
            elif text[at : at + 1] == "=" and text[at + 1 : at + 2] == "{":
                at = self._inner(at + 2)
            else:
                break
            if at is None:
                return None
        if text[at : at + 2] == "/>":
            return at + 2
        if text[at : at + 1] != ">":
            return None
        at += 1
        while True:
            m = re.compile(r"[^<{}>]*").match(text, at)
            at = m.end()
            if text[at : at + 1] == "{":
                at = self._inner(at + 1)
            elif text[at : at + 2] == "</":
                close = re.compile(r"</\s*([A-Za-z_$][\w$.:\-]*)?\s*>").match(text, at)
                return close.end() if close and close.group(1) == name else None
            elif text[at : at + 1] == "<":
                at = self._element(at, depth + 1)
            else:
                return None
            if at is None:
                return None


def lex(text: str | None, lang: str, markup: bool = False) -> list[Token]:
    """Tokens of a text, comments and line ends included.  Null and empty texts have none."""
    if not text:
        return []
    if lang == "go":
        return _scan(text, _GO, _GO_OPS, KEYWORDS["go"])
    if lang == "java":
        return _scan(text, _JAVA, _JAVA_OPS, KEYWORDS["java"])
    if lang == "python":
        return _scan(text, _PY, _PY_OPS, KEYWORDS["python"])
    if lang in ("js", "ts"):
        return _Script(text, markup).run()
    raise ValueError(f"no lexer for {lang}")
