"""TypeScript and JavaScript: symbols, imports, routes, connections and API calls of components."""

from __future__ import annotations

import re

from codeloom.extract.patterns import Pattern
from codeloom.extract.rows import FileResult, parent_package

_DECLARED = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_NAMED = r"(?:(?:async\s+)?function\s*\*?\s*|(?:const|let|var)\s+)"
#: Line rules in the order they are tried; the first that fits gives the kind.
_RULES = (
    ("hook", re.compile(rf"^\s*{_DECLARED}{_NAMED}(use[A-Z]\w*)\s*(?:=|\(|<|:)")),
    ("component", re.compile(rf"^\s*{_DECLARED}{_NAMED}([A-Z]\w*)\s*(?:\(|<|:\s*(?:React\.)?(?:FC|FunctionComponent|VFC|NextPage)\b|=\s*(?:async\s*)?(?:\(|(?:React\.)?(?:memo|forwardRef|lazy)\b|[\w$]+\s*=>|function\b|<))")),
    ("class", re.compile(rf"^\s*{_DECLARED}(?:abstract\s+)?class\s+(\w+)\s+extends\s+(?:React\.)?(?:Pure)?Component\b")),
    ("interface", re.compile(rf"^\s*{_DECLARED}interface\s+(\w+)")),
    ("type_alias", re.compile(rf"^\s*{_DECLARED}type\s+(\w+)(?:<[^=]*>)?\s*=")),
)
_IMPORT = re.compile(r"""^\s*(?:import\s+(?:type\s+)?(?:([\w*{}\s,$]+?)\s+from\s+)?|export\s+[\w*{}\s,$]+\s+from\s+|(?:const|let|var)\s+([\w${}\s,:]+?)\s*=\s*require\()['"]([^'"]+)['"]""")
_SCREEN = re.compile(r"<\s*\w+\.Screen\b(.*)")
_ATTRIBUTE = r"""\b{}\s*=\s*(?:['"]([^'"]*)['"]|\{{\s*([^}}]*?)\s*\}})"""
_ROUTE = re.compile(r"<\s*Route\b(.*)")
_ROUTE_OBJECT = re.compile(r"""\bpath\s*:\s*['"`]([^'"`]*)['"`]""")
_ELEMENT = re.compile(r"""(?:element|component|Component)\s*:\s*<?\s*([A-Za-z_$][\w$.]*)""")
#: Calls that reach an API: an HTTP client or a data hook with a method.
_METHOD = re.compile(r"""\b(?:use|api|http|axios|client|request|fetcher)?\w*?\.?(get|post|put|patch|delete)\w*\s*(?:<[^>()]*>)?\(|\bmethod\s*:\s*['"`](get|post|put|patch|delete)['"`]|\b(fetch|query|useQuery|useFetch|request)\s*(?:<[^>()]*>)?\(""", re.I)
_TEMPLATE = re.compile(r"`([^`]*)`")
_STRING = re.compile(r"""['"]([^'"]*)['"]""")
_MEMBER = re.compile(r"\b([A-Z]\w*(?:Api|API|Endpoints?|Urls?|Routes?|Paths?)\.[A-Z_a-z]\w*(?:\.\w+)*)")
_SIGNATURE_LENGTH = 120


def _signature(line: str) -> str:
    text = re.split(r"\{(?!\s*\w+\s*[,}:])|=>", line.strip(), maxsplit=1)[0] if "=>" not in line or "(" not in line else line.strip().split("=>", 1)[0]
    return text.strip().rstrip("{").strip()[:_SIGNATURE_LENGTH]


def _above(lines: list[str], at: int) -> str:
    """Comment lines directly above a line."""
    out = []
    at -= 1
    inside = False
    while at >= 0:
        line = lines[at].strip()
        if line.endswith("*/"):
            inside = True
        if inside or line.startswith("//"):
            out.append(re.sub(r"^/\*+|\*+/$|^//+|^\*", "", line).strip())
            if inside and "/*" in line:
                inside = False
            at -= 1
            continue
        break
    return "\n".join(x for x in reversed(out) if x)


def extract_script(path: str, text: str, patterns: list[Pattern] | None = None) -> FileResult:
    """Rows of a TypeScript or JavaScript file, found line by line."""
    out = FileResult(module=parent_package(path))
    lines = text.lstrip("﻿").replace("\r\n", "\n").split("\n")
    for at, line in enumerate(lines):
        found = _IMPORT.match(line)
        if found:
            out.use(found.group(3), " ".join((found.group(1) or found.group(2) or "").split()))
            continue
        for kind, rule in _RULES:
            m = rule.match(line)
            if m:
                name = m.group(1)
                if kind == "class":
                    out.symbol("component", name, out.module, at + 1, signature="class component", doc=_above(lines, at))
                else:
                    out.symbol(kind, name, out.module, at + 1, signature=_signature(line), doc=_above(lines, at))
                break
    _routes(out, path, lines)
    _connections(out, lines, patterns or [])
    _api_calls(out, lines, patterns or [])
    return out


def _attribute(name: str, text: str) -> str:
    m = re.search(_ATTRIBUTE.format(name), text)
    if not m:
        return ""
    value = m.group(1) if m.group(1) is not None else m.group(2)
    return re.sub(r"^<\s*|\s*/?>.*$", "", value).strip()


def _routes(out: FileResult, path: str, lines: list[str]) -> None:
    joined = "\n".join(lines)
    router = "react-router" in joined or "<Route" in joined or "createBrowserRouter" in joined
    for at, line in enumerate(lines):
        screen = _SCREEN.search(line)
        if screen:
            rest = " ".join(lines[at : at + 6]) if "/>" not in line and ">" not in screen.group(1) else line
            name = _attribute("name", rest)
            if name:
                out.endpoint("SCREEN", name, _attribute("component", rest), "react-navigation", at + 1)
            continue
        route = _ROUTE.search(line)
        if route:
            rest = " ".join(lines[at : at + 6]) if ">" not in route.group(1) else line
            target = _attribute("path", rest)
            if target:
                out.endpoint("GET", target, _attribute("element", rest) or _attribute("component", rest), "react-router", at + 1)
        elif router:
            item = _ROUTE_OBJECT.search(line)
            if item and item.group(1):
                handler = _ELEMENT.search(line) or _ELEMENT.search(lines[at + 1] if at + 1 < len(lines) else "")
                out.endpoint("GET", item.group(1), handler.group(1) if handler else "", "react-router", at + 1)
    expo = expo_path(path)
    if expo is not None and re.search(r"^\s*export\s+default\b", joined, re.M) and "expo-router" in joined:
        handler = re.search(r"export\s+default\s+(?:async\s+)?(?:function\s+)?(\w+)", joined)
        out.endpoint("GET", expo, handler.group(1) if handler else "", "expo-router", 1)


def expo_path(path: str) -> str | None:
    """Route of a file below ``app/``; None for layouts and other files."""
    m = re.search(r"(?:^|/)app/(.*)\.(?:tsx|jsx|ts|js)$", path.replace("\\", "/"))
    if not m:
        return None
    parts = [p for p in m.group(1).split("/") if not re.fullmatch(r"\(.*\)", p)]
    if not parts or parts[-1].startswith(("_", "+")):
        return None
    parts = parts[:-1] if parts[-1] == "index" else parts
    return "/" + "/".join(re.sub(r"^\[(?:\.\.\.)?(.+)\]$", lambda x: ("*" if "..." in x.group(0) else ":") + x.group(1), p) for p in parts)


def _connections(out: FileResult, lines: list[str], patterns: list[Pattern]) -> None:
    seen = set()
    rules = [(p, re.compile(p.regex)) for p in patterns if p.regex]
    for at, line in enumerate(lines):
        for p, rule in rules:
            m = rule.search(line)
            if m:
                target = p.service or (m.group(1) if m.re.groups else m.group(0))
                if target not in seen:
                    seen.add(target)
                    out.connect(p.conn_type, target, at + 1)


def normalise_api_path(path: str) -> str:
    """The general form of a literal API path."""
    path = re.sub(r"^/api(?=/)", "", path)
    variable = re.compile(r"^[:$].+$|^\{.*\}$|\$\{|^\d+$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9a-fA-F]{32}$")
    return "/".join("{id}" if variable.search(s) else s for s in path.split("/"))


def _api_path(text: str) -> str:
    """Path of an API call: a template with a member, a literal path, a member, else nothing."""
    for m in _TEMPLATE.finditer(text):
        value = m.group(1)
        member = re.match(r"\$\{\s*([A-Z]\w*\.\w+(?:\.\w+)*)\s*\}(.*)", value)
        if member:
            return member.group(1) + member.group(2)
        if value.startswith("/"):
            return normalise_api_path(value)
    for m in _STRING.finditer(text):
        if m.group(1).startswith("/"):
            return normalise_api_path(m.group(1))
    member = _MEMBER.search(text) or re.search(r"\b([A-Z]\w+\.[A-Z][A-Z0-9_]+)\b", text)
    return member.group(1) if member else ""


def _api_calls(out: FileResult, lines: list[str], patterns: list[Pattern]) -> None:
    """Calls inside components and hooks; a scope ends where its braces close, within the line if they do."""
    component, start, depth, opened = "", 0, 0, False
    services = [(re.compile(p.regex), p.service) for p in patterns if p.regex and p.service]
    for at, line in enumerate(lines):
        for kind, rule in _RULES[:3]:
            m = rule.match(line)
            if m and (not component or kind != "component" or depth <= start):
                component, start, opened = m.group(1), depth, False
                break
        if component and not line.lstrip().startswith(("import ", "//", "*")):
            m = _METHOD.search(line)
            if m:
                text = " ".join(lines[at : at + 3])[m.start() :]
                target = _api_path(line[m.start() :]) or _api_path(text)
                if target:
                    method = (m.group(1) or m.group(2) or "get").upper()
                    service = next((s for r, s in services if r.search(line)), "")
                    out.component_api_calls.append({"component": component, "http_method": method, "api_path": target, "target_service": service, "line": at + 1, "col": m.start() + 1})
        bare = re.sub(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|//.*$""", "", line)
        for c in bare:
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if component and opened and depth <= start:
                    component = ""
        if component and not opened:
            if depth > start:
                opened = True
            elif bare.rstrip().endswith((";", "}")):
                component = ""
