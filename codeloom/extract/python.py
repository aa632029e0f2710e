"""Python: symbols, imports, endpoints and connections through the standard parser."""

from __future__ import annotations

import ast
import re
import warnings

from codeloom.extract.patterns import Pattern
from codeloom.extract.rows import FileResult, parent_package
from codeloom.functions.functions import find_functions

_VERBS = frozenset("get post put delete patch head options".split())
_UPPER = re.compile(r"^[A-Z][A-Z0-9_]*$")


def extract_python(path: str, text: str, patterns: list[Pattern] | None = None) -> FileResult:
    """Rows of a Python file; of one that does not parse only its functions."""
    out = FileResult(module=parent_package(path))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            for f in find_functions(text, "python"):
                out.symbol("method" if f.receiver else "func", f.name, out.module, f.line, f.receiver, f.signature, f.doc.strip())
            return out
    lines = text.split("\n")
    _imports(out, tree)
    flask = any("flask" in i["import_path"].lower() for i in out.imports)
    _body(out, tree.body, lines, "", flask)
    for node in tree.body:
        _assigned(out, node)
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            _call(out, node, patterns or [])
    return out


def _imports(out: FileResult, tree: ast.Module) -> None:
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for name in node.names:
                out.use(name.name, name.asname or "")
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for name in node.names:
                out.use(module, name.asname or name.name)


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{word} {node.name}({ast.unparse(node.args)}){back}"


def _body(out: FileResult, body: list[ast.stmt], lines: list[str], owner: str, flask: bool) -> None:
    for node in body:
        if isinstance(node, ast.ClassDef):
            bases = ", ".join(ast.unparse(b) for b in node.bases)
            out.symbol("class", node.name, out.module, node.lineno, owner, f"class {node.name}({bases})" if bases else f"class {node.name}", (ast.get_docstring(node) or "").strip(), node.col_offset + 1)
            _body(out, node.body, lines, node.name, flask)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if not (node.name.startswith("__") and node.name.endswith("__")):
                out.symbol("method" if owner else "func", node.name, out.module, node.lineno, owner, _signature(node), (ast.get_docstring(node) or "").strip(), node.col_offset + 1)
            for mark in node.decorator_list:
                _endpoint(out, mark, node.name, flask)
        elif isinstance(node, (ast.If, ast.Try)) and not owner:
            _body(out, node.body, lines, owner, flask)


def _assigned(out: FileResult, node: ast.stmt) -> None:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
    for target in targets:
        for name in target.elts if isinstance(target, ast.Tuple) else [target]:
            if isinstance(name, ast.Name) and not (name.id.startswith("__") and name.id.endswith("__")):
                out.symbol("const" if _UPPER.match(name.id) else "var", name.id, out.module, node.lineno)


def _string(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _endpoint(out: FileResult, mark: ast.expr, handler: str, flask: bool) -> None:
    if not isinstance(mark, ast.Call) or not isinstance(mark.func, ast.Attribute):
        return
    target = _string(mark.args[0]) if mark.args else next((_string(k.value) for k in mark.keywords if k.arg in ("path", "rule")), None)
    if target is None:
        return
    name = mark.func.attr
    if name == "route":
        given = next((k.value for k in mark.keywords if k.arg == "methods"), None)
        methods = [m for m in map(_string, given.elts) if m] if isinstance(given, (ast.List, ast.Tuple, ast.Set)) else ["GET"]
        for method in methods:
            out.endpoint(method.upper(), target, handler, "flask", mark.lineno)
    elif name in _VERBS:
        out.endpoint(name.upper(), target, handler, "flask" if flask else "fastapi", mark.lineno)


def _call(out: FileResult, node: ast.Call, patterns: list[Pattern]) -> None:
    called = ast.unparse(node.func)
    root, last = re.split(r"[.(]", called, maxsplit=1)[0], called.rsplit(".", 1)[-1]
    for p in patterns:
        if last not in p.names and not ("Stub" in p.names and last.endswith("Stub")):
            continue
        if not any(p.module in i["import_path"] and root in ((i["alias"] or i["import_path"].split(".")[0]), i["import_path"].split(".")[0]) for i in out.imports):
            continue
        named = next((_string(k.value) for k in node.keywords if p.attribute and k.arg == p.attribute), None)
        first = next((s for s in map(_string, node.args) if s is not None), None)
        any_named = next((s for s in (_string(k.value) for k in node.keywords) if s is not None), None)
        target = p.service or named or first or any_named or called
        out.connect(p.conn_type, target, node.lineno)
        return
