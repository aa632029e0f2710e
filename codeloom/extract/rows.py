"""The nested result of one file and its Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fields of each table an extractor fills, as Spark types.
TABLES: dict[str, dict[str, str]] = {
    "symbols": {"kind": "string", "name": "string", "qualified_name": "string", "signature": "string", "receiver": "string", "line": "int", "col": "int", "doc_comment": "string"},
    "imports": {"import_path": "string", "alias": "string"},
    "function_calls": {"caller_qualified_name": "string", "callee_name": "string", "callee_package": "string", "line": "int", "col": "int", "confidence": "double"},
    "type_usages": {"symbol_name": "string", "type_name": "string", "direction": "string", "position": "int", "line": "int"},
    "interface_methods": {"interface_name": "string", "method_name": "string"},
    "receiver_methods": {"struct_name": "string", "method_name": "string"},
    "api_endpoints": {"method": "string", "path": "string", "handler_name": "string", "framework": "string", "line": "int"},
    "service_connections": {"conn_type": "string", "target": "string", "line": "int"},
    "component_api_calls": {"component": "string", "http_method": "string", "api_path": "string", "target_service": "string", "line": "int", "col": "int"},
}


def schema() -> str:
    """DDL of the nested result: one array of structs per table."""
    return ", ".join(f"{name} array<struct<{', '.join(f'{f}: {t}' for f, t in fields.items())}>>" for name, fields in TABLES.items())


@dataclass
class FileResult:
    """Rows of one file; every row is a dictionary with the fields of its table."""

    module: str = ""
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    function_calls: list[dict] = field(default_factory=list)
    type_usages: list[dict] = field(default_factory=list)
    interface_methods: list[dict] = field(default_factory=list)
    receiver_methods: list[dict] = field(default_factory=list)
    api_endpoints: list[dict] = field(default_factory=list)
    service_connections: list[dict] = field(default_factory=list)
    component_api_calls: list[dict] = field(default_factory=list)

    def symbol(self, kind: str, name: str, package: str, line: int, receiver: str = "", signature: str = "", doc: str = "", col: int = 1) -> str:
        """Adds a symbol and gives its qualified name."""
        prefix = f"{package}." if package else ""
        qualified = f"{prefix}({receiver}).{name}" if receiver else f"{prefix}{name}"
        self.symbols.append({"kind": kind, "name": name, "qualified_name": qualified, "signature": signature, "receiver": receiver, "line": line, "col": col, "doc_comment": doc})
        return qualified

    def endpoint(self, method: str, path: str, handler: str, framework: str, line: int) -> None:
        """Adds an endpoint."""
        self.api_endpoints.append({"method": method, "path": path, "handler_name": handler, "framework": framework, "line": line})

    def connect(self, kind: str, target: str, line: int) -> None:
        """Adds a connection to another service."""
        self.service_connections.append({"conn_type": kind, "target": target, "line": line})

    def use(self, import_path: str, alias: str = "") -> None:
        """Adds an import."""
        self.imports.append({"import_path": import_path, "alias": alias})


def parent_package(path: str) -> str:
    """Name of the directory a file lies in."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    return parts[-2] if len(parts) > 1 else ""


def plain_doc(doc: str) -> str:
    """A documentation comment without its comment marks."""
    lines = []
    for line in doc.replace("\r", "").split("\n"):
        line = line.strip()
        for mark in ("/**", "/*", "///", "//", "*/"):
            if line.startswith(mark):
                line = line[len(mark) :]
                break
        else:
            line = line[1:] if line.startswith("*") else line
        lines.append(line.removesuffix("*/").strip())
    return "\n".join(lines).strip()
