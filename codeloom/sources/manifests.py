"""Dependencies and aliases from project manifests."""

from __future__ import annotations

import json
import os
import re


def go_module(text: str) -> str:
    """Module name of a go.mod file."""
    m = re.search(r"^module\s+(\S+)", text, re.M)
    return m.group(1) if m else ""


def go_requires(text: str) -> list[str]:
    """Required modules of a go.mod file, indirect ones included."""
    out, inside = [], False
    for line in text.split("\n"):
        line = line.split("//", 1)[0].strip()
        if inside and line == ")":
            inside = False
        elif re.match(r"require\s*\($", line):
            inside = True
        elif inside and line:
            out.append(line.split()[0])
        elif line.startswith("require "):
            out.append(line.split()[1])
    return out


def package_dependencies(text: str) -> list[str]:
    """Names in dependencies and devDependencies of a package.json file; none if it is no JSON object."""
    try:
        loaded = json.loads(text)
    except ValueError:
        return []
    if not isinstance(loaded, dict):
        return []
    return [name for part in ("dependencies", "devDependencies") for name in (loaded.get(part) or {})]


def requirements(text: str) -> list[str]:
    """Names in a requirements.txt file in lower case, without versions, extras and options."""
    out = []
    for line in text.split("\n"):
        m = re.match(r"\s*([A-Za-z0-9][\w.\-]*)", line.split("#", 1)[0])
        if m:
            out.append(m.group(1).lower())
    return out


def maven_dependencies(text: str) -> list[str]:
    """``group:artifact`` of the dependencies of a pom.xml file."""
    out = []
    for block in re.findall(r"<dependency>(.*?)</dependency>", text, re.S):
        group, artifact = (re.search(rf"<{tag}>\s*([^<\s]+)\s*</{tag}>", block) for tag in ("groupId", "artifactId"))
        if group and artifact:
            out.append(f"{group.group(1)}:{artifact.group(1)}")
    return out


def tsconfig_aliases(text: str) -> dict[str, str]:
    """Path aliases of a tsconfig.json file, comments and trailing commas allowed: alias to its first target."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    try:
        loaded = json.loads(re.sub(r",\s*([}\]])", r"\1", bare))
    except ValueError:
        return {}
    paths = ((loaded.get("compilerOptions") or {}).get("paths") or {}) if isinstance(loaded, dict) else {}
    return {k.removesuffix("/*"): v[0].removesuffix("/*") for k, v in paths.items() if isinstance(v, list) and v}


def discover(repository: str) -> dict:
    """Manifests at the root of a checkout: ``module``, ``dependencies`` and ``aliases``."""

    def read(name: str) -> str:
        path = os.path.join(repository, name)
        if not os.path.isfile(path):
            return ""
        with open(path, encoding="utf-8", errors="replace") as text:
            return text.read()

    go_mod = read("go.mod")
    dependencies = [*go_requires(go_mod), *package_dependencies(read("package.json") or "{}"), *requirements(read("requirements.txt")), *maven_dependencies(read("pom.xml"))]
    aliases: dict[str, str] = {}
    for name in ("tsconfig.json", "tsconfig.app.json", "tsconfig.base.json"):
        aliases = aliases or tsconfig_aliases(read(name) or "{}")
    return {"module": go_module(go_mod), "dependencies": list(dict.fromkeys(dependencies)), "aliases": aliases}
