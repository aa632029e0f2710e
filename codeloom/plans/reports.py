"""What clients read as documents: JSON resources, prompts filled with facts, and the parts of a wiki.

Every section is a small DataFrame with a limit that is part of the feature; only
such lists reach the driver to become text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.rank import latest_per_key
from codeloom.plans.catalog import CodeIndex, list_processes, package_dependencies, package_map
from codeloom.sources.store import render_json

#: Entries of a resource at most.
ENDPOINTS, COMMUNITIES, PROCESSES = 500, 100, 100
#: Entries of a prompt's sections at most.
CALLERS, SERVED, IMPLEMENTED, MEMBERS = 20, 10, 10, 50
#: Entries of a wiki at most: packages, endpoints of one, communities, members of one, calls of the diagram.
WIKI_PACKAGES, WIKI_ENDPOINTS, WIKI_COMMUNITIES, WIKI_MEMBERS, WIKI_CALLS = 20, 20, 20, 30, 30

Writer = Callable[[str, str], str]


# --- resources --------------------------------------------------------------------


def repositories_resource(ix: CodeIndex) -> DataFrame:
    """All repositories by name; missing times and commits are empty."""
    time = F.coalesce(F.date_format("last_indexed_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return ix.repositories.select("id", "name", "path", time.alias("last_indexed_at"), F.coalesce("last_commit", F.lit("")).alias("last_commit")).orderBy("name", "id")


def endpoints_resource(ix: CodeIndex, limit: int = ENDPOINTS) -> DataFrame:
    """Endpoints by path and method with handler and place; missing values are empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    where = ix.files.select(F.col("id").alias("file_id"), F.coalesce("path", F.lit("")).alias("file"))
    rows = ix.fact("api_endpoints").join(where, "file_id").withColumn("handler", F.coalesce("handler_name", F.lit("")))
    return rows.select(empty("method"), empty("path"), "handler", "file", F.coalesce("line", F.lit(0)).alias("line")).orderBy("path", "method", "file", "line").limit(limit)


def communities_resource(found: DataFrame, limit: int = COMMUNITIES) -> DataFrame:
    """Communities of ``detect_communities`` with their sizes."""
    return found.groupBy("repo_id", "community", "name").agg(F.count(F.lit(1)).alias("member_count")).orderBy("repo_id", "community").limit(limit)


def processes_resource(processes: DataFrame, limit: int = PROCESSES) -> DataFrame:
    """Processes of ``detect_processes`` with entry point and number of steps."""
    return list_processes(processes).select("name", F.col("entry").alias("entry_point"), F.col("n_steps").alias("step_count")).limit(limit)


def schema_resource(ix: CodeIndex) -> dict:
    """Tables with their columns, and which column refers to which."""
    tables = {n: df for n in ("repositories", "files", "symbols", "function_calls", "interface_impls", "symbol_embeddings") if (df := getattr(ix, n)) is not None}
    references = {"repo_id": "repositories.id", "file_id": "files.id", "symbol_id": "symbols.id"}
    return {
        "tables": [{"name": n, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]} for n, df in tables.items()],
        "relationships": [f"{n}.{c} -> {to}" for n, df in tables.items() for c, to in references.items() if c in df.columns],
        "examples": [
            "SELECT name, kind, line FROM symbols WHERE file_id = 1 AND kind IN ('func', 'method') ORDER BY line",
            "SELECT caller_qualified_name, callee_name FROM function_calls WHERE confidence >= 0.8",
            "SELECT interface_name, count(DISTINCT struct_name) FROM interface_impls GROUP BY interface_name",
        ],
    }


def read_resource(ix: CodeIndex, name: str, communities: DataFrame | None = None, processes: DataFrame | None = None) -> str:
    """A resource as JSON: repositories, endpoints, schema, communities or processes (the last two empty until detected)."""
    if name == "schema":
        return json.dumps(schema_resource(ix), indent=2)
    if name == "repositories":
        frame = repositories_resource(ix)
        return render_json(frame, frame.count())
    if name == "endpoints":
        return render_json(endpoints_resource(ix), ENDPOINTS)
    if name == "communities":
        return render_json(communities_resource(communities), COMMUNITIES) if communities is not None else "[]"
    if name == "processes":
        return render_json(processes_resource(processes), PROCESSES) if processes is not None else "[]"
    raise ValueError(f"no such resource: {name}")


# --- prompts ----------------------------------------------------------------------


def _section(title: str, lines: list[str], none: str) -> str:
    return f"## {title}\n\n" + "".join(f"- {line}\n" for line in lines or [none]) + "\n"


def _tasks(*tasks: str) -> str:
    return "## Task\n\n" + "".join(f"{n}. {task}\n" for n, task in enumerate(tasks, 1))


def known_callers(ix: CodeIndex, symbol: str, limit: int = CALLERS) -> DataFrame:
    """Calls of functions whose name holds a text, surest first."""
    rows = ix.function_calls.where(F.col("callee_name").ilike(f"%{symbol}%")).select("caller_qualified_name", "callee_name", "confidence").distinct()
    return rows.orderBy(F.desc_nulls_last("confidence"), "caller_qualified_name", "callee_name").limit(limit)


def touching_implementations(ix: CodeIndex, symbol: str, limit: int = IMPLEMENTED) -> DataFrame:
    """Implementations whose interface or type holds a text."""
    hit = F.col("interface_name").ilike(f"%{symbol}%") | F.col("struct_name").ilike(f"%{symbol}%")
    rows = ix.interface_impls.where(hit).select("interface_name", "struct_name", "method_name", F.coalesce("confidence", F.lit(0.85)).alias("confidence")).distinct()
    return rows.orderBy("interface_name", "struct_name", "method_name", "confidence").limit(limit)


def detect_impact_prompt(ix: CodeIndex, symbol: str) -> str:
    """Asks for the impact of a change, with callers, endpoints and implementations from the index."""
    if not symbol:
        raise ValueError("a symbol is needed")
    callers = [f"`{r[0]}` calls `{r[1]}` (confidence {r[2] or 0:.2f})" for r in known_callers(ix, symbol).collect()]
    served = ix.fact("api_endpoints").where(F.col("handler_name").ilike(f"%{symbol}%")).select("method", "path").distinct().orderBy("path", "method").limit(SERVED)
    impls = [f"`{r['struct_name']}` has `{r['interface_name']}.{r['method_name']}` (confidence {r['confidence']:.2f})" for r in touching_implementations(ix, symbol).collect()]
    return (
        f"What does a change of `{symbol}` touch?\n\n"
        + _section("Callers in the index", callers, "(none)")
        + _section("Endpoints that it handles", [f"{r[0]} {r[1]}" for r in served.collect()], "(none)")
        + _section("Implementations", impls, "(none)")
        + _tasks("Name the functions a change reaches at once.", "Name the endpoints that may break.", "Say which interfaces would have to change with it.", "Say how many layers the change goes through.")
    )


def generate_map_prompt(ix: CodeIndex, scope: str = "all") -> str:
    """Asks for a diagram of the packages and the calls between them."""
    packages = [f"`{r['package']}` ({r['n_symbols']} symbols)" for r in package_map(ix).collect()]
    calls = [f"`{r['caller']}` to `{r['callee']}` ({r['n_calls']} calls)" for r in package_dependencies(ix).collect()]
    return (
        f"Draw the code as a Mermaid diagram; scope: `{scope or 'all'}`.\n\n"
        + _section("Packages", packages, "(none)")
        + _section("Calls between packages", calls, "(none)")
        + _tasks("Lay the graph out from top to bottom (`graph TD`).", "Put packages that belong together into subgraphs.", "Write the number of calls on each edge.", "Make packages of handlers and endpoints stand out.", "Answer with the Mermaid block only.")
    )


def explain_community_prompt(communities: DataFrame, name: str, limit: int = MEMBERS) -> str:
    """Asks what a community is for, with its members."""
    if not name:
        raise ValueError("the name of a community is needed")
    members = communities.where(F.col("name").ilike(f"%{name}%")).select("node").distinct().orderBy("node").limit(limit)
    return (
        f"What is the community `{name}` for?\n\n"
        + _section("Members", [f"`{r[0]}`" for r in members.collect()], "(no such community)")
        + _tasks("Say what it is mainly responsible for.", "Say whether it is domain logic, infrastructure or cuts across both.", "Explain the functions that matter most.", "Propose a name that tells its purpose.")
    )


# --- skill files and wiki ------------------------------------------------------------


def common_folder(paths: list[str]) -> str:
    """The deepest folder that holds all paths; ``.`` if there is none."""
    folders = [p.split("/")[:-1] for p in paths]
    if not folders:
        return "."
    shared = os.path.commonprefix(folders)
    return "/".join(shared) or "."


def community_parts(ix: CodeIndex, communities: DataFrame, members: int = MEMBERS, files: int = 20) -> DataFrame:
    """``(repo_id, community, name, members, files)``: the first members of each community and files that define them."""
    key = ["repo_id", "community", "name"]
    numbered = latest_members_of(communities, members)
    where = ix.files.select(F.col("id").alias("file_id"), "repo_id", "path")
    defined = ix.symbols.where("qualified_name is not null").select("file_id", F.col("qualified_name").alias("node")).join(where, "file_id").select("repo_id", "node", "path").distinct()
    rows = numbered.join(defined, ["repo_id", "node"], "left")
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set("node")).alias("members"), F.slice(F.array_sort(F.collect_set("path")), 1, files).alias("files"))


def latest_members_of(communities: DataFrame, members: int) -> DataFrame:
    """The first members by name of each community."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("repo_id", "community").orderBy("node"))
    return communities.select("repo_id", "community", "name", "node").withColumn("n", n).where(F.col("n") <= members).drop("n")


def skill_files(ix: CodeIndex, communities: DataFrame, repo_id: int, write: Writer | None = None) -> list[tuple[str, str]]:
    """``(path, text)`` of a SKILL.md for each community of a repository.

    ``write`` turns instructions and facts into prose (a language model); without
    one, or where it fails, the facts themselves are the text.
    """
    out = []
    for r in community_parts(ix, communities.where(F.col("repo_id") == repo_id)).orderBy("community").toLocalIterator():
        facts = f"Community: {r['name']}\n\nMembers ({len(r['members'])}):\n" + "".join(f"- `{m}`\n" for m in r["members"]) + "\nFiles:\n" + "".join(f"- {f}\n" for f in r["files"])
        out.append((f"{common_folder(list(r['files']))}/SKILL.md", _written(write, "Explain in Markdown what this group of functions does.", r["name"], facts)))
    return out


def _written(write: Writer | None, instructions: str, title: str, facts: str) -> str:
    if write is not None:
        try:
            return write(instructions, facts)
        except Exception as error:  # a writer that fails must not cost the other pages
            return f"# {title}\n\n_Not written: {error}_\n\n{facts}"
    return f"# {title}\n\n{facts}"


def call_diagram(ix: CodeIndex, limit: int = WIKI_CALLS) -> str:
    """Calls between packages as a Mermaid graph."""
    clean = lambda name: re.sub(r"\W", "_", name)
    rows = package_dependencies(ix, limit).collect()
    return "```mermaid\ngraph TD\n" + "".join(f"  {clean(r['caller'])} -->|{r['n_calls']} calls| {clean(r['callee'])}\n" for r in rows) + "```\n"


def wiki_pages(ix: CodeIndex, communities: DataFrame, repo_id: int, write: Writer | None = None) -> dict[str, str]:
    """Path to text of a wiki: architecture, packages, communities and an index of them."""
    pages = {"architecture.md": _written(write, "Describe the architecture in Markdown.", "Architecture", call_diagram(ix))}
    wanted = package_map(ix, WIKI_PACKAGES)
    ends = ix.fact("api_endpoints").join(ix.files.select(F.col("id").alias("file_id"), "module"), "file_id").select(F.col("module").alias("package"), F.concat_ws(" ", "method", "path").alias("end"), "id")
    first = latest_per_key(ends.join(F.broadcast(wanted.select("package")), "package", "left_semi"), ["package", "end"], [F.asc("id")])  # at most WIKI_PACKAGES names
    served: dict[str, list[str]] = {}
    for r in first.orderBy("package", "end").limit(WIKI_PACKAGES * WIKI_ENDPOINTS).collect():
        served.setdefault(r["package"], []).append(r["end"])
    for r in wanted.collect():
        facts = f"{r['n_symbols']} symbols\n" + "".join(f"- {e}\n" for e in served.get(r["package"], [])[:WIKI_ENDPOINTS])
        pages[f"services/{file_name(r['package'])}.md"] = _written(write, "Describe this package in Markdown.", r["package"], facts)
    parts = community_parts(ix, communities.where(F.col("repo_id") == repo_id), WIKI_MEMBERS).orderBy("community").limit(WIKI_COMMUNITIES)
    for r in parts.collect():
        pages[f"communities/{file_name(r['name'])}.md"] = _written(write, "Describe this group of functions in Markdown.", r["name"], "".join(f"- `{m}`\n" for m in r["members"]))
    pages["index.md"] = "# Wiki\n\n" + "".join(f"- [{path.rsplit('/', 1)[-1].removesuffix('.md')}]({path})\n" for path in sorted(pages))
    return pages


def file_name(name: str) -> str:
    """A name as a file name: lower case, everything but letters, digits and ``-`` becomes one ``-``."""
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "unnamed"
