"""The query catalogue: one function per question, each giving a DataFrame."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import last_segment, normalise_path, package_of
from codeloom.functions.text import STOP_WORDS, bm25_of_postings, identifier_tokens, postings
from codeloom.operators.cdc import set_flag, upsert
from codeloom.operators.graph import communities, reach, weakest_link_paths
from codeloom.operators.rank import cosine, latest_per_key, mode_per_group, reciprocal_rank_fusion, top_k
from codeloom.plans.indexing import extract_files, facts
from codeloom.session import cut_lineage, table

FUNCTIONS = ("func", "method", "hook", "component")
EMBEDDED_KINDS = ("func", "method", "interface")
#: Characters of documentation in a result list.
DOC_CHARS = 100
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass
class CodeIndex:
    """The tables questions are asked of; those not given are taken as derived from the texts."""

    repositories: DataFrame
    files: DataFrame
    sources: DataFrame
    symbols: DataFrame
    function_calls: DataFrame
    interface_impls: DataFrame
    symbol_embeddings: DataFrame | None = None
    extracted: DataFrame | None = None
    word_index: tuple[DataFrame, DataFrame] | None = None
    _facts: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, directory: str) -> CodeIndex:
        """The index in a data directory."""
        names = ("repositories", "files", "symbols", "function_calls", "interface_impls", "symbol_embeddings")
        return cls(sources=table(spark, directory, "source_file"), **{n: table(spark, directory, n) for n in names})

    def nested(self) -> DataFrame:
        """Everything extracted from the texts, one row per file, computed once."""
        if self.extracted is None:
            self.extracted = cut_lineage(extract_files(self.sources))
        return self.extracted

    def fact(self, name: str) -> DataFrame:
        """A table extracted from the texts: imports, api_endpoints, type_usages and so on."""
        if name not in self._facts:
            self._facts[name] = facts(self.nested(), name)
        return self._facts[name]

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the repository and path of their file."""
        where = self.files.select(F.col("id").alias("file_id"), "repo_id", F.col("path").alias("file"))
        named = self.repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"))
        return rows.join(where, "file_id", "left").join(named, "repo_id", "left")


def call_edges(ix: CodeIndex, min_confidence: float = 0.0) -> DataFrame:
    """``(repo_id, src, dst, confidence, line)``: calls between functions of a repository.

    A callee is resolved by package and name, without a package by name alone.
    """
    where = ix.files.select(F.col("id").alias("file_id"), "repo_id")
    calls = ix.function_calls.where((F.col("confidence") >= min_confidence) | F.col("confidence").isNull()).join(where, "file_id")
    calls = calls.select("repo_id", F.col("caller_qualified_name").alias("src"), F.trim("callee_name").alias("name"), F.coalesce(F.trim("callee_package"), F.lit("")).alias("package"), F.coalesce("confidence", F.lit(0.5)).cast("double").alias("confidence"), "line")
    targets = (
        ix.symbols.where(F.col("kind").isin(*FUNCTIONS) & F.col("qualified_name").isNotNull())
        .join(where, "file_id")
        .select("repo_id", "name", package_of("qualified_name").alias("package"), F.col("qualified_name").alias("dst"))
        .distinct()
    )
    named = calls.where("package <> ''").join(targets, ["repo_id", "package", "name"])
    bare = calls.where("package = ''").join(targets.drop("package"), ["repo_id", "name"])
    keep = ["repo_id", "src", "dst", "confidence", "line"]
    return named.select(*keep).unionByName(bare.select(*keep))


# --- search -------------------------------------------------------------------


def build_word_index(ix: CodeIndex) -> tuple[DataFrame, DataFrame]:
    """Postings of the symbols' words ``(token, id, n, length)`` and their figures, to be stored with the index."""
    text = F.concat_ws(" ", "name", "qualified_name", "signature", "doc_comment")
    return postings(ix.symbols.select("id", text.alias("text")), "id", identifier_tokens("text"))


def keyword_search(ix: CodeIndex, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Symbols that hold every word of the query, best first: ``(id, score, rank)``.

    Reads the postings of the words in ``word_index``; without one they are derived.
    Rarity and length count over all symbols, of whatever kind.
    """
    terms = [t for t in re.findall(r"[^\W_]+", query.lower()) if t not in STOP_WORDS]
    if not terms:
        return ix.symbols.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    scored = bm25_of_postings(*(ix.word_index or build_word_index(ix)), "id", terms).withColumn("score", F.round("score", 6))
    if kind is not None:
        scored = scored.join(ix.symbols.where(F.col("kind") == kind).select("id"), "id", "left_semi")
    return top_k(scored, limit, F.desc("score"), F.asc("id"))


def hashing_embedder(dimensions: int = 96) -> Embedder:
    """A deterministic stand-in for a model: signed hashes of words, scaled to length one."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions), np.float64)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()

    return embed


def semantic_search(ix: CodeIndex, query: str, limit: int = 20, kind: str | None = None, embedder: Embedder | None = None, **equal: str) -> DataFrame:
    """Symbols whose vectors are nearest to the query's; ``equal`` filters on service, kind, file or name first."""
    vector = (embedder or hashing_embedder())([query])[0]
    rows = latest_per_key(ix.symbol_embeddings, ["symbol_id"], [F.desc("created_at")])
    for name, value in (equal | ({"kind": kind} if kind else {})).items():
        if name not in ("service", "kind", "file", "name"):
            raise ValueError(f"no such filter: {name}")
        rows = rows.where(F.col(name) == value)
    scored = rows.select(F.col("symbol_id").alias("id"), F.round(cosine(F.col("embedding"), F.array(*map(F.lit, vector))), 6).alias("score")).where("score is not null and not isnan(score)")
    return top_k(scored, limit, F.desc("score"), F.asc("id"))


def search_code(ix: CodeIndex, query: str, limit: int = 20, kind: str | None = None, mode: str = "hybrid", embedder: Embedder | None = None) -> DataFrame:
    """Symbols for a query by keyword, by vector or by both fused; without vectors by keyword.

    Results come with the first ``DOC_CHARS`` characters of their documentation and the code at their place.
    """
    if mode == "keyword" or ix.symbol_embeddings is None:
        found = keyword_search(ix, query, limit, kind).select("id", "score")
    elif mode == "semantic":
        found = semantic_search(ix, query, limit, kind, embedder).select("id", "score")
    else:
        legs = [keyword_search(ix, query, 2 * limit, kind), semantic_search(ix, query, 2 * limit, kind, embedder)]
        found = reciprocal_rank_fusion(legs, "id", limit)
    doc = F.when(F.length("doc_comment") > DOC_CHARS, F.concat(F.left("doc_comment", F.lit(DOC_CHARS)), F.lit("..."))).otherwise(F.col("doc_comment"))
    rows = with_snippets(ix, ix.placed(found.join(ix.symbols, "id")))
    return rows.select("id", "score", "kind", "name", "qualified_name", "signature", doc.alias("doc"), "file", "line", "repo_name", "snippet").orderBy(F.desc("score"), "id")


def find_symbol(ix: CodeIndex, name: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols by name: exact ones first (``match`` 0), then those whose words match (1), each by id."""
    exact = ix.symbols.where(F.lower("name") == name.lower())
    exact = exact if kind is None else exact.where(F.col("kind") == kind)
    words = keyword_search(ix, name, limit, kind).select("id").join(ix.symbols, "id").withColumn("match", F.lit(1))
    both = exact.withColumn("match", F.lit(0)).unionByName(words)
    best = both.withColumn("match", F.min("match").over(Window.partitionBy("id"))).dropDuplicates(["id"])
    rows = with_snippets(ix, ix.placed(best.orderBy("match", "id").limit(limit)))
    return rows.select("match", "id", "kind", "name", "qualified_name", "signature", "receiver", "file", "line", "doc_comment", "snippet").orderBy("match", "id")


def get_file_symbols(ix: CodeIndex, path: str) -> DataFrame:
    """Symbols of one file in order."""
    files = ix.files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    return ix.symbols.join(files, "file_id", "left_semi").select("kind", "name", "qualified_name", "signature", "line").orderBy("line", "name", "kind")


def snippet(text: Column, line: Column, most: int = 12) -> Column:
    """Code at a symbol's line: from the line before it until its braces close, at most ``most`` lines.

    Lines are indented by two blanks; where open braces are cut off, ``...`` follows.
    Null where the text has no such line.
    """
    lines, at = F.split(text, r"\r?\n"), F.greatest(line, F.lit(1))
    net = lambda t: F.length(F.regexp_replace(t, r"[^{]", "")) - F.length(F.regexp_replace(t, r"[^}]", ""))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("end"))

    def step(s: Column, t: Column) -> Column:
        depth, opened, n = s["depth"] + net(t), s["opened"] | t.contains("{"), s["n"] + 1
        after = F.struct(n.alias("n"), depth.alias("depth"), opened.alias("opened"), F.when(opened & (depth <= 0), n).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(after)

    scan = F.aggregate(F.slice(lines, at, F.lit(most)), state, step)
    first = F.greatest(at - 1, F.lit(1))
    last = F.least(first + most - 1, F.when(scan["end"] > 0, at + scan["end"] - 1).otherwise(F.size(lines)))
    shown = F.transform(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), lambda t: F.concat(F.lit("  "), t, F.lit("\n")))
    cut = F.when((last < F.size(lines)) & scan["opened"] & (scan["depth"] > 0), F.lit("  ...\n")).otherwise(F.lit(""))
    return F.when((line >= 1) & (line <= F.size(lines)), F.concat(F.array_join(shown, ""), cut))


def with_snippets(ix: CodeIndex, rows: DataFrame, most: int = 12) -> DataFrame:
    """Rows with ``file_id`` and ``line`` and the code there as ``snippet``; meant for result lists, not whole tables."""
    own = ix.sources.select("file_id", F.col("content").alias("__content"))
    return rows.join(own, "file_id", "left").withColumn("snippet", snippet(F.col("__content"), F.col("line"), most)).drop("__content")


# --- calls --------------------------------------------------------------------


def _targets(ix: CodeIndex, name: str) -> DataFrame:
    match = (F.col("name") == name) | F.col("qualified_name").contains(name)
    return ix.symbols.where(F.col("kind").isin(*FUNCTIONS) & match & F.col("qualified_name").isNotNull()).select(F.col("qualified_name").alias("target")).distinct()


def _repo_edges(ix: CodeIndex, edges: DataFrame, repo: str | None) -> DataFrame:
    if repo is None:
        return edges
    return edges.join(ix.repositories.where(F.col("name") == repo).select(F.col("id").alias("repo_id")), "repo_id", "left_semi")


def implementing_methods(ix: CodeIndex) -> DataFrame:
    """``(interface_name, method_name, qualified, confidence)``: methods by the interface they implement."""
    return ix.interface_impls.select("interface_name", "method_name", F.concat_ws(".", "struct_name", "method_name").alias("qualified"), "confidence").where("struct_name is not null and method_name is not null")


def siblings(ix: CodeIndex, targets: DataFrame, same_method: bool = True) -> DataFrame:
    """``(target)``: methods that implement an interface which a target implements; with ``same_method`` of the same name only."""
    impl = implementing_methods(ix).select("interface_name", "method_name", "qualified").distinct()
    own = impl.join(targets.select(F.col("target").alias("qualified")), "qualified", "left_semi")
    on = ["interface_name", "method_name"] if same_method else ["interface_name"]
    return impl.join(own.select(*on).distinct(), on).select(F.col("qualified").alias("target")).distinct()


def impact_callers(ix: CodeIndex, name: str, depth: int = 5, repo: str | None = None, min_confidence: float = 0.0, same_method: bool = True) -> DataFrame:
    """``(caller, depth, confidence)``: all callers of a function, and those of its siblings one step further."""
    edges = cut_lineage(_repo_edges(ix, call_edges(ix, min_confidence), repo).select("src", "dst", "confidence").distinct())
    targets = cut_lineage(_targets(ix, name))
    direct = weakest_link_paths(edges, targets, "src", "dst", "confidence", depth)
    via = weakest_link_paths(edges, siblings(ix, targets, same_method), "src", "dst", "confidence", depth).withColumn("depth", F.col("depth") + 1)
    return direct.unionByName(via).groupBy(F.col("node").alias("caller"), "depth").agg(F.round(F.max("confidence"), 4).alias("confidence"))


def find_callers(ix: CodeIndex, name: str, depth: int = 5, repo: str | None = None, min_confidence: float = 0.0, same_method: bool = True, limit: int | None = 50) -> DataFrame:
    """Direct and indirect callers ``(caller, depth, confidence)``, surest first.

    Callers of methods that implement an interface of the target count one step
    further; with ``same_method`` only methods of the same name are siblings.
    Without any caller, calls by that name count with confidence 0.3.
    """
    found = cut_lineage(impact_callers(ix, name, depth, repo, min_confidence, same_method))
    guessed = (
        _repo_edges(ix, ix.function_calls.join(ix.files.select(F.col("id").alias("file_id"), "repo_id"), "file_id"), repo)
        .where(F.trim("callee_name") == name)
        .select(F.col("caller_qualified_name").alias("caller"), F.lit(1).alias("depth"), F.lit(0.3).alias("confidence"))
        .distinct()
    )
    rows = guessed if found.isEmpty() else found
    ordered = rows.orderBy(F.desc("confidence"), "depth", "caller")
    return ordered.limit(limit) if limit else ordered


def find_callers_by_text(ix: CodeIndex, name: str, each: int = 30) -> DataFrame:
    """``(asked, id, kind, qualified_name, line)``: where no call graph is wanted, symbols found by the name's words.

    A name ``Interface.Method`` also asks for the methods that implement it.  Each
    name gives its best ``each`` symbols; the same place comes once.
    """
    names = [name]
    if "." in name:
        interface, method = name.split(".")[-2:]
        impl = implementing_methods(ix).where(F.col("interface_name").ilike(f"%{interface}%") & (F.col("method_name") == method))
        names += [r[0] for r in impl.select("qualified").distinct().orderBy("qualified").limit(each).collect()]
    found = None
    for n, asked in enumerate(dict.fromkeys(names)):
        hits = keyword_search(ix, asked, each).select("id", "rank", F.lit(n).alias("n"), F.lit(asked).alias("asked"))
        found = hits if found is None else found.unionByName(hits)
    rows = found.join(ix.symbols.select("id", "kind", "qualified_name", "line"), "id")
    first = latest_per_key(rows, ["qualified_name", "line"], [F.asc("n"), F.asc("rank"), F.asc("id")])
    return first.orderBy("n", "rank", "id").select("asked", "id", "kind", "qualified_name", "line")


def served_by(ix: CodeIndex, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoints ``(method, path)`` whose handler is one of ``names (handler)``, and components ``(component)`` that call their paths."""
    served = ix.fact("api_endpoints").withColumn("handler", last_segment("handler_name")).join(names, "handler", "left_semi")
    paths = served.select(normalise_path("path").alias("api_path")).distinct()
    return served.select("method", "path").distinct(), ix.fact("component_api_calls").join(paths, "api_path", "left_semi").select("component").distinct()


def analyze_impact(ix: CodeIndex, name: str, depth: int = 5, repo: str | None = None) -> DataFrame:
    """``(bucket, name, depth)``: callers of a symbol (direct, transitive, name_match), and the endpoints and components they serve.

    A caller counts once, by its shortest way.
    """
    callers = cut_lineage(find_callers(ix, name, depth, repo, limit=None))
    bucket = F.when(F.col("confidence") <= 0.3, "name_match").when(F.col("depth") == 1, "direct").otherwise("transitive")
    rows = callers.groupBy("caller").agg(F.min("depth").alias("depth"), F.max("confidence").alias("confidence"))
    hit = rows.select(bucket.alias("bucket"), F.col("caller").alias("name"), "depth")
    names = rows.select(last_segment("caller").alias("handler")).unionByName(ix.symbols.where(F.col("name") == name).select(F.col("name").alias("handler"))).distinct()
    endpoints, components = served_by(ix, names)
    none = F.lit(None).cast("int").alias("depth")
    return hit.unionByName(endpoints.select(F.lit("endpoint").alias("bucket"), F.concat_ws(" ", "method", "path").alias("name"), none)).unionByName(components.select(F.lit("component").alias("bucket"), F.col("component").alias("name"), none))


def impact_totals(impact: DataFrame) -> DataFrame:
    """One row ``(functions, endpoints, components)`` of an impact list."""
    count = lambda *b: F.count_if(F.col("bucket").isin(*b))
    return impact.agg(count("direct", "transitive", "name_match").alias("functions"), count("endpoint").alias("endpoints"), count("component").alias("components"))


def trace_type_flow(ix: CodeIndex, type_name: str, direction: str = "both", steps: int = 3) -> DataFrame:
    """Producers and consumers of a type, and the chains in which a producer reaches a consumer within ``steps`` calls."""
    usage = ix.fact("type_usages").where(F.col("type_name").ilike(f"%{type_name}%")).select("symbol_name", "type_name", "direction").distinct()
    wanted = {"both": ("input", "output"), "producers": ("output",), "consumers": ("input",)}[direction]
    listed = usage.where(F.col("direction").isin(*wanted)).select(F.when(F.col("direction") == "output", "producer").otherwise("consumer").alias("role"), F.col("symbol_name").alias("name"), F.lit(None).cast("string").alias("reaches"))
    if direction != "both":
        return listed
    made, used = (usage.where(F.col("direction") == d).select("symbol_name").distinct() for d in ("output", "input"))
    seen = reach(call_edges(ix), made.select(F.col("symbol_name").alias("start")), "src", "dst", steps, carry_start=True).where("depth > 0")
    chains = seen.join(used.select(F.col("symbol_name").alias("node")), "node").select(F.lit("chain").alias("role"), F.col("start").alias("name"), F.col("node").alias("reaches"))
    return listed.unionByName(chains)


# --- services, endpoints, components -------------------------------------------


def list_api_endpoints(ix: CodeIndex, method: str | None = None, service: str | None = None) -> DataFrame:
    """Endpoints, each method and path once: of the repository indexed last."""
    rows = ix.fact("api_endpoints").withColumnRenamed("repo", "service").join(ix.repositories.select(F.col("name").alias("service"), "last_indexed_at"), "service", "left")
    rows = rows if method is None else rows.where(F.upper("method") == method.upper())
    rows = rows if service is None else rows.where(F.col("service").ilike(f"%{service}%"))
    return latest_per_key(rows, ["method", "path"], [F.desc_nulls_last("last_indexed_at"), F.asc("service"), F.asc("id")]).select("method", "path", "handler_name", "framework", "service", "line")


def list_services(ix: CodeIndex) -> DataFrame:
    """Modules of the files, or the repositories where no file has a module."""
    modules = ix.files.where(F.coalesce("module", F.lit("")) != "").select(F.col("module").alias("service")).distinct()
    return modules if not modules.isEmpty() else ix.repositories.select(F.col("name").alias("service")).distinct()


def get_service_dependencies(ix: CodeIndex, service: str) -> DataFrame:
    """Packages that the files of a repository or module import."""
    files = ix.files.join(ix.repositories.select(F.col("id").alias("repo_id"), "name"), "repo_id").where((F.col("name") == service) | (F.col("module") == service)).select(F.col("id").alias("file_id"))
    return ix.fact("imports").join(files, "file_id", "left_semi").select("import_path").where(F.col("import_path") != service).distinct().orderBy("import_path")


def get_api_handlers(ix: CodeIndex, pattern: str, limit: int = 20) -> DataFrame:
    """Functions whose name or qualified name holds a text."""
    match = F.col("name").contains(pattern) | F.col("qualified_name").contains(pattern)
    return ix.placed(ix.symbols.where(F.col("kind").isin(*FUNCTIONS) & match)).select("id", "name", "qualified_name", "file", "line").orderBy("qualified_name", "id").limit(limit)


def list_components(ix: CodeIndex, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Components, hooks, interfaces and aliases in that order."""
    kinds = ("component", "hook", "interface", "type_alias")
    order = F.when(F.col("kind") == kinds[0], 0).when(F.col("kind") == kinds[1], 1).when(F.col("kind") == kinds[2], 2).otherwise(3)
    rows = ix.symbols.where(F.col("kind").isin(*((kind,) if kind else kinds)))
    return ix.placed(rows).select(order.alias("o"), "id", "kind", "name", "file", "line").orderBy("o", "name", "id").limit(limit).drop("o")


def get_component_apis(ix: CodeIndex, component: str) -> DataFrame:
    """API calls of components whose name holds a text."""
    return ix.fact("component_api_calls").where(F.col("component").ilike(f"%{component}%")).select("component", "http_method", "api_path", "target_service", "repo", "line").orderBy("component", "api_path", "line")


def get_api_consumers(ix: CodeIndex, api_path: str, method: str | None = None) -> DataFrame:
    """Components that call an API path, in its general form."""
    wanted = ix.symbols.sparkSession.range(1).select(normalise_path(F.lit(api_path), template_slots=False)).first()[0]
    rows = ix.fact("component_api_calls").where(F.col("api_path").ilike(f"%{wanted}%"))
    rows = rows if method is None else rows.where(F.upper("http_method") == method.upper())
    return rows.select("component", "http_method", "api_path", "repo", "line").orderBy("component", "api_path", "line")


def list_repos(ix: CodeIndex) -> DataFrame:
    """Repositories, those indexed last first."""
    shown = F.coalesce(F.date_format("last_indexed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
    return ix.repositories.orderBy(F.desc_nulls_last("last_indexed_at"), "name").select("name", "path", shown.alias("indexed"), "last_commit")


def check_staleness(ix: CodeIndex, heads: dict[str, str]) -> DataFrame:
    """``(name, state)``: fresh, stale or unknown by the head commit of each checkout."""
    head = ix.repositories.sparkSession.createDataFrame(list(heads.items()) or [("", "")], "name string, head string")
    state = F.when(F.coalesce("head", F.lit("")) == "", "unknown").when(F.col("head").eqNullSafe(F.col("last_commit")), "fresh").otherwise("stale")
    return ix.repositories.join(head, "name", "left").select("name", state.alias("state"))


# --- processes and communities --------------------------------------------------


def entry_points(ix: CodeIndex) -> DataFrame:
    """``(repo, name, entry)``: HTTP handlers, topics consumed and main functions."""
    http = ix.fact("api_endpoints").where(F.coalesce("handler_name", F.lit("")) != "").select("repo", "file_id", last_segment("handler_name").alias("handler"), F.concat(F.lit("HTTP:"), F.concat_ws(" ", "method", "path")).alias("name"))
    funcs = ix.symbols.where(F.col("kind").isin(*FUNCTIONS)).select("file_id", F.col("name").alias("handler"), "qualified_name", "id")
    same = latest_per_key(funcs, ["file_id", "handler"], [F.asc("id")])
    handlers = http.join(same, ["file_id", "handler"], "left").select("repo", "name", F.coalesce("qualified_name", "handler").alias("entry"))
    topics = ix.fact("service_connections").where(F.col("conn_type") == "kafka_consume").select("repo", F.concat(F.lit("Kafka:"), "target").alias("name"), F.concat(F.lit("kafka:"), "target").alias("entry"))
    mains = ix.placed(ix.symbols.where((F.col("name") == "main") & (F.col("kind") == "func"))).select(F.col("repo_name").alias("repo"), F.concat(F.lit("Main:"), package_of("qualified_name")).alias("name"), F.col("qualified_name").alias("entry"))
    return handlers.unionByName(topics).unionByName(mains).where("entry is not null").distinct()


def detect_processes(ix: CodeIndex, depth: int = 15, steps: int = 100, more: dict[str, str] | None = None) -> DataFrame:
    """``(name, entry, step, symbol_name, depth)``: the functions each entry point reaches, nearest first.

    All entries are traced in one job, each until it has ``steps`` functions.  An
    entry that no function has is a process of one step.  ``more`` adds entry points
    of other kinds, by name.
    """
    found = entry_points(ix).select("name", "entry")
    if more:
        found = found.unionByName(found.sparkSession.createDataFrame(list(more.items()), "name string, entry string"))
    entries = cut_lineage(found)
    seen = reach(call_edges(ix).select("src", "dst"), entries.select(F.col("entry").alias("start")), "src", "dst", depth, carry_start=True, most=steps)
    order = Window.partitionBy("start").orderBy("depth", "node")
    numbered = seen.withColumn("step", F.row_number().over(order) - 1).where(F.col("step") <= steps)
    names = entries.groupBy("entry").agg(F.min("name").alias("name"))
    return numbered.join(names, F.col("start") == F.col("entry")).select("name", "entry", "step", F.col("node").alias("symbol_name"), "depth")


def list_processes(processes: DataFrame) -> DataFrame:
    """Processes with their number of steps."""
    return processes.groupBy("name", "entry").agg(F.count(F.lit(1)).alias("n_steps")).orderBy("name")


def get_process_flow(processes: DataFrame, name: str) -> DataFrame:
    """Steps of the process of that name, else of the first whose name holds the text."""
    best = processes.select("name").distinct().where(F.lower("name").contains(name.lower())).orderBy((F.col("name") != name).cast("int"), "name").limit(1)
    return processes.join(best, "name", "left_semi").orderBy("step")


def detect_communities(ix: CodeIndex) -> DataFrame:
    """``(repo_id, community, name, member_count, node)``: groups of functions that call each other.

    A community is named after the package most of its members have and, where
    there is one, the type most of its methods belong to; repeats get a number, and
    single functions are no community.
    """
    member = cut_lineage(communities(call_edges(ix), "repo_id", "src", "dst"))
    sizes = member.groupBy("repo_id", "community").agg(F.count(F.lit(1)).alias("member_count")).where("member_count > 1")
    key = ["repo_id", "community"]
    bare = F.when(F.col("node").contains("."), F.regexp_replace(package_of("node"), r"^\(?\*?", ""))
    packages = mode_per_group(member.withColumn("package", bare), key, "package").select(*key, "package")
    receivers = mode_per_group(member.withColumn("receiver", F.nullif(F.regexp_extract("node", r"\(\*?(\w+)\)", 1), F.lit(""))), key, "receiver").select(*key, "receiver")
    base = F.when(F.col("receiver").isNotNull() & ~F.col("receiver").eqNullSafe(F.col("package")), F.concat(F.coalesce("package", F.lit("")), F.lit("/"), "receiver")).otherwise(F.col("package"))
    names = packages.join(receivers, key, "full_outer").select(*key, base.alias("package"))
    nth = F.row_number().over(Window.partitionBy("repo_id", "package").orderBy("community"))
    labelled = sizes.join(names, ["repo_id", "community"], "left").withColumn("package", F.coalesce("package", F.concat(F.lit("cluster-"), "community"))).withColumn("n", nth)
    named = labelled.withColumn("name", F.when(F.col("n") > 1, F.concat("package", F.lit("-"), "n")).otherwise(F.col("package"))).select("repo_id", "community", "name", "member_count")
    return member.join(named, ["repo_id", "community"]).select("repo_id", "community", "name", "member_count", "node")


def list_communities(found: DataFrame, shown: int = 3) -> DataFrame:
    """Communities, large ones first, with the shortest member names."""
    names = F.slice(F.array_sort(F.collect_set(F.struct(F.length("node").alias("n"), F.col("node").alias("node")))), 1, shown)
    grouped = latest_members(found, shown).groupBy("repo_id", "community", "name", "member_count").agg(names.alias("m"))
    return grouped.select("repo_id", "community", "name", "member_count", F.transform("m", lambda e: F.element_at(F.split(e["node"], r"\."), -1)).alias("members")).orderBy(F.desc("member_count"), "repo_id", "community")


def latest_members(found: DataFrame, shown: int) -> DataFrame:
    """The members with the shortest names of each community."""
    order = Window.partitionBy("repo_id", "community").orderBy(F.length("node"), "node")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= shown).drop("n")


# --- graph, embeddings, prompts --------------------------------------------------


def build_graph(ix: CodeIndex) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, label, name)`` and edges ``(src, dst, rel, confidence)``; ids of functions and files hold the repository.

    Calls and implementations join functions that are there; packages, types,
    services, endpoints and components become vertices where something refers to
    them, so every edge has both ends.
    """
    key = lambda label, *parts: F.concat_ws(":", F.lit(label), *parts)
    vertex = lambda df, label, name, *parts: df.select(key(label.lower(), *parts).alias("id"), F.lit(label).alias("label"), name.alias("name"))
    placed = ix.placed(ix.symbols).where("qualified_name is not null and repo_name is not null")
    is_function = F.col("kind").isin(*FUNCTIONS)
    nodes = placed.select(key("symbol", "repo_name", "qualified_name").alias("id"), F.when(is_function, "Function").otherwise("Type").alias("label"), F.col("qualified_name").alias("name"), "file", "repo_name")
    functions = placed.where(is_function).select("repo_name", "qualified_name").distinct()
    files = ix.files.join(ix.repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name")), "repo_id")
    packaged = files.where(F.coalesce("module", F.lit("")) != "")
    imports, calls_api, links = ix.placed(ix.fact("imports")).where("repo_name is not null"), ix.fact("component_api_calls"), ix.fact("service_connections")
    general = normalise_path("path")
    repo = ix.repositories.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name"))
    calls = call_edges(ix).join(repo, "repo_id").join(functions.withColumnRenamed("qualified_name", "src"), ["repo_name", "src"], "left_semi")
    impls = ix.placed(ix.interface_impls).withColumn("qualified_name", F.concat_ws(".", "struct_name", "method_name")).join(functions, ["repo_name", "qualified_name"], "left_semi").where("interface_name is not null")
    flows = ix.fact("type_usages").withColumnRenamed("repo", "repo_name").join(functions.withColumnRenamed("qualified_name", "symbol_name"), ["repo_name", "symbol_name"], "left_semi")
    handlers = placed.where(is_function).select("file_id", F.col("name").alias("h"), "qualified_name", "repo_name").distinct()
    handled = ix.fact("api_endpoints").withColumn("h", last_segment("handler_name")).join(handlers, ["file_id", "h"])
    name = F.col
    vertices = nodes.select("id", "label", "name")
    for more in (
        vertex(files, "File", name("path"), "repo_name", "path"),
        vertex(packaged, "Package", name("module"), "module"),
        vertex(imports, "Package", name("import_path"), "import_path"),
        vertex(ix.fact("api_endpoints"), "Endpoint", general, general),
        vertex(calls_api, "Endpoint", name("api_path"), "api_path"),
        vertex(calls_api, "Component", name("component"), "repo", "component"),
        vertex(ix.repositories, "Service", name("name"), "name"),
        vertex(links, "Service", name("repo"), "repo"),
        vertex(links, "Service", name("target"), "target"),
        vertex(impls, "Type", name("interface_name"), "interface_name"),
        vertex(flows, "Type", name("type_name"), "type_name"),
    ):
        vertices = vertices.unionByName(more)
    edge = lambda df, src, dst, rel, confidence=F.lit(1.0): df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), confidence.cast("double").alias("confidence"))
    function = key("symbol", "repo_name", "qualified_name")
    edges = edge(calls, key("symbol", "repo_name", "src"), key("symbol", "repo_name", "dst"), "CALLS", name("confidence"))
    for more in (
        edge(nodes, key("file", "repo_name", "file"), name("id"), "DEFINES"),
        edge(packaged, key("package", "module"), key("file", "repo_name", "path"), "DEFINES"),
        edge(imports, key("file", "repo_name", "file"), key("package", "import_path"), "IMPORTS"),
        edge(calls_api, key("component", "repo", "component"), key("endpoint", "api_path"), "CALLS_API"),
        edge(links, key("service", "repo"), key("service", "target"), "CONNECTS"),
        edge(impls, function, key("type", "interface_name"), "IMPLEMENTS", name("confidence")),
        edge(flows.where("direction = 'input'"), key("symbol", "repo_name", "symbol_name"), key("type", "type_name"), "ACCEPTS"),
        edge(flows.where("direction = 'output'"), key("symbol", "repo_name", "symbol_name"), key("type", "type_name"), "RETURNS"),
        edge(handled, function, key("endpoint", general), "HANDLES"),
    ):
        edges = edges.unionByName(more)
    return vertices.dropDuplicates(["id"]), edges.groupBy("src", "dst", "rel").agg(F.max("confidence").alias("confidence"))


def graph_counters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, name, n)``: vertices per label and edges per relation."""
    part = lambda df, kind, column: df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("part"), "name", "n")
    return part(vertices, "vertex", "label").unionByName(part(edges, "edge", "rel"))


def dangling_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex; there should be none."""
    ids = vertices.select("id")
    ends = edges.select("rel", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(ids, "id", "left_anti").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def generate_embeddings(ix: CodeIndex, embedder: Embedder, force: bool = False, batch: int = 32) -> DataFrame:
    """``(symbol_id, embedding)`` of functions and interfaces without a vector (all with ``force``), in batches."""
    rows = ix.symbols.where(F.col("kind").isin(*EMBEDDED_KINDS))
    rows = rows if force else rows.where("embedded_at is null")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.concat_ws("\n", blank("qualified_name"), blank("signature"), F.concat(F.lit("// "), blank("doc_comment")), F.concat(F.lit("File: "), F.col("file")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), batch):
                piece = part.iloc[start : start + batch]
                yield pd.DataFrame({"symbol_id": piece["id"].to_numpy(), "embedding": [list(map(float, v)) for v in embedder(piece["text"].tolist())]})

    return ix.placed(rows).select("id", text.alias("text")).mapInPandas(run, "symbol_id long, embedding array<float>")


def embed_index(ix: CodeIndex, embedder: Embedder, now: Column | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Symbols and symbol_embeddings after embedding what has no vector: to be written in place of the old ones.

    Fresh vectors replace those of the same symbol, with the place the symbol has
    (line 0, module as service), and their symbols get ``embedded_at``.
    """
    now = F.current_timestamp() if now is None else now
    made = cut_lineage(generate_embeddings(ix, embedder, force))
    known = ix.symbols.join(made.select(F.col("symbol_id").alias("id")), "id", "left_semi")
    module = ix.files.select(F.col("id").alias("file_id"), F.coalesce("module", F.lit("")).alias("service"))
    place = ix.placed(known).join(module, "file_id", "left").select(F.col("id").alias("symbol_id"), "file", "kind", "name", "service", F.lit(0).alias("line"))
    at = now.cast(ix.symbols.schema["embedded_at"].dataType)
    rows = made.join(place, "symbol_id").withColumn("created_at", at)
    old = ix.symbol_embeddings
    vectors = rows if old is None else upsert(old, rows.select(*old.columns), ["symbol_id"])
    return set_flag(ix.symbols, made, "symbol_id", "embedded_at", at, "id"), vectors


def package_map(ix: CodeIndex, limit: int = 30) -> DataFrame:
    """Packages with the most symbols."""
    return ix.symbols.where("qualified_name like '%.%'").groupBy(package_of("qualified_name").alias("package")).agg(F.count(F.lit(1)).alias("n_symbols")).orderBy(F.desc("n_symbols"), "package").limit(limit)


def package_dependencies(ix: CodeIndex, limit: int = 20) -> DataFrame:
    """Pairs of different packages with the most calls between them."""
    pairs = ix.function_calls.select(package_of("caller_qualified_name").alias("caller"), F.nullif(F.trim("callee_package"), F.lit("")).alias("callee")).where("callee is not null and caller <> callee")
    return pairs.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n_calls")).orderBy(F.desc("n_calls"), "caller", "callee").limit(limit)
