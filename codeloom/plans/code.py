"""Registered queries on the code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import FRAMEWORK_FILES, FRAMEWORK_FOLDERS, extension, framework_hint, slashes
from codeloom.operators.division import covers
from codeloom.operators.graph import reach, weakest_link_paths
from codeloom.plans import catalog
from codeloom.plans.catalog import CodeIndex, call_edges
from codeloom.plans.indexing import interface_rows
from codeloom.session import cut_lineage, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What the parameterised questions are asked for.
SEARCH, SYMBOL, COMPONENT = "flush shipment", "Commit", "Panel"
ENTRY = "main.main"


def query(sql: str | None = None):
    """Registers a query under its function name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KINDS = "('func', 'method', 'hook', 'component')"
_EDGES = f"""t AS (SELECT DISTINCT f.repo_id, s.name, split_part(s.qualified_name, '.', 1) AS package, s.qualified_name AS dst FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.kind IN {_KINDS} AND s.qualified_name IS NOT NULL),
c AS (SELECT f.repo_id, x.caller_qualified_name AS src, trim(x.callee_name) AS name, coalesce(trim(x.callee_package), '') AS package, CAST(coalesce(x.confidence, 0.5) AS DOUBLE) AS confidence, x.line FROM function_calls x JOIN files f ON x.file_id = f.id),
e AS (SELECT c.repo_id, src, dst, confidence, line FROM c JOIN t ON c.repo_id = t.repo_id AND c.package = t.package AND c.name = t.name WHERE c.package <> ''
UNION ALL SELECT c.repo_id, src, dst, confidence, line FROM c JOIN t ON c.repo_id = t.repo_id AND c.name = t.name WHERE c.package = '')"""


@query(f"WITH {_EDGES} SELECT repo_id, src, dst, count(*) AS n_calls, round(max(confidence), 4) AS confidence FROM e GROUP BY ALL")
def code_call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls between functions of a repository."""
    return call_edges(CodeIndex.of(spark, d)).groupBy("repo_id", "src", "dst").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.max("confidence"), 4).alias("confidence"))


@query(
    f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src, dst FROM e), r(node, depth) AS (SELECT '{ENTRY}', 0 UNION SELECT s.dst, r.depth + 1 FROM r JOIN s ON r.node = s.src WHERE r.depth < 15)
SELECT node, min(depth) AS depth FROM r GROUP BY node"""
)
def code_trace_depth(spark: SparkSession, d: str) -> DataFrame:
    """Least number of calls from the entry function to each function it reaches."""
    starts = spark.createDataFrame([(ENTRY,)], "start string")
    return reach(call_edges(CodeIndex.of(spark, d)), starts, "src", "dst", 15)


@query(
    f"""WITH RECURSIVE {_EDGES}, b AS (SELECT DISTINCT src, dst, confidence AS w FROM e WHERE confidence >= 0.5),
r(node, depth, confidence) AS (SELECT DISTINCT qualified_name, 0, CAST(1 AS DOUBLE) FROM symbols WHERE kind IN {_KINDS} AND (name = '{SYMBOL}' OR contains(qualified_name, '{SYMBOL}')) UNION SELECT b.src, r.depth + 1, least(r.confidence, b.w) FROM r JOIN b ON r.node = b.dst WHERE r.depth < 5)
SELECT DISTINCT node, depth, round(confidence, 4) AS confidence FROM r WHERE depth > 0"""
)
def code_callers_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Callers within five steps with the weakest confidence on the way."""
    ix = CodeIndex.of(spark, d)
    found = weakest_link_paths(cut_lineage(call_edges(ix)), catalog._targets(ix, SYMBOL), "src", "dst", "confidence", 5, least=0.5)
    return found.select("node", "depth", F.round("confidence", 4).alias("confidence")).distinct()


_SIBLINGS = f"""b AS (SELECT DISTINCT src, dst, confidence AS w FROM e),
tg AS (SELECT DISTINCT qualified_name AS node FROM symbols WHERE kind IN {_KINDS} AND (name = '{SYMBOL}' OR contains(qualified_name, '{SYMBOL}'))),
im AS (SELECT DISTINCT interface_name, method_name, struct_name || '.' || method_name AS q FROM interface_impls WHERE struct_name IS NOT NULL AND method_name IS NOT NULL),
sb AS (SELECT DISTINCT im.q AS node FROM im JOIN (SELECT DISTINCT interface_name, method_name FROM im WHERE q IN (SELECT node FROM tg WHERE node IS NOT NULL)) o ON im.interface_name = o.interface_name AND im.method_name = o.method_name),
d(node, depth, confidence) AS (SELECT node, 0, CAST(1 AS DOUBLE) FROM tg UNION SELECT b.src, d.depth + 1, least(d.confidence, b.w) FROM d JOIN b ON d.node = b.dst WHERE d.depth < 5),
v(node, depth, confidence) AS (SELECT node, 0, CAST(1 AS DOUBLE) FROM sb UNION SELECT b.src, v.depth + 1, least(v.confidence, b.w) FROM v JOIN b ON v.node = b.dst WHERE v.depth < 5),
f AS (SELECT node AS caller, depth, round(max(confidence), 4) AS confidence FROM (SELECT * FROM d WHERE depth > 0 UNION ALL SELECT node, depth + 1, confidence FROM v WHERE depth > 0) GROUP BY node, depth)"""


@query(f"WITH RECURSIVE {_EDGES}, {_SIBLINGS} SELECT * FROM f ORDER BY confidence DESC, depth, caller LIMIT 50")
def code_find_callers(spark: SparkSession, d: str) -> DataFrame:
    """Callers of a function, those through interfaces included."""
    return catalog.find_callers(CodeIndex.of(spark, d), SYMBOL)


@query(f"WITH RECURSIVE {_EDGES}, {_SIBLINGS} SELECT * FROM f")
def code_impact_callers(spark: SparkSession, d: str) -> DataFrame:
    """All callers that a change of a function touches."""
    return catalog.impact_callers(CodeIndex.of(spark, d), SYMBOL)


@query(f"WITH RECURSIVE {_EDGES}, {_SIBLINGS} SELECT node AS target FROM sb")
def code_interface_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Methods that share an interface method with a function."""
    ix = CodeIndex.of(spark, d)
    return catalog.siblings(ix, catalog._targets(ix, SYMBOL))


@query()
def code_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a change of a function touches."""
    return catalog.analyze_impact(CodeIndex.of(spark, d), SYMBOL)


_WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(replace(concat_ws(' ', name, qualified_name, signature, doc_comment), '_', ' '), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[\p{L}\p{N}]+')"


def _bm25_sql(words: str) -> str:
    """CTEs that end in ``s (id, score)``: symbols that hold all words."""
    terms = sorted(words.lower().split())
    return f"""w AS (SELECT id, {_WORDS} AS t FROM symbols),
c AS (SELECT id, len(t) AS n, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))} FROM w),
g AS (SELECT count(*) AS n, avg(n) AS mean, {", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))} FROM c),
s AS (SELECT id, round({" + ".join(f"ln(1 + (g.n - d{i} + 0.5) / (d{i} + 0.5)) * CAST(f{i} AS DOUBLE) * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * c.n / mean))" for i in range(len(terms)))}, 6) AS score
 FROM c, g WHERE {" AND ".join(f"f{i} > 0" for i in range(len(terms)))})"""




def _placed_sql(rows: str) -> str:
    """Rows with file_id and line, with their file, repository and the code at their place."""
    net = "(len(replace({0}, '}}', '')) - len(replace({0}, '{{', '')))"
    window = "array_to_string(list_slice(ls, line, line + k - 1), chr(10))"
    return f"""SELECT x.*, f.path AS file, r.name AS repo_name, CASE WHEN line >= 1 AND line <= len(ls) THEN
 array_to_string(list_transform(list_slice(ls, greatest(line - 1, 1), least(greatest(line - 1, 1) + 11, coalesce(line + stop - 1, len(ls)))), lambda t: '  ' || t || chr(10)), '') ||
 CASE WHEN stop IS NULL AND greatest(line - 1, 1) + 11 < len(ls) AND contains(whole, '{{') AND {net.format("whole")} > 0 THEN '  ...' || chr(10) ELSE '' END END AS snippet
FROM (SELECT *, array_to_string(list_slice(ls, line, line + 11), chr(10)) AS whole,
  list_filter(range(1, 13), lambda k: line + k - 1 <= len(ls) AND contains({window}, '{{') AND {net.format(window)} <= 0)[1] AS stop
  FROM (SELECT p.*, string_split_regex(content, '\\r?\\n') AS ls FROM ({rows}) p LEFT JOIN source_file USING (file_id))) x
LEFT JOIN files f ON x.file_id = f.id LEFT JOIN repositories r ON f.repo_id = r.id"""


_FOUND = "SELECT id, score, kind, name, qualified_name, signature, CASE WHEN length(doc_comment) > 100 THEN left(doc_comment, 100) || '...' ELSE doc_comment END AS doc, file, line, repo_name, snippet FROM ({placed})"
_ASKED = f"CAST([{', '.join(map(repr, catalog.hashing_embedder()([SEARCH])[0]))}] AS DOUBLE[])"
_NEAR = f"""SELECT symbol_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_ASKED}), 6) AS score
FROM (SELECT * FROM (SELECT DISTINCT ON (symbol_id) symbol_id, embedding FROM symbol_embeddings ORDER BY symbol_id, created_at DESC)
 WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


@query(f"WITH {_bm25_sql(SEARCH)} " + _FOUND.format(placed=_placed_sql(rows="SELECT symbols.*, score FROM symbols JOIN (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) USING (id)")))
def code_search_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Symbols for search words."""
    return catalog.search_code(CodeIndex.of(spark, d), SEARCH, mode="keyword")


@query(
    f"""WITH {_bm25_sql(SEARCH)}, k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 40),
n AS ({_NEAR}), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM n QUALIFY rank <= 40),
u AS (SELECT id, round(coalesce(CAST(1 AS DOUBLE) / (60 + k.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + v.rank), 0), 8) AS score FROM k FULL JOIN v USING (id) ORDER BY score DESC, id LIMIT 20)
"""
    + _FOUND.format(placed=_placed_sql(rows="SELECT symbols.*, score FROM symbols JOIN u USING (id)"))
)
def code_search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Symbols for search words, by words and vectors fused."""
    return catalog.search_code(CodeIndex.of(spark, d), SEARCH)


@query(
    f"""WITH {_bm25_sql(SYMBOL)}, m AS (SELECT id, min(m) AS match FROM (SELECT id, 0 AS m FROM symbols WHERE lower(name) = '{SYMBOL.lower()}' UNION ALL (SELECT id, 1 FROM s ORDER BY score DESC, id LIMIT 10)) GROUP BY id ORDER BY match, id LIMIT 10)
SELECT match, id, kind, name, qualified_name, signature, receiver, file, line, doc_comment, snippet FROM ({_placed_sql(rows="SELECT symbols.*, match FROM symbols JOIN m USING (id)")})"""
)
def code_find_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by name, exact ones first."""
    return catalog.find_symbol(CodeIndex.of(spark, d), SYMBOL)


@query(f"SELECT token, count(*) AS n_symbols, CAST(sum(n) AS BIGINT) AS n_uses FROM (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({_WORDS}) AS token FROM symbols) GROUP BY ALL) GROUP BY token")
def code_word_index(spark: SparkSession, d: str) -> DataFrame:
    """Words of the symbols' search index with the symbols that hold them."""
    return catalog.build_word_index(CodeIndex.of(spark, d))[0].groupBy("token").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("n_uses"))


@query(
    f"""WITH {_bm25_sql(SYMBOL)} SELECT '{SYMBOL}' AS asked, id, kind, qualified_name, line FROM (SELECT DISTINCT ON (qualified_name, line) id, kind, qualified_name, line, rank FROM symbols
JOIN (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 30) USING (id) ORDER BY qualified_name, line, rank, id)"""
)
def code_callers_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Symbols found by a name's words where there is no call graph, each place once."""
    return catalog.find_callers_by_text(CodeIndex.of(spark, d), SYMBOL)


@query("SELECT s.kind, s.name, s.qualified_name, s.signature, s.line FROM symbols s JOIN files f ON s.file_id = f.id WHERE f.path = (SELECT min(path) FROM files JOIN symbols ON files.id = symbols.file_id)")
def code_file_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of one file, in order: the first path that has any."""
    ix = CodeIndex.of(spark, d)
    path = ix.files.join(ix.symbols.select(F.col("file_id").alias("id")), "id", "left_semi").agg(F.min("path")).first()[0]
    return catalog.get_file_symbols(ix, path or "")


@query("SELECT name, CASE WHEN name NOT LIKE 'a%' AND name NOT LIKE 'm%' THEN 'unknown' WHEN last_commit IS NOT NULL AND name LIKE 'a%' THEN 'fresh' ELSE 'stale' END AS state FROM repositories")
def code_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Whether each repository is indexed at its head: those with a are, those with m have moved on, others are unknown."""
    ix = CodeIndex.of(spark, d)
    heads = {r["name"]: r["last_commit"] or "0" if r["name"][0] == "a" else "moved" for r in ix.repositories.collect() if r["name"][0] in "am"}
    return catalog.check_staleness(ix, heads)


@query()
def code_service_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Packages that the files of one repository import."""
    ix = CodeIndex.of(spark, d)
    return catalog.get_service_dependencies(ix, ix.repositories.agg(F.min("name")).first()[0] or "")


@query()
def code_implementations(spark: SparkSession, d: str) -> DataFrame:
    """Types that have all methods of an interface of their repository, as the texts say."""
    return interface_rows(CodeIndex.of(spark, d).nested())


@query("SELECT name, path, coalesce(strftime(last_indexed_at, '%Y-%m-%d %H:%M:%S'), 'never') AS indexed, last_commit FROM repositories")
def code_list_repos(spark: SparkSession, d: str) -> DataFrame:
    """Repositories, those indexed last first."""
    return catalog.list_repos(CodeIndex.of(spark, d))


@query("SELECT DISTINCT module AS service FROM files WHERE coalesce(module, '') <> ''")
def code_list_services(spark: SparkSession, d: str) -> DataFrame:
    """Modules of the files."""
    return catalog.list_services(CodeIndex.of(spark, d))


@query("SELECT s.id, kind, name, f.path AS file, line FROM symbols s LEFT JOIN files f ON s.file_id = f.id WHERE kind IN ('component', 'hook', 'interface', 'type_alias') ORDER BY CASE kind WHEN 'component' THEN 0 WHEN 'hook' THEN 1 WHEN 'interface' THEN 2 ELSE 3 END, name, s.id LIMIT 100")
def code_list_components(spark: SparkSession, d: str) -> DataFrame:
    """Components, hooks and interfaces in that order."""
    return catalog.list_components(CodeIndex.of(spark, d))


@query(f"SELECT s.id, name, qualified_name, f.path AS file, line FROM symbols s LEFT JOIN files f ON s.file_id = f.id WHERE kind IN {_KINDS} AND (contains(name, '{COMPONENT}') OR contains(qualified_name, '{COMPONENT}')) ORDER BY qualified_name, s.id LIMIT 20")
def code_api_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose name holds a text."""
    return catalog.get_api_handlers(CodeIndex.of(spark, d), COMPONENT)


@query("SELECT split_part(qualified_name, '.', 1) AS package, count(*) AS n_symbols FROM symbols WHERE qualified_name LIKE '%.%' GROUP BY 1 ORDER BY n_symbols DESC, package LIMIT 30")
def code_package_map(spark: SparkSession, d: str) -> DataFrame:
    """Packages with the most symbols."""
    return catalog.package_map(CodeIndex.of(spark, d))


@query("WITH p AS (SELECT split_part(caller_qualified_name, '.', 1) AS a, nullif(trim(callee_package), '') AS b FROM function_calls) SELECT a AS caller, b AS callee, count(*) AS n_calls FROM p WHERE b IS NOT NULL AND a <> b GROUP BY a, b ORDER BY n_calls DESC, a, b LIMIT 20")
def code_package_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of packages with the most calls."""
    return catalog.package_dependencies(CodeIndex.of(spark, d))


@query("SELECT regexp_extract(lower(path), '(\\.[^./\\\\]+)$', 1) AS ext, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM source_file GROUP BY 1")
def code_files_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Files and characters per extension."""
    return table(spark, d, "source_file").groupBy(extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


@query("""
WITH r AS (SELECT DISTINCT interface_name AS need, method_name AS item FROM interface_impls WHERE method_name IS NOT NULL), h AS (SELECT DISTINCT struct_name AS owner, method_name AS item FROM interface_impls WHERE method_name IS NOT NULL)
SELECT m.need, m.owner FROM (SELECT need, owner, count(*) AS n FROM r JOIN h USING (item) GROUP BY need, owner) m JOIN (SELECT need, count(*) AS size FROM r GROUP BY need) z ON m.need = z.need AND m.n = z.size""")
def code_full_implementations(spark: SparkSession, d: str) -> DataFrame:
    """Structs that have every method an interface asks for."""
    impls = table(spark, d, "interface_impls")
    return covers(impls.select(F.col("interface_name").alias("need"), F.col("method_name").alias("item")), impls.select(F.col("struct_name").alias("owner"), F.col("method_name").alias("item")), "need", "item", "owner")


_FOLDER = r"regexp_extract(p, '([^/]+)/[^/]*$', 1)"
_HINT = "CASE " + " ".join(
    [f"WHEN ext = '{e}' AND base = '{w}' THEN {('[' + repr(h[0]) + ', ' + repr(str(h[1])) + ']') if h else 'NULL'}" for e, t in FRAMEWORK_FILES.items() for w, h in t.items()]
    + [f"WHEN ext = '{e}' AND folder = '{w}' THEN ['{h[0]}', '{h[1]}']" for e, t in FRAMEWORK_FOLDERS.items() for w, h in t.items()]
) + " END"


@query(
    rf"""WITH a AS (SELECT regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS p FROM source_file), b AS (SELECT split_part(p, '/', -1) AS base, {_FOLDER} AS folder, lower(regexp_extract(p, '\.([^./]+)$', 1)) AS ext FROM a),
h AS (SELECT {_HINT} AS h FROM b) SELECT h[1] AS framework, CAST(h[2] AS DOUBLE) AS multiplier, count(*) AS n_files FROM h WHERE h IS NOT NULL GROUP BY ALL"""
)
def code_framework_hints(spark: SparkSession, d: str) -> DataFrame:
    """Files per framework their names hint at."""
    hints = table(spark, d, "source_file").select(framework_hint("path").alias("h")).where("h is not null")
    return hints.groupBy(F.col("h.framework").alias("framework"), F.col("h.multiplier").alias("multiplier")).agg(F.count(F.lit(1)).alias("n_files"))


@query("SELECT f.path AS path, count(*) AS n_symbols FROM symbols s JOIN files f ON s.file_id = f.id WHERE f.deleted_at IS NULL GROUP BY 1")
def code_symbols_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each file that is still there."""
    files = table(spark, d, "files").where("deleted_at is null").select(F.col("id").alias("file_id"), "path")
    return table(spark, d, "symbols").join(files, "file_id").groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))


@query()
def code_extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols read from the texts, per language and kind."""
    ix = CodeIndex.of(spark, d)
    by_file = ix.fact("symbols").join(ix.sources.select("file_id", extension(slashes("path")).alias("ext")), "file_id")
    return by_file.groupBy("ext", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def code_extracted_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls read from the texts, per confidence."""
    return CodeIndex.of(spark, d).fact("function_calls").groupBy("repo", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query()
def code_component_apis(spark: SparkSession, d: str) -> DataFrame:
    """API calls of components."""
    return catalog.get_component_apis(CodeIndex.of(spark, d), COMPONENT)


@query()
def code_api_consumers(spark: SparkSession, d: str) -> DataFrame:
    """Components that call a path."""
    return catalog.get_api_consumers(CodeIndex.of(spark, d), "/api/opal/:id", "GET")


@query()
def code_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints of all repositories, each once."""
    return catalog.list_api_endpoints(CodeIndex.of(spark, d))


@query()
def code_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Packages each repository imports."""
    return CodeIndex.of(spark, d).fact("imports").groupBy("repo", "import_path").agg(F.count(F.lit(1)).alias("n_files"))


@query()
def code_type_flow(spark: SparkSession, d: str) -> DataFrame:
    """Producers and consumers of a type, and chains between them."""
    return catalog.trace_type_flow(CodeIndex.of(spark, d), "error")


_MORE = {"Main:main": "main.main", "Start:registry": "registry.RegisterAll"}
_PROCESSES = f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src, dst FROM e WHERE src IS NOT NULL),
en AS (SELECT DISTINCT name, entry FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _MORE.items())}) x(name, entry) UNION
 SELECT 'Main:' || split_part(qualified_name, '.', 1), qualified_name FROM symbols WHERE name = 'main' AND kind = 'func' AND qualified_name IS NOT NULL),
r(start, node, depth) AS (SELECT entry, entry, 0 FROM en UNION SELECT r.start, s.dst, r.depth + 1 FROM r JOIN s ON r.node = s.src WHERE r.depth < 15),
m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node),
p AS (SELECT name, start AS entry, CAST(row_number() OVER (PARTITION BY start ORDER BY depth, node) - 1 AS INT) AS step, node AS symbol_name, depth FROM m JOIN (SELECT entry, min(name) AS name FROM en GROUP BY entry) n ON m.start = n.entry QUALIFY step <= 100)"""


def _processes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.detect_processes(CodeIndex.of(spark, d), more=_MORE)


@query()
def code_processes(spark: SparkSession, d: str) -> DataFrame:
    """Functions each entry point reaches, in order: HTTP, topics and main functions, and two named here."""
    return _processes(spark, d)


@query(f"{_PROCESSES} SELECT * FROM p WHERE name = 'Start:registry'")
def code_process_flow(spark: SparkSession, d: str) -> DataFrame:
    """Steps of one process."""
    return catalog.get_process_flow(_processes(spark, d), "start:REG")


@query()
def code_process_list(spark: SparkSession, d: str) -> DataFrame:
    """Processes with their number of steps."""
    return catalog.list_processes(_processes(spark, d))


@query()
def code_communities(spark: SparkSession, d: str) -> DataFrame:
    """Groups of functions that call each other."""
    return catalog.detect_communities(CodeIndex.of(spark, d))


@query()
def code_community_list(spark: SparkSession, d: str) -> DataFrame:
    """Communities, large ones first."""
    return catalog.list_communities(catalog.detect_communities(CodeIndex.of(spark, d)))


@query()
def code_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and edges of the property graph per kind."""
    return catalog.graph_counters(*catalog.build_graph(CodeIndex.of(spark, d)))


@query("SELECT '' AS rel, CAST(0 AS BIGINT) AS n WHERE false")
def code_graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the property graph that lack a vertex: none."""
    return catalog.dangling_edges(*catalog.build_graph(CodeIndex.of(spark, d)))


@query(f"""WITH fn AS (SELECT DISTINCT r.name AS repo, qualified_name FROM symbols s JOIN files f ON s.file_id = f.id JOIN repositories r ON f.repo_id = r.id WHERE s.kind IN {_KINDS} AND qualified_name IS NOT NULL)
SELECT fn.repo, i.struct_name || '.' || i.method_name AS method, i.interface_name, round(max(CAST(i.confidence AS DOUBLE)), 4) AS confidence FROM interface_impls i JOIN files f ON i.file_id = f.id JOIN repositories r ON f.repo_id = r.id
JOIN fn ON fn.repo = r.name AND fn.qualified_name = i.struct_name || '.' || i.method_name WHERE i.interface_name IS NOT NULL GROUP BY ALL""")
def code_graph_implements(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the property graph from methods to the interfaces they implement."""
    edges = catalog.build_graph(CodeIndex.of(spark, d))[1].where("rel = 'IMPLEMENTS'")
    part = F.split("src", ":", 3)
    return edges.select(part[1].alias("repo"), part[2].alias("method"), F.split("dst", ":", 2)[1].alias("interface_name"), F.round("confidence", 4).alias("confidence"))


@query()
def code_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the symbols that have none yet, by the stand-in embedder."""
    return catalog.generate_embeddings(CodeIndex.of(spark, d), catalog.hashing_embedder())
