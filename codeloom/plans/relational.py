"""Operator queries on relational tables, each with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import normalise_path
from codeloom.functions.text import bm25, match_all, tokens
from codeloom.operators.cdc import cascade_delete, snapshot_diff, unchanged_skipped, upsert_latest
from codeloom.operators.coverage import detect_symbols, roll_up
from codeloom.operators.division import covers
from codeloom.operators.graph import degrees, modularity, two_hops, undirected
from codeloom.operators.rank import cosine, latest_per_key, mode_per_group, reciprocal_rank_fusion, top_k
from codeloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_TERMS = ("index", "parser", "service")
_BM25 = rf"""
d AS (SELECT doc_id, {_TOK} AS t FROM documents),
c AS (SELECT doc_id, len(t) AS n, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS))} FROM d),
g AS (SELECT count(*) AS n, avg(n) AS mean, {", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(3))} FROM c),
s AS (SELECT doc_id, {" + ".join(f"ln(1 + (g.n - d{i} + 0.5) / (d{i} + 0.5)) * CAST(f{i} AS DOUBLE) * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * c.n / mean))" for i in range(3))} AS score,
  {" + ".join(f"CASE WHEN f{i} > 0 THEN 1 ELSE 0 END" for i in range(3))} AS held FROM c, g)"""
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"


@query(rf"SELECT doc_id FROM documents WHERE list_has_all({_TOK}, ['parser', 'enabled', 'listed'])")
def keyword_match_all(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold every search word."""
    return match_all(table(spark, d, "documents"), "text", ["parser", "enabled", "listed"]).select("doc_id")


@query(f"WITH {_BM25} SELECT doc_id, round(score, 4) AS score FROM s WHERE held >= 2 ORDER BY round(score, 4) DESC, doc_id LIMIT 20")
def keyword_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 documents that fit two of three search words best."""
    ranked = bm25(table(spark, d, "documents"), "doc_id", "text", _TERMS, least=2).select("doc_id", F.round("score", 4).alias("score"))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(20)


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    vector = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(cosine(F.col("embedding"), vector), 4).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 4) AS score FROM embeddings e ORDER BY 2 DESC, 1 LIMIT 20")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 vectors nearest to one query vector."""
    return _scored(spark, d).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"SELECT vec_id, round({_COS}, 4) AS score FROM embeddings e WHERE label IN (1, 3) ORDER BY 2 DESC, 1 LIMIT 20")
def semantic_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors among rows that a metadata filter lets through."""
    return _scored(spark, d).where(F.col("label").isin(1, 3)).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(20)


@query(
    f"""WITH {_BM25}, k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 4) DESC, doc_id) AS rank FROM s WHERE held >= 2 QUALIFY rank <= 40),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({_COS}, 4) DESC, vec_id) AS rank FROM embeddings e QUALIFY rank <= 40)
SELECT id, round(coalesce(CAST(1 AS DOUBLE) / (60 + k.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + v.rank), 0), 8) AS score
FROM k FULL JOIN v USING (id) ORDER BY score DESC, id LIMIT 20"""
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and vector result lists fused by reciprocal rank."""
    words = bm25(table(spark, d, "documents"), "doc_id", "text", _TERMS, least=2).select(F.col("doc_id").alias("id"), F.round("score", 4).alias("s"))
    vectors = _scored(spark, d).select(F.col("vec_id").alias("id"), F.col("score").alias("s"))
    legs = [top_k(leg, 40, F.desc("s"), F.asc("id")) for leg in (words, vectors)]
    return reciprocal_rank_fusion(legs, "id", 20)


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC NULLS LAST, o_orderkey DESC")
def latest_order_per_customer(spark: SparkSession, d: str) -> DataFrame:
    """Latest order of each customer."""
    order = [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]
    return latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], order)


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, ts FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def distinct_on_events(spark: SparkSession, d: str) -> DataFrame:
    """Latest event per user and type."""
    return latest_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.desc("event_id")])


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%'")
def ilike_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names that contain a text, whatever the case."""
    return table(spark, d, "part").where(F.col("p_name").ilike("%an%")).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE 'supplier%1'")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names with a given beginning."""
    return table(spark, d, "supplier").where(F.col("s_name").ilike("supplier%1")).select("s_suppkey", "s_name")


@query("SELECT id, path FROM files WHERE path LIKE 'services/%/%store%'")
def like_template(spark: SparkSession, d: str) -> DataFrame:
    """Paths that fit a template in which a slot stands for anything."""
    pattern = "services/{service}/{any}store{any}".replace("{service}", "%").replace("{any}", "%")
    return table(spark, d, "files").where(F.col("path").like(pattern)).select("id", "path")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) ORDER BY n_name, n_nationkey LIMIT 8")
def in_list_topn(spark: SparkSession, d: str) -> DataFrame:
    """First rows by name among listed keys."""
    return table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name").orderBy("n_name", "n_nationkey").limit(8)


@query("SELECT r_name, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_join_chain(spark: SparkSession, d: str) -> DataFrame:
    """Customers per nation and region."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counted = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    return counted.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "n_customers")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def scalar_count_per_parent(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer, 0 included: aggregated before the join."""
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1997-01-01')")
def left_join_missing(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order of late."""
    urgent = table(spark, d, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") > F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")))
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 30")
def group_count_topn(spark: SparkSession, d: str) -> DataFrame:
    """The 30 suppliers with the most lines."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(30)


@query(
    "SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
    "GROUP BY ALL HAVING c_nationkey <> s_nationkey ORDER BY n DESC, c_nationkey, s_nationkey LIMIT 20"
)
def pair_count_having(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent pairs of unequal groups."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("k"))
    buyers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    pairs = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey")
    return pairs.groupBy("c_nationkey", "s_nationkey").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "c_nationkey", "s_nationkey").limit(20)


@query("SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM files GROUP BY 1")
def first_segment_count(spark: SparkSession, d: str) -> DataFrame:
    """Files per first path segment."""
    return table(spark, d, "files").groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type) SELECT DISTINCT ON (user_id) user_id, event_type, n FROM c ORDER BY user_id, n DESC, event_type")
def event_mode_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent event type of each user."""
    return mode_per_group(table(spark, d, "events"), ["user_id"], "event_type")


@query(
    "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'implemented' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'missing' ELSE 'partial' END AS status FROM orders GROUP BY o_custkey"
)
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Status of a whole from those of its parts: all, none or some are done."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    status = F.when(done == F.count(F.lit(1)), "implemented").when(done == 0, "missing").otherwise("partial")
    return table(spark, d, "orders").groupBy("o_custkey").agg(status.alias("status"))


@query("SELECT o_orderpriority, round(100.0 * avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS percent FROM orders GROUP BY 1")
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    """Share of done parts in percent."""
    done = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(done) * 100, 4).alias("percent"))


@query("SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('error', 'purchase') ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, length(props), event_id LIMIT 100")
def ordered_kind_listing(spark: SparkSession, d: str) -> DataFrame:
    """Kinds in a fixed order, then short before long."""
    kind = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "event_type", kind.alias("k"), F.length("props").alias("n")).orderBy("k", "n", "event_id").limit(100).drop("k", "n")


@query(
    """WITH req AS (SELECT DISTINCT n_regionkey AS need, n_nationkey AS item FROM nation), have AS (SELECT DISTINCT l_partkey AS owner, s_nationkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT m.need, m.owner FROM (SELECT need, owner, count(*) AS n FROM req JOIN have USING (item) GROUP BY need, owner) m JOIN (SELECT need, count(*) AS size FROM req GROUP BY need) z ON m.need = z.need AND m.n = z.size"""
)
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    """Parts that are supplied from every nation of a region."""
    required = table(spark, d, "nation").select(F.col("n_regionkey").alias("need"), F.col("n_nationkey").alias("item"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return covers(required, lines.select(F.col("l_partkey").alias("owner"), F.col("s_nationkey").alias("item")), "need", "item", "owner")


@query(
    "SELECT DISTINCT a.n_nationkey AS nation_a, b.n_nationkey AS nation_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"
)
def two_hop_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes with a common neighbour."""
    nation = table(spark, d, "nation")
    return two_hops(
        nation.select(F.col("n_nationkey").alias("nation_a"), F.col("n_regionkey").alias("via")), nation.select(F.col("n_regionkey").alias("via"), F.col("n_nationkey").alias("nation_b")), "nation_a", "via", "nation_b"
    )


_NATION_PAIRS = "e AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), g AS (SELECT node, sum(w) AS degree FROM (SELECT u AS node, w FROM e UNION ALL SELECT v, w FROM e) GROUP BY node)"


def _nation_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("k"))
    buyers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return undirected(lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")), "c_nationkey", "s_nationkey", F.col("k").cast("double"))


@query(f"WITH {_NATION_PAIRS} SELECT node, degree FROM g")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Weighted degree of each node of an undirected graph."""
    return degrees(_nation_pairs(spark, d))


@query(
    f"""WITH {_NATION_PAIRS}, x AS (SELECT e.w, a.degree AS du, b.degree AS dv, na.n_regionkey = nb.n_regionkey AS same FROM e JOIN g a ON e.u = a.node JOIN g b ON e.v = b.node JOIN nation na ON e.u = na.n_nationkey JOIN nation nb ON e.v = nb.n_nationkey)
SELECT round((sum(w) FILTER (same) - sum(du * dv) FILTER (same) / (2 * sum(w))) / sum(w), 6) AS modularity FROM x"""
)
def modularity_score(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of a given partition of a graph."""
    return modularity(_nation_pairs(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community")))


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id < d.doc_id AND s.text IS NOT DISTINCT FROM d.text)")
def content_hash_first(spark: SparkSession, d: str) -> DataFrame:
    """First document of each content, by hash."""
    hashed = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("text").isNull().alias("isnull"))
    return latest_per_key(hashed, ["hash", "isnull"], [F.asc("doc_id")]).drop("isnull")


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored state (the older scan of a path) and present state of each scanned path."""
    files = table(spark, d, "files").select("id", "repo_id", "path", "hash", "last_scanned", "deleted_at")
    new = latest_per_key(files, ["repo_id", "path"], [F.desc_nulls_last("last_scanned"), F.desc("id")])
    old = latest_per_key(files, ["repo_id", "path"], [F.asc_nulls_first("last_scanned"), F.asc("id")])
    return old, new


_SCANS = """o AS (SELECT DISTINCT ON (repo_id, path) * FROM files ORDER BY repo_id, path, last_scanned ASC NULLS FIRST, id),
n AS (SELECT * FROM (SELECT DISTINCT ON (repo_id, path) * FROM files ORDER BY repo_id, path, last_scanned DESC NULLS LAST, id DESC) WHERE deleted_at IS NULL)"""


@query(
    f"WITH {_SCANS} SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.path = n.path"
)
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change of each file between its first scan and the present state."""
    old, new = _scans(spark, d)
    return snapshot_diff(old, new.where("deleted_at is null"), ["repo_id", "path"], "hash")


@query(f"WITH {_SCANS} SELECT id, repo_id, path FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo_id = n.repo_id AND o.path = n.path AND o.hash = n.hash)")
def content_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    """Files that a re-index must read, as their hash is not stored."""
    old, new = _scans(spark, d)
    return unchanged_skipped(new.where("deleted_at is null"), old, ["repo_id", "path"], "hash").select("id", "repo_id", "path")


@query("SELECT DISTINCT ON (repo_id, path) id, repo_id, path, hash FROM files ORDER BY repo_id, path, last_scanned DESC NULLS LAST, id DESC")
def upsert_latest_files(spark: SparkSession, d: str) -> DataFrame:
    """State of the files table after all scans were put in by key."""
    return upsert_latest(table(spark, d, "files").select("id", "repo_id", "path", "hash", "last_scanned"), ["repo_id", "path"], "last_scanned", "id").drop("last_scanned")


@query("SELECT s.id, s.file_id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = s.file_id AND f.deleted_at IS NOT NULL)")
def cascade_delete_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols left after those of deleted files are gone."""
    deleted = table(spark, d, "files").where("deleted_at is not null")
    return cascade_delete(table(spark, d, "symbols").select("id", "file_id"), deleted, "file_id", "id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 UNION SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Distinct union of two selections."""
    customer = table(spark, d, "customer")
    pick = lambda c: customer.where(c).select("c_custkey", "c_name")
    return pick("c_acctbal > 5000").union(pick("c_mktsegment = 'BUILDING'")).distinct()


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '#'))) AS INTEGER) AS n_headers FROM documents WHERE text IS NOT NULL")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines and headings of each text."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda x: x.startswith("#"))).alias("n_headers"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, line, sum(CASE WHEN regexp_matches(line, '^#{1,3} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, min(n) AS first_line FROM s WHERE section > 0 GROUP BY ALL"""
)
def header_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a text: lines numbered by the headings before them."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("n", F.col("at") + 1)
    head = F.when(F.col("line").rlike("^#{1,3} "), 1).otherwise(0)
    section = F.sum(head).over(Window.partitionBy("doc_id").orderBy("n"))
    return lines.withColumn("section", section).where("section > 0").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("n").cast("long").alias("first_line"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM events)
SELECT user_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(depth) AS BIGINT) AS lowest FROM e GROUP BY user_id"""
)
def running_scope_depth(spark: SparkSession, d: str) -> DataFrame:
    """Running depth of opening and closing marks."""
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "events").select("user_id", depth.alias("depth")).groupBy("user_id").agg(F.max("depth").alias("deepest"), F.min("depth").alias("lowest"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS sum_value FROM events GROUP BY 1")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a field of a JSON payload."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("sum_value"))


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def line_summary(spark: SparkSession, d: str) -> DataFrame:
    """Grouped sums under a pushed-down date filter."""
    line = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(rf"SELECT source, count(*) AS n_docs, CAST(sum(len({_TOK})) AS BIGINT) AS n_tokens FROM documents GROUP BY source")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    """Word tokens per source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(tokens("text"))).alias("n_tokens"))


@query(
    """WITH h AS (SELECT DISTINCT user_id, event_type FROM events), z AS (SELECT user_id, count(*) AS size FROM h GROUP BY user_id)
SELECT a.user_id AS need, b.user_id AS owner FROM h a JOIN h b ON a.event_type = b.event_type AND a.user_id <> b.user_id JOIN z ON a.user_id = z.user_id GROUP BY a.user_id, b.user_id, z.size HAVING count(*) = z.size"""
)
def cross_group_division(spark: SparkSession, d: str) -> DataFrame:
    """Users who had every type of event that another user had."""
    events = table(spark, d, "events").select("user_id", "event_type")
    return covers(events.withColumnRenamed("user_id", "need"), events.withColumnRenamed("user_id", "owner"), "need", "event_type", "owner").where("need <> owner")


@query(
    """SELECT s_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE s_nationkey = 7 GROUP BY s_suppkey"""
)
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    """What depends on each supplier of one nation: parts, then orders, then customers."""
    lines = table(spark, d, "supplier").where("s_nationkey = 7").select("s_suppkey").join(table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    orders = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    distinct = {"n_parts": "l_partkey", "n_orders": "o_orderkey", "n_customers": "o_custkey"}
    return orders.groupBy("s_suppkey").agg(*[F.countDistinct(c).alias(n) for n, c in distinct.items()])


@query(
    """WITH p AS (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT DISTINCT p_brand, o_custkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
SELECT p.p_brand, n_producers, n_consumers FROM (SELECT p_brand, count(*) AS n_producers FROM p GROUP BY p_brand) p JOIN (SELECT p_brand, count(*) AS n_consumers FROM c GROUP BY p_brand) c USING (p_brand)"""
)
def producer_consumer_flow(spark: SparkSession, d: str) -> DataFrame:
    """Per brand those who make it and those who take it."""
    moved = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    made = moved.select("p_brand", "l_suppkey").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_producers"))
    taken = moved.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return made.join(taken.select("p_brand", "o_custkey").distinct().groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_consumers")), "p_brand")


_VARIABLE = r"^[:$].+$|^\{.*\}$|^\d+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9a-fA-F]{32}$|\$\{"
_REQUEST = "CASE id % 4 WHEN 0 THEN '/api/' || path || '/' || id WHEN 1 THEN '/' || path || '/:id' WHEN 2 THEN '/apiary/${' || path || '}' ELSE '/api/v1/' || coalesce(module, 'x') || '/{' || id || '}' END"


@query(rf"SELECT id, array_to_string(list_transform(string_split(regexp_replace({_REQUEST}, '^/api/', '/'), '/'), lambda s: CASE WHEN regexp_matches(s, '{_VARIABLE}') THEN '{{id}}' ELSE s END), '/') AS general FROM files")
def path_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Request paths made of file paths, in their general form."""
    return table(spark, d, "files").select("id", normalise_path(F.expr(_REQUEST)).alias("general"))


@query(r"SELECT target, count(*) AS n_links, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1)) AS target FROM documents) GROUP BY target")
def regex_extract_links(spark: SparkSession, d: str) -> DataFrame:
    """Targets of the links in texts."""
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("target"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    """SELECT first_type, second_type, count(*) AS n, CAST(sum(epoch(ts2) - epoch(ts)) AS BIGINT) AS seconds FROM (
SELECT event_type AS first_type, ts, lead(event_type) OVER w AS second_type, lead(ts) OVER w AS ts2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE second_type IS NOT NULL GROUP BY ALL"""
)
def conversation_turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one user's neighbouring events and the time between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    pairs = table(spark, d, "events").select(F.col("event_type").alias("first_type"), "ts", F.lead("event_type").over(order).alias("second_type"), F.lead("ts").over(order).alias("ts2"))
    return pairs.where("second_type is not null").groupBy("first_type", "second_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds("ts2") - seconds("ts"))).cast("long").alias("seconds"))


@query(
    r"""WITH f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '`(?:\w+\.)?(\w+)`', 1))) AS name FROM documents), k AS (SELECT DISTINCT lower(name) AS k FROM symbols WHERE name IS NOT NULL),
s AS (SELECT doc_id, count(*) AS total, count(k) AS done FROM f LEFT JOIN k ON lower(f.name) = k GROUP BY doc_id)
SELECT CASE WHEN done = total THEN 'implemented' WHEN done = 0 THEN 'missing' ELSE 'partial' END AS status, count(*) AS n_docs, CAST(sum(done) AS BIGINT) AS n_found, CAST(sum(total) AS BIGINT) AS n_named FROM s GROUP BY 1"""
)
def spec_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How far the functions that texts name in code marks are there."""
    named = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`(?:\w+\.)?(\w+)`"), F.lit(1)))).alias("name"))
    detected = detect_symbols(named, table(spark, d, "symbols").where("name is not null"), "name")
    counted = detected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("implemented").alias("done"))
    return counted.groupBy(roll_up(F.col("done"), F.col("total")).alias("status")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("done").alias("n_found"), F.sum("total").alias("n_named"))
