"""How much of a specification is implemented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import normalise_path

ENDPOINT, METHOD, FRONTEND = 0.9, 0.8, 0.3


def roll_up(done: Column, total: Column) -> Column:
    """Status of a whole: implemented if all parts are (or there are none), missing if none is, else partial."""
    return F.when(done == total, "implemented").when(done == 0, "missing").otherwise("partial")


def detect_endpoints(components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Components of kind api with ``implemented`` and ``confidence``; a slot of a path fits any segment."""
    general = lambda c: F.lower(F.regexp_replace(normalise_path(F.col(c)), r"\{[^}]*\}", "{id}"))
    known = endpoints.select(F.upper("method").alias("m"), general("path").alias("p")).distinct().withColumn("hit", F.lit(True))
    wanted = components.withColumn("m", F.upper("method")).withColumn("p", general("path"))
    exact = wanted.join(known, ["m", "p"], "left").drop("m", "p")
    return exact.withColumn("implemented", F.coalesce("hit", F.lit(False))).withColumn("confidence", F.when(F.col("hit"), ENDPOINT).otherwise(0.0)).drop("hit")


def detect_symbols(components: DataFrame, symbols: DataFrame, name: str, confidence: float = METHOD) -> DataFrame:
    """Components that name a function, with ``implemented`` and ``confidence``."""
    known = symbols.select(F.lower("name").alias("k")).distinct().withColumn("hit", F.lit(True))
    joined = components.withColumn("k", F.lower(name)).join(known, "k", "left").drop("k")
    return joined.withColumn("implemented", F.coalesce("hit", F.lit(False))).withColumn("confidence", F.when(F.col("hit"), confidence).otherwise(0.0)).drop("hit")


def detect_components(components: DataFrame, endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """Components ``(…, kind, identifier)`` with ``implemented``, ``confidence`` and ``evidence``, by the rule of their kind.

    api_endpoint: ``VERB /path`` among the endpoints, a slot in braces fitting any
    text; service_method: the part after the first dot among the methods, whatever
    the case; ui_screen and api_call: front-end parts cannot be told from the index
    and count as missing at low confidence; anything else is missing.  Evidence
    lists at most five finds.
    """
    key = "__component"
    own = components.withColumn(key, F.monotonically_increasing_id())
    api = own.where("kind = 'api_endpoint' and identifier like '% %'").select(key, F.upper(F.split("identifier", " ", 2)[0]).alias("m"), F.split("identifier", " ", 2)[1].alias("p"))
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("p", r"([.\\+*?\[\]^$()|])", r"\\$1"), r"\{[^}]*\}|[{}]", ".*"), F.lit("$"))
    # The verb alone would pair a specification with every endpoint of that verb: paths must also begin alike.
    head = lambda c: F.regexp_extract(c, r"^/?([^/{:]*)", 1)
    asked = api.select(key, "m", like.alias("like"), head(F.col("p")).alias("head"))
    known = endpoints.select(F.upper("method").alias("m"), F.col("path").alias("path"), head(F.col("path")).alias("head"), F.concat(F.coalesce("handler_name", F.lit("")), F.lit(" ["), F.coalesce("framework", F.lit("")), F.lit("]")).alias("found"))
    hit_api = asked.join(known, ["m", "head"]).where(F.expr("path rlike like")).select(key, "found", F.lit(ENDPOINT).alias("sure"))
    named = own.where("kind = 'service_method'").select(key, F.lower(F.when(F.col("identifier").contains("."), F.regexp_extract("identifier", r"^[^.]*\.(.*)$", 1)).otherwise(F.col("identifier"))).alias("k"))
    methods = symbols.where("kind = 'method'").select(F.lower("name").alias("k"), F.coalesce("qualified_name", "name").alias("found")).distinct()
    hit_method = named.join(methods, "k").select(key, "found", F.lit(METHOD).alias("sure"))
    hits = hit_api.unionByName(hit_method).groupBy(key).agg(F.slice(F.array_sort(F.collect_set("found")), 1, 5).alias("evidence"), F.max("sure").alias("sure"))
    told = own.join(hits, key, "left")
    front = F.col("kind").isin("ui_screen", "api_call")
    return told.select(*components.columns, F.col("sure").isNotNull().alias("implemented"), F.when(front, FRONTEND).otherwise(F.coalesce("sure", F.lit(0.0))).alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def feature_status(detected: DataFrame, feature: str = "feature", side: str = "side") -> DataFrame:
    """Per feature the status of its back end, its front end and of both; a side without parts is implemented.

    A front end that is missing does not hold back a feature whose back end is there.
    """
    done = lambda s: F.count_if((F.col(side) == s) & F.col("implemented"))
    total = lambda s: F.count_if(F.col(side) == s)
    out = detected.groupBy(feature).agg(roll_up(done("backend"), total("backend")).alias("backend"), roll_up(done("frontend"), total("frontend")).alias("frontend"))
    both = F.when((F.col("backend") == "implemented") & F.col("frontend").isin("implemented", "missing"), "implemented").when((F.col("backend") == "missing") & (F.col("frontend") == "missing"), "missing").otherwise("partial")
    return out.withColumn("status", both)


def coverage_percent(status: DataFrame) -> DataFrame:
    """One row ``(n_features, percent)``: implemented features in percent, 0 without features."""
    n = F.count(F.lit(1))
    return status.agg(n.alias("n_features"), F.when(n == 0, 0.0).otherwise(F.round(100.0 * F.count_if(F.col("status") == "implemented") / n, 2)).alias("percent"))


_MARK = {"implemented": "\u2713", "partial": "\u26a0"}


def render_coverage(detected: DataFrame, feature: str = "feature", markdown: bool = False, title: str = "specification") -> str:
    """A coverage report as text: features with their parts and what was found for them, and the totals."""
    status = feature_status(detected, feature)
    parts: dict = {}
    for r in detected.orderBy(feature, "side", "kind", "identifier").collect():
        parts.setdefault(r[feature], []).append(r)
    sign = lambda s: _MARK.get(s, "\u2717")
    rows = status.orderBy(feature).collect()
    done, partial = (sum(r["status"] == s for r in rows) for s in ("implemented", "partial"))
    percent = 100 * done / len(rows) if rows else 0
    total = f"{done} of {len(rows)} features ({percent:.0f} %), {partial} in part, {len(rows) - done - partial} missing"
    lines = [f"# Coverage of {title}", "", f"**{total}**", ""] if markdown else [f"Coverage of {title}", ""]
    for r in rows:
        lines.append(f"{'## ' if markdown else ''}{sign(r['status'])} {r[feature]}")
        for p in parts.get(r[feature], []):
            found = f" ({', '.join(p['evidence'])})" if p["evidence"] else ""
            name = f"`{p['identifier']}`" if markdown else f"{p['identifier']} [{p['kind']}]"
            lines.append(f"{'-' if markdown else '   '} {p['side']}: {sign('implemented' if p['implemented'] else 'missing')} {name}{found}")
        lines.append("")
    return "\n".join(lines if markdown else [*lines, total]) + "\n"
