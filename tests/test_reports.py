"""Resources, prompts, wiki parts, coverage reports, snippets and embedding write-back on a small index."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators.coverage import coverage_percent, detect_components, feature_status, render_coverage
from codeloom.plans import catalog, reports
from codeloom.plans.catalog import CodeIndex
from codeloom.sources.spec import components_from_json

GO = "package shop\n\n// Cart holds what is bought.\ntype Cart struct {\n\tn int\n}\n\nfunc (c *Cart) Add(k int) int {\n\tif k > 1 {\n\t\treturn k\n\t}\n\treturn c.n\n}\n\nfunc main() {\n\tr := gin.Default()\n\tr.GET(\"/carts/:id\", show)\n}\n\nfunc show() {\n\tx := 1\n"


@pytest.fixture(scope="module")
def index(spark):
    when = dt.datetime(2024, 5, 1)
    repos = spark.createDataFrame([(1, "one", "/one", when, "c1"), (2, "two", "/two", None, None)], "id long, name string, path string, last_indexed_at timestamp, last_commit string")
    files = spark.createDataFrame([(10, 1, "shop/cart.go", "shop", None), (11, 1, "shop/deep/more.go", "shop", None), (20, 2, "b.go", None, None)], "id long, repo_id long, path string, module string, deleted_at timestamp")
    sources = spark.createDataFrame([(10, "one", "shop/cart.go", 'package shop\n\nimport "github.com/gin-gonic/gin"\n' + GO.split("\n", 1)[1]), (20, "two", "b.go", "")], "file_id long, repo string, path string, content string")
    symbol = lambda i, f, kind, name, q, line, doc=None: (i, f, kind, name, q, f"func {name}()", None, line, 1, doc, None, when)
    symbols = spark.createDataFrame(
        [symbol(1, 10, "struct", "Cart", "shop.Cart", 6, "x" * 150), symbol(2, 10, "method", "Add", "shop.(*Cart).Add", 10), symbol(3, 10, "func", "main", "shop.main", 17), symbol(4, 10, "func", "show", "shop.show", 22),
         symbol(5, 11, "method", "Add", "shop.(*Bag).Add", 900), symbol(6, 11, "func", "fill", "shop.fill", 0), symbol(7, 20, "func", "add_all", "b.add_all", None)],
        "id long, file_id long, kind string, name string, qualified_name string, signature string, receiver string, line int, col int, doc_comment string, embedded_at timestamp, loaded_at timestamp",
    )
    calls = spark.createDataFrame([(1, 10, "shop.main", "show", "shop", 18, 1, 0.9), (2, 11, "shop.fill", "Add", "shop", 3, 1, 0.8), (3, 11, "shop.lost", "fill", "shop", 3, 1, 0.7)], "id long, file_id long, caller_qualified_name string, callee_name string, callee_package string, line int, col int, confidence float")
    impls = spark.createDataFrame([(1, 10, "shop.Adder", "shop.(*Cart)", "Add", 0.85), (2, 11, "shop.Adder", "shop.(*Bag)", "Add", 0.75), (3, 11, "shop.Adder", None, "Add", None)], "id long, file_id long, interface_name string, struct_name string, method_name string, confidence float")
    return CodeIndex(repos, files, sources, symbols, calls, impls)


def test_an_interface_gives_a_caller(spark, index):
    # Only Bag.Add is called; whoever changes Cart.Add hears of that caller through the interface.
    calls = index.function_calls.withColumn("callee_package", F.lit("shop"))
    only = CodeIndex(index.repositories, index.files, index.sources, index.symbols.where("id <> 5"), calls, index.interface_impls)
    assert {r["target"] for r in catalog.siblings(index, spark.createDataFrame([("shop.(*Cart).Add",)], "target string")).collect()} == {"shop.(*Cart).Add", "shop.(*Bag).Add"}
    found = {(r["caller"], r["depth"]) for r in catalog.find_callers(index, "(*Cart).Add").collect()}
    assert ("shop.fill", 2) in found and ("shop.lost", 3) in found
    assert {r["caller"] for r in catalog.find_callers(only, "(*Bag).Add").collect()} <= {"shop.fill", "shop.lost"}
    vertices, edges = catalog.build_graph(index)
    assert catalog.dangling_edges(vertices, edges).count() == 0
    assert edges.where("rel = 'IMPLEMENTS'").count() == 2 and edges.where("rel = 'CALLS' and src like '%lost'").count() == 0
    asked = {(r["asked"], r["id"]) for r in catalog.find_callers_by_text(index, "Adder.Add").collect()}
    assert asked == {("shop.(*Cart).Add", 2), ("shop.(*Bag).Add", 5)}
    impact = catalog.analyze_impact(index, "show")
    assert tuple(catalog.impact_totals(impact).first()) == (1, 1, 0)


def test_snippets(index):
    rows = {r["id"]: r["snippet"] for r in catalog.with_snippets(index, index.symbols).collect()}
    assert rows[2].startswith("  \n  func (c *Cart) Add") and rows[2].endswith("  }\n") and "..." not in rows[2]
    assert rows[4].endswith("x := 1\n  \n") and rows[5] is None and rows[6] is None and rows[7] is None
    long = index.sources.select(F.lit("func f() {\n" + "a\n" * 30 + "}").alias("c")).limit(1)
    text = long.select(catalog.snippet(F.col("c"), F.lit(1)).alias("s")).first()["s"]
    assert text.count("\n") == 13 and text.endswith("  ...\n")


def test_resources(index):
    repos = json.loads(reports.read_resource(index, "repositories"))
    assert [r["name"] for r in repos] == ["one", "two"] and repos[1]["last_commit"] == ""
    ends = json.loads(reports.read_resource(index, "endpoints"))
    assert [(e["method"], e["path"], e["handler"], e["file"]) for e in ends] == [("GET", "/carts/:id", "show", "shop/cart.go")]
    schema = json.loads(reports.read_resource(index, "schema"))
    assert "symbols.file_id -> files.id" in schema["relationships"]
    assert reports.read_resource(index, "communities") == "[]"
    found = catalog.detect_communities(index)
    assert json.loads(reports.read_resource(index, "communities", found))[0]["member_count"] >= 2
    processes = catalog.detect_processes(index)
    assert {p["name"] for p in json.loads(reports.read_resource(index, "processes", processes=processes))} == {"HTTP:GET /carts/:id", "Main:shop"}
    with pytest.raises(ValueError):
        reports.read_resource(index, "nothing")


def test_prompts_and_wiki(index):
    text = reports.detect_impact_prompt(index, "show")
    assert "`shop.main` calls `show`" in text and "GET /carts/:id" in text and "(none)" in text
    assert "`shop`" in reports.generate_map_prompt(index)
    found = catalog.detect_communities(index)
    name = found.first()["name"]
    assert "`shop." in reports.explain_community_prompt(found, name) and "(no such" in reports.explain_community_prompt(found, "zzz")
    skills = reports.skill_files(index, found, 1)
    assert skills and all(p.endswith("SKILL.md") for p, _ in skills)
    pages = reports.wiki_pages(index, found, 1, write=lambda task, facts: facts.upper())
    assert {"index.md", "architecture.md", "services/shop.md"} <= set(pages) and "GET /CARTS" in pages["services/shop.md"]
    failed = reports.wiki_pages(index, found, 1, write=lambda task, facts: 1 / 0)
    assert "_Not written" in failed["architecture.md"]
    assert reports.common_folder(["a/b/c.go", "a/b/d/e.go"]) == "a/b" and reports.common_folder([]) == "."


def test_embeddings_are_written_back(spark, index):
    old = spark.createDataFrame([(2, [0.0] * 96, "x", "method", "Add", "", 1, dt.datetime(2020, 1, 1)), (99, [1.0] * 96, "y", "func", "g", "", 2, dt.datetime(2020, 1, 1))], "symbol_id long, embedding array<float>, file string, kind string, name string, service string, line int, created_at timestamp")
    ix = CodeIndex(index.repositories, index.files, index.sources, index.symbols, index.function_calls, index.interface_impls, old)
    symbols, vectors = catalog.embed_index(ix, catalog.hashing_embedder(), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    assert symbols.count() == 7 and {r["id"] for r in symbols.where("embedded_at is not null").collect()} == {2, 3, 4, 5, 6, 7}
    rows = {r["symbol_id"]: r for r in vectors.collect()}
    assert set(rows) == {2, 3, 4, 5, 6, 7, 99} and rows[2]["created_at"].year == 2025 and rows[99]["created_at"].year == 2020
    again = CodeIndex(ix.repositories, ix.files, ix.sources, symbols, ix.function_calls, ix.interface_impls, vectors)
    assert catalog.embed_index(again, catalog.hashing_embedder())[1].count() == 7


def test_coverage_by_rules(spark, index):
    answer = '```json\n{"backend": [{"type": "api_endpoint", "identifier": "GET /carts/{id}"}, {"type": "service_method", "identifier": "Cart.Add"}, {"type": "topic", "identifier": "t"}], "frontend": [{"type": "ui_screen", "identifier": "CartScreen"}]}\n```'
    parts = components_from_json(spark.createDataFrame([("Cart", answer), ("Bad", "no json"), ("None", None), ("Pay", '{"backend": [{"type": "api_endpoint", "identifier": "POST /pay"}]}')], "feature string, a string"), "feature", "a")
    assert parts.count() == 5
    told = detect_components(parts, index.fact("api_endpoints"), index.symbols)
    got = {r["identifier"]: (r["implemented"], round(r["confidence"], 2)) for r in told.collect()}
    assert got == {"GET /carts/{id}": (True, 0.9), "Cart.Add": (True, 0.8), "t": (False, 0.0), "CartScreen": (False, 0.3), "POST /pay": (False, 0.0)}
    status = {r["feature"]: r["status"] for r in feature_status(told).collect()}
    assert status == {"Cart": "partial", "Pay": "partial"}
    done = told.where("identifier <> 't'")
    assert {r["feature"]: r["status"] for r in feature_status(done).collect()}["Cart"] == "implemented"
    assert coverage_percent(feature_status(done)).first()["percent"] == 50.0
    assert "✓ Cart" in render_coverage(done) and "**1 of 2 features (50 %)" in render_coverage(done, markdown=True)
