"""Scanning, incremental indexing, streaming, specifications and coverage."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators.coverage import coverage_percent, detect_endpoints, feature_status
from codeloom.plans.indexing import index_sources
from codeloom.sources.spec import feature_components, feature_sections
from codeloom.sources.store import Store, read_table, render_json, render_markdown
from codeloom.sources.tree import git_head, read_lines, scan_tree
from codeloom.streaming.ingest import file_stream, stream_into_index




def tree(root):
    for name, text in {"a/one.go": "package a\nfunc One() { two() }\n", "b/two.py": "def two():\n    pass\n", "vendor/x/y.go": "package y\n", "notes.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_scan_index_and_incremental(spark, tmp_path):
    src, index = tmp_path / "src", tmp_path / "index"
    tree(src)
    scanned = scan_tree(spark, str(src), "r")
    assert {r["path"] for r in scanned.collect()} == {"a/one.go", "b/two.py"}
    first = index_sources(spark, scanned, str(index))
    assert first["changed"] == 2 and read_table(spark, str(index), "symbols").count() == 2
    assert index_sources(spark, scan_tree(spark, str(src), "r"), str(index))["changed"] == 0
    (src / "a/one.go").write_text("package a\nfunc One() {}\nfunc Three() {}\n")
    (src / "b/two.py").unlink()
    second = index_sources(spark, scan_tree(spark, str(src), "r"), str(index))
    assert (second["changed"], second["removed"]) == (1, 1)
    assert {r["name"] for r in read_table(spark, str(index), "symbols").collect()} == {"One", "Three"}
    calls = read_table(spark, str(index), "function_calls")
    assert calls is None or calls.count() == 0
    assert {r["path"] for r in read_table(spark, str(index), "files").collect()} == {"a/one.go"}


@pytest.mark.parametrize("uri", [False, True])
def test_unchanged_files_stay(spark, tmp_path, uri):
    root = ("file://" if uri else "") + str(tmp_path / "index")
    rows = [("r", "a.go", "package a\nfunc A() {}\n", "1"), ("r", "b.go", "package a\nfunc B() {}\n", "1"), ("s/x y", "b.go", "package a\nfunc S() {}\n", "1"), (None, "n.go", "package a\nfunc N() {}\n", "1")]
    frame = lambda rows: spark.createDataFrame(rows, "repo string, path string, content string, hash string")
    names = lambda: sorted(r["name"] for r in read_table(spark, root, "symbols").collect())
    assert index_sources(spark, frame(rows), root)["symbols"] == 4
    store = Store(spark, root)
    before = store.manifest()
    index_sources(spark, frame([("r", "b.go", "package a\nfunc C() {}\n", "2")]), root, full=False)
    assert names() == ["A", "C", "N", "S"]
    after = store.manifest()
    kept, moved = ({r for r in before.repos("symbols") if (before.repos("symbols")[r] == after.repos("symbols")[r]) is same} for same in (True, False))
    assert moved == {"repo=r"} and len(kept) == 2
    # A write that dies before its manifest changes nothing, and the state before can still be read.
    store._commit = lambda state: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.write({"symbols": store.read("symbols").where("false")}, ["r", "s/x y"])
    assert names() == ["A", "C", "N", "S"]
    assert sorted(r["name"] for r in store.read("symbols", state=before).collect()) == ["A", "B", "N", "S"]
    # What some state still names, or a write may be at, stays; folders that nothing names go.
    assert Store(spark, root).vacuum(keep=1) == 0
    index_sources(spark, frame([*rows[:1], ("r", "b.go", "package a\nfunc C() {}\n", "2"), *rows[2:]]), root, force=True)
    assert Store(spark, root).vacuum(keep=1) > 0 and names() == ["A", "C", "N", "S"]
    assert [r["name"] for r in store.read("symbols", ["s/x y"]).collect()] == ["S"]


def test_two_writers(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    df = spark.createDataFrame([("r", 1)], "repo string, x int")
    state = other.manifest()
    store.write({"t": df}, ["r"])
    other.manifest = lambda: state
    with pytest.raises(RuntimeError):
        other.write({"t": df}, ["r"])


def test_stream(spark, tmp_path):
    src, index = tmp_path / "src", tmp_path / "index"
    tree(src)
    stream_into_index(file_stream(spark, str(src)), "r", str(index), str(tmp_path / "cp")).awaitTermination(120)
    assert read_table(spark, str(index), "files").count() == 2


def test_read_lines_and_rendering(spark):
    df = spark.createDataFrame([("r", "a.go", "x\ny\nz")], "repo string, path string, content string")
    assert [r["text"] for r in read_lines(df, "r", "a.go", 2, 3).orderBy("line").collect()] == ["   2: y", "   3: z"]
    assert read_lines(df, "r", "../a.go").count() == 0
    assert '"path": "a.go"' in render_json(df, 5) and "| r | a.go | x y z |" in render_markdown(df, 5)
    assert git_head("/nowhere") == ""


def test_spec_and_coverage(spark):
    text = "# T\n## Feature: Login\nPOST /login and GET /users/{id}\n### Notes\nmore\n## Feature: Empty\nnothing"
    specs = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    sections = feature_sections(specs, "id", "text")
    assert [r["name"] for r in sections.orderBy("feature").collect()] == ["Login", "Empty"]
    parts = feature_components(sections, "id")
    assert {(r["method"], r["path"]) for r in parts.collect()} == {("POST", "/login"), ("GET", "/users/{id}")}
    known = spark.createDataFrame([("get", "/api/users/:uid")], "method string, path string")
    found = detect_endpoints(parts, known).withColumn("side", F.lit("backend"))
    assert {(r["path"], r["confidence"]) for r in found.collect()} == {("/login", 0.0), ("/users/{id}", 0.9)}
    status = feature_status(found)
    assert status.first()["backend"] == "partial" and coverage_percent(status).first()["percent"] == 0.0
    assert coverage_percent(status.where("false")).first()["percent"] == 0.0
