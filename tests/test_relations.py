"""Division, change detection, ranking, text and paths."""

from pyspark.sql import functions as F

from codeloom.functions.paths import expo_route, framework_hint, normalise_path
from codeloom.functions.text import bm25, identifier_tokens, match_all, tokens
from codeloom.operators.cdc import cascade_delete, set_flag, snapshot_diff, unchanged_skipped, upsert, upsert_latest
from codeloom.operators.division import covers, implementations
from codeloom.operators.rank import cosine, latest_per_key, mode_per_group, nearest_to, reciprocal_rank_fusion, top_k


def test_division(spark):
    need = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "c"), ("k", None)], "need string, item string")
    have = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "a"), ("y", "c"), ("z", None)], "owner string, item string")
    assert {tuple(r) for r in covers(need, have, "need", "item", "owner").collect()} == {("i", "x"), ("j", "y")}


def test_division_of_equal_sets_makes_only_the_result(spark):
    # Every owner has the same items: before, each pair was made once for each item and counted.
    rows = spark.range(600).selectExpr("id as owner", "explode(sequence(1, 40)) as item").unionByName(spark.createDataFrame([(1000, 1), (1001, 41), (None, 1)], "owner long, item int"))
    found = covers(rows.withColumnRenamed("owner", "need"), rows, "need", "item", "owner")
    assert found.distinct().count() == found.count() == 600 * 600 + 601 + 1
    assert found.where("need = 1000 and owner < 600").count() == 600 and found.where("owner = 1000 and need <> 1000").count() == 0
    # the pairs are made last: nothing joins or counts them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: min(plan.index("Join"), plan.index("Aggregate"))].count("Generate explode") == 2


def test_implementations_same_and_cross_file(spark):
    iface = spark.createDataFrame([(1, 10, "I", "A"), (1, 10, "I", "B")], "repo_id int, file_id int, interface_name string, method_name string")
    have = spark.createDataFrame([(1, 10, "S", "A"), (1, 10, "S", "B"), (1, 11, "T", "A"), (1, 12, "T", "B"), (2, 10, "S", "A")], "repo_id int, file_id int, struct_name string, method_name string")
    assert {(r["struct_name"], r["confidence"]) for r in implementations(iface, have).collect()} == {("S", 0.85), ("T", 0.75)}


def test_snapshot_and_upsert(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", None)], "repo string, path string, hash string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "3"), ("r", "c", None), ("r", "d", "4")], "repo string, path string, hash string")
    diff = {r["path"]: r["change"] for r in snapshot_diff(old, new, ["repo", "path"], "hash").collect()}
    assert diff == {"a": "same", "b": "changed", "c": "same", "d": "added"}
    assert {r["path"] for r in unchanged_skipped(new, old, ["repo", "path"], "hash").collect()} == {"b", "c", "d"}
    merged = upsert(old, new, ["repo", "path"])
    assert upsert(merged, new, ["repo", "path"]).count() == merged.count() == 4
    kept = upsert(old, new, ["repo", "path"], keep_old=["hash"])
    assert {r["path"]: r["hash"] for r in kept.collect()}["b"] == "2"


def test_latest_cascade_flag(spark):
    rows = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 5, 3), ("m", None, 4)], "key string, at int, id int")
    assert {(r["key"], r["id"]) for r in upsert_latest(rows, ["key"], "at", "id").collect()} == {("k", 3), ("m", 4)}
    gone = spark.createDataFrame([(2,), (None,)], "id int")
    assert {r["id"] for r in cascade_delete(rows, gone, "id", "id").collect()} == {1, 3, 4}
    assert {r["at"] for r in set_flag(rows, gone, "id", "at", F.lit(9)).where("id = 2").collect()} == {9}
    assert latest_per_key(rows.where("false"), ["key"], [F.desc("id")]).count() == 0


def test_ranking(spark):
    leg1 = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    leg2 = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    fused = reciprocal_rank_fusion([leg1, leg2], "id", 10).collect()
    assert [r["id"] for r in fused] == [2, 1, 3] and abs(fused[0]["score"] - (1 / 61 + 1 / 62)) < 1e-8
    assert reciprocal_rank_fusion([leg1.where("false"), leg2], "id", 10).count() == 2
    mode = mode_per_group(spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None)], "g string, v string"), ["g"], "v")
    assert mode.first()["v"] == "a"
    assert [r["rank"] for r in top_k(leg1, 5, F.asc("id")).collect()] == [1, 2]


def test_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<double>")
    got = {r["id"]: r["c"] for r in df.select("id", cosine(F.col("v"), F.array(F.lit(2.0), F.lit(0.0))).alias("c")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: -1.0, 4: None, 5: None}
    assert [r["id"] for r in nearest_to(df, "id", "v", [1.0, 0.1], 2).collect()] == [1, 2]


def test_text(spark):
    df = spark.createDataFrame([(1, "The Parser parser, été"), (2, "index only"), (3, None), (4, "")], "id int, text string")
    assert df.select(tokens("text")).first()[0] == ["the", "parser", "parser", "été"]
    assert spark.createDataFrame([("HTTPServer get_userName2x",)], "s string").select(identifier_tokens("s")).first()[0] == ["http", "server", "get", "user", "name2x"]
    assert [r["id"] for r in match_all(df, "text", ["PARSER", "été"]).collect()] == [1]
    assert match_all(df, "text", []).count() == 0
    scored = bm25(df, "id", "text", ["parser", "index"], least=1).collect()
    assert {r["id"] for r in scored} == {1, 2} and all(r["score"] > 0 for r in scored)


def test_paths(spark):
    cases = {"/api": "/api", "/apiary/1": "/apiary/{id}", "/api/v1/users": "/v1/users", "/users/123": "/users/{id}", "/items/:id": "/items/{id}", "/items/$id": "/items/{id}", "/x/a${id}": "/x/{id}", "/u/123e4567-e89b-12d3-a456-426614174000": "/u/{id}", "/h/" + "a" * 32: "/h/{id}", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string").withColumn("got", normalise_path("p"))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert spark.createDataFrame([("/x/a${id}",)], "p string").select(normalise_path("p", template_slots=False)).first()[0] == "/x/a${id}"
    routes = {"app/index.tsx": "/", "app/(tabs)/home.tsx": "/home", "app/user/[id].tsx": "/user/:id", "app/_layout.tsx": None, "lib/x.tsx": None}
    df = spark.createDataFrame([(k, v) for k, v in routes.items()], "p string, want string").withColumn("got", expo_route("p"))
    assert all(r["got"] == r["want"] for r in df.collect())
    want = {"app/views.py": ("django", 3.0), "app/api/urls.py": ("django", 2.0), "a/routers/x.py": ("fastapi", 2.5), "a\\routes\\x.PY": ("flask", 2.5), "a/api/x.py": ("python-api", 2.0), "a/api/__init__.py": None}
    want |= {"x/controllers/A.java": ("spring", 3.0), "x/handler/A.java": ("spring", 2.5), "x/service/A.java": ("spring", 1.8), "x/resource/A.java": ("jax-rs", 3.0), "x/service/a.go": None, "src/UserController.java": None, "views.ts": None}
    for r in spark.createDataFrame([(k,) for k in want], "p string").select("p", framework_hint("p").alias("h")).collect():
        assert (tuple(r["h"]) if r["h"] else None) == want[r["p"]], r["p"]
