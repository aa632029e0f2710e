"""Extractors on short source texts."""

from codeloom.extract.go import extract_go
from codeloom.extract.java import extract_java
from codeloom.extract.patterns import DEFAULT_PATTERNS as P
from codeloom.extract.patterns import catalogue_patterns
from codeloom.extract.python import extract_python
from codeloom.extract.script import expo_path, extract_script
from codeloom.functions.functions import find_functions
from codeloom.functions.lexer import BAD, language, lex
from codeloom.sources import manifests

GO = """package shop

import (
	web "net/http"
	"github.com/gin-gonic/gin"
)

const Limit = 3

// Store keeps items.
type Store interface {
	Get(id string) (*Item, error)
}

type mem struct{ m map[string]Item }

func (m *mem) Get(id string) (*Item, error) { return load("}"), nil }

// Serve starts it.
func Serve(ctx context.Context, a, b Item) Result {
	r := gin.Default()
	r.GET("/items/:id", h.List)
	web.Get("http://other/x")
	x.y.Do()
	return Result{}
}
"""


def names(rows, *fields):
    return [tuple(r[f] for f in fields) for r in rows]


def test_go():
    r = extract_go("shop/a.go", GO, P.of("go"))
    kinds = dict((n, k) for k, n in names(r.symbols, "kind", "name"))
    assert r.module == "shop" and kinds["Get"] == "method" and kinds["Store"] == "interface" and kinds["mem"] == "struct" and kinds["Limit"] == "const"
    assert ("shop.(*mem).Get", "*mem") in names(r.symbols, "qualified_name", "receiver")
    assert ("Store", "Store keeps items.") in names(r.symbols, "name", "doc_comment")
    assert ("net/http", "web") in names(r.imports, "import_path", "alias")
    calls = names(r.function_calls, "callee_name", "callee_package", "confidence")
    assert ("load", "shop", 0.9) in calls and ("Default", "gin", 0.8) in calls and ("GET", "r", 0.5) in calls and ("Do", "", 0.5) in calls
    assert names(r.api_endpoints, "method", "path", "handler_name", "framework") == [("GET", "/items/:id", "h.List", "gin")]
    assert names(r.interface_methods, "interface_name", "method_name") == [("shop.Store", "Get")]
    assert ("http_api", "http://other/x") in names(r.service_connections, "conn_type", "target")
    assert ("shop.Serve", "Item", "input", 2) in names(r.type_usages, "symbol_name", "type_name", "direction", "position")


def test_go_zero_routes_and_no_framework():
    text = 'package r\nimport "github.com/zeromicro/go-zero/rest"\nfunc R() {\n\ts.AddRoutes([]rest.Route{\n\t\t{\n\t\t\tMethod: http.MethodPost,\n\t\t\tPath: "/a",\n\t\t\tHandler: h(ctx),\n\t\t},\n\t\t{Method: "GET", Path: "/b", Handler: x},\n\t})\n}\n'
    assert names(extract_go("r.go", text).api_endpoints, "method", "path", "handler_name") == [("POST", "/a", "h(ctx)"), ("GET", "/b", "x")]
    assert extract_go("r.go", 'package r\nfunc R() { m.GET("/x", y) }\n').api_endpoints == []


def test_script():
    text = """import { useState } from 'react';
// Shows items.
export const ItemList: React.FC<Props> = ({ id }) => {
  const { data } = useGet(MasterApi.ITEM);
  api.delete(`${MasterApi.ITEM}/${id}`);
  axios.get('/api/v1/old/7');
  return <Stack.Screen name="Home" component={HomeScreen} />;
};
export function useItems(id) {
  return query(`/api/opal/${id}`);
}
const helper = (x) => x;
export interface Props { id: string }
export type Kind = 'a' | 'b';
class Old extends React.Component { render() { return <Route path="/x" element={<Home />} />; } }
"""
    r = extract_script("web/shop/List.tsx", text, P.of("ts"))
    assert set(names(r.symbols, "kind", "name")) == {("component", "ItemList"), ("hook", "useItems"), ("interface", "Props"), ("type_alias", "Kind"), ("component", "Old")}
    assert ("SCREEN", "Home", "HomeScreen") in names(r.api_endpoints, "method", "path", "handler_name") and ("GET", "/x", "Home") in names(r.api_endpoints, "method", "path", "handler_name")
    calls = names(r.component_api_calls, "component", "http_method", "api_path")
    assert calls == [("ItemList", "GET", "MasterApi.ITEM"), ("ItemList", "DELETE", "MasterApi.ITEM/${id}"), ("ItemList", "GET", "/v1/old/{id}"), ("useItems", "GET", "/opal/{id}")]
    assert expo_path("app/(tabs)/user/[id].tsx") == "/user/:id" and expo_path("app/_layout.tsx") is None and expo_path("src/a.tsx") is None


def test_python():
    text = '"""M."""\nfrom . import db\nimport grpc\nfrom kafka import KafkaConsumer\nMAX = 1\nx = 2\n__all__ = []\n@app.route("/y", methods=["GET", "POST"])\ndef y():\n    """Does y."""\n    KafkaConsumer("orders")\n    grpc.insecure_channel("h:1")\nclass A(B):\n    def __init__(self): pass\n    async def m(self): pass\n'
    r = extract_python("svc/orders/a.py", text, P.of("python"))
    assert set(names(r.symbols, "kind", "qualified_name")) == {("func", "orders.y"), ("class", "orders.A"), ("method", "orders.(A).m"), ("const", "orders.MAX"), ("var", "orders.x")}
    assert names(r.api_endpoints, "method", "path") == [("GET", "/y"), ("POST", "/y")]
    assert set(names(r.service_connections, "conn_type", "target")) == {("kafka_consume", "orders"), ("grpc", "h:1")}
    assert (".", "db") in names(r.imports, "import_path", "alias")
    assert names(extract_python("a/b.py", "def f(:\n  pass\ndef g(): pass\n").symbols, "name")  # a broken file still gives functions


def test_java():
    text = 'package com.acme.shop;\nimport org.springframework.kafka.annotation.KafkaListener;\n@RequestMapping("/api")\npublic class Orders {\n    public static final int MAX = 3;\n    /** Gets one. */\n    @GetMapping("/orders/{id}")\n    public Order get(String id) { return null; }\n    @KafkaListener(topics = "orders")\n    void on(String m) { }\n}\nenum Kind { A }\n'
    r = extract_java("a/Orders.java", text, P.of("java"))
    assert {("class", "shop.Orders"), ("method", "shop.(Orders).get"), ("field", "shop.(Orders).MAX"), ("enum", "shop.Kind")} <= set(names(r.symbols, "kind", "qualified_name"))
    assert ("GET", "/orders/{id}", "get") in names(r.api_endpoints, "method", "path", "handler_name") and ("GET", "/api", "on") in names(r.api_endpoints, "method", "path", "handler_name")
    assert names(r.service_connections, "conn_type", "target") == [("kafka_consume", "orders")]


def test_lexer_edges():
    assert language("A.GO") == "go" and language("x.txt") is None and language(None) is None
    for lang, text in (("go", "`open"), ("java", '"open\nint x;'), ("python", '"""open'), ("js", "`a ${b")):
        assert any(t[0] == BAD for t in lex(text, lang))
    assert lex("", "go") == [] and lex(None, "js") == []
    assert [t[0] for t in lex("a = b / c / d;", "js")] == list("n=nbnbn;")
    assert [t[0] for t in lex("x = /[/]b/g.test(y)", "js")][:3] == ["n", "=", "s"]
    assert [t[0] for t in lex("return <A b={{c: 1}}>t {x} <B/></A>;", "js", markup=True)] == ["R", "s", ";"]


def test_functions_and_documents():
    text = "// Doc one\n// goes on.\n//go:noinline\nfunc A(x int) {\n\ts := \"}\"\n}\n\n// far\n\nfunc B() {}\n"
    a, b = find_functions("package p\n" + text, "go")
    assert "Doc one" in a.doc and a.line == 5 and a.end > a.start and b.doc == ""
    py = find_functions('class A:\n    # no\n    def f(self,\n          y=1):\n        """Yes."""\n        return y\n    x = 1\n', "python")
    assert py[0].doc == "Yes." and py[0].receiver == "A" and py[0].params == ("self", "y")


def test_manifests_and_catalogue():
    assert manifests.go_requires("module m\nrequire (\n\ta.b/c v1 // indirect\n)\nrequire d.e/f v2\n") == ["a.b/c", "d.e/f"] and manifests.go_module("module m\n") == "m"
    assert manifests.package_dependencies('{"dependencies": {"axios": "1"}, "devDependencies": {"x": "2"}}') == ["axios", "x"] and manifests.package_dependencies("no") == []
    assert manifests.requirements("Flask==1 # x\n-r o.txt\nhttpx[http2]>=1\n") == ["flask", "httpx"]
    assert manifests.maven_dependencies("<dependency><groupId>io.grpc</groupId><artifactId>grpc-stub</artifactId></dependency>") == ["io.grpc:grpc-stub"]
    assert manifests.tsconfig_aliases('{ // c\n "compilerOptions": {"paths": {"@/*": ["src/*"],}}}') == {"@": "src"}
    assert {p.conn_type for p in catalogue_patterns(["io.grpc:grpc-stub", "github.com/redis/go-redis/v9"]).patterns} == {"grpc", "redis"}
    assert catalogue_patterns([]).patterns == []
    brings = {"github.com/ibm/sarama": {"kafka_consume", "kafka_publish"}, "kafkajs": {"kafka_consume", "kafka_publish"}, "nats-py": {"nats"}, "aiohttp": {"http_api"}, "io.lettuce:lettuce-core": {"redis"}, "org.apache.kafka:kafka-clients": {"kafka_consume", "kafka_publish"}, "unknown": set()}
    for name, kinds in brings.items():
        assert {p.conn_type for p in catalogue_patterns([name]).patterns} == kinds, name
    stub = extract_python("a/c.py", "import users_pb2_grpc\n\ndef f(ch):\n    return users_pb2_grpc.UserServiceStub(ch)\n", catalogue_patterns(["grpcio"]).of("python", "a/c.py"))
    assert [c["conn_type"] for c in stub.service_connections] == ["grpc"]
