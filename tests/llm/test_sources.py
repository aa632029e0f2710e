"""Problems 1, 3 and 4 on short source files."""

import ast

import pytest

from codeloom.llm.docpairs import documented_functions, documented_symbols, prose_words
from codeloom.llm.foreign import foreign_files, judge
from codeloom.llm.syntax import invalid_rates, permitted_pairs, statement_lines, unparsable

HAND = "package a\n\n// Was generated once, years ago; maintained by hand since then.\nfunc One(x int) int {\n\tif x > 2 {\n\t\treturn call(x)\n\t}\n\treturn 2\n}\n"
GETTERS = "class Row:\n    __slots__ = ['a']\n" + "".join(f"    def get_{n}(self):\n        return self._values['{n}']\n\n" for n in "abcdef")
MIN = "!function(e,t){" + ";".join(f"var a{i}=b(c,{i});if(d=='x'){{e.push(f)}}" for i in range(40)) + "}(this,[]);"
DATA = "export const points = [\n" + "".join(f"  {i * 977 % 65536}, {i * 31}, {i * 7919 % 7001}, {i},\n" for i in range(60)) + "];\n"
LIB = "package kit\n\nfunc Shared(a int) int {\n" + "".join(f"\tx{i} := compute(a, {i})\n" for i in range(20)) + "\treturn a\n}\n"


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("a/one.go", HAND, None),
        ("a/x.go", "// Code generated by toolname. DO NOT EDIT.\n\n" + HAND, "generated"),
        ("a/x.go", HAND + '\nconst s = `\n// Code generated by toolname. DO NOT EDIT.\n`\n', None),
        ("a/x.py", "# Driver for the code generator, which writes the DO NOT EDIT banner.\nx = f(1)\n", None),
        ("a/x.pb.go", HAND, "generated"),
        ("a/row.py", GETTERS, "generated"),
        ("web/app.js", MIN, "minified"),
        ("a/points.ts", DATA, "data"),
        ("x/node_modules/y/z.js", "f();", "vendored"),
        ("services/vendor_payouts/z.js", "f();", None),
        ("lib/k/z.go", "// Imported unchanged from k 2.1; fix bugs upstream.\n" + HAND, "vendored"),
        ("a/e.go", "", None),
        ("a/e.go", None, None),
        (None, None, None),
    ],
)
def test_judge(path, text, kind):
    assert judge(path, text) == kind


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id long, repo string, path string, content string").selectExpr("*", "1 as kind", "2 as hash")


def test_copies_by_merkle(spark):
    rows = [(1, "r1", "lib/kit/a.go", LIB), (2, "r2", "src\\kit\\b.go", "// (c) other\n" + LIB), (3, "r3", "lib/own/a.go", LIB.replace("compute", "other"))]
    rows += [(10 + i, f"r{1 + i % 2}", f"app/p{i}/f.go", HAND.replace("One", f"F{i}").replace("call", f"c{i}")) for i in range(8)]
    rows += [(30, "r1", "app/stub/a.go", "tiny"), (31, "r2", "app/stub/a.go", "tiny"), (32, None, None, None)]
    found = {r["file_id"]: r["kind"] for r in foreign_files(frame(spark, rows)).collect()}
    assert found == {1: "vendored", 2: "vendored"}
    assert foreign_files(frame(spark, rows).where("false")).count() == 0


BAD = {
    "go": ["package a\nfunc f() {\n\tx := g(1\n}\n", "package a\n<<<<<<< ours\nvar x = 1\n=======\n", "package a\nfunc f() { return 1) }\n", "func f() {}\n", "package a\nif ready\n", "package a\nfunc f() {\n/* open\n}\n", "package a\nfunc f() {\n\t$ make test\n}\n"],
    "java": ["class A {\n  int f() { return 1; }\n", "create table a (id int);\n", "class A { void f() { see the notes below: int x = 1; } }\n", "class A { String s = \"open\n; }\n"],
    "ts": ["export function f(id: string) {\n  a.b(1;\n}\n", "const a = ;\n", "foo bar baz\n", "const t = `open ${x\n"],
    "python": ["def f(:\n  pass\n", "if x\n  y\n", "if x:\ny = 1\n", "package a\n", 'x = """open\n', "a = 1\n  b = 2\n", "[section]\nkey = on every day\n"],
}
GOOD = {
    "go": [HAND, "package a\n\ntype T[K any] struct {\n\tX map[string][]int `json:\"x\"`\n\tmu sync.Mutex\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range c {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch v := any(a).(type) {\n\tcase int:\n\t\treturn v, nil\n\tdefault:\n\t}\n\treturn 1, nil\n}\n", 'package a\n\nvar s = "<<<<<<< text"\n'],
    "java": ["", "package a.b;\n\nimport java.util.*;\n\n@Timed(\"x\")\npublic final class A<T extends B> implements C {\n    private final Map<String, List<T>> m = new HashMap<>();\n    @Override\n    public <R> R f(int[] a, String... b) throws E {\n        for (int x : a) { if (x > 1 && y != null) continue; else return (R) z; }\n        list.stream().map(q -> q.g()).forEach(System.out::println);\n        return cond ? 1 : -2;\n    }\n}\n"],
    "ts": ["", "import { a, type B } from './b';\nexport interface P { id: string; n?: number }\nexport const f = async (x: P, y = 2): Promise<void> => {\n  const { id, ...rest } = x;\n  await g(`/a/${id}`)\n  if (!y) return\n  for (const k of Object.keys(rest)) { h?.[k]?.(); }\n};\n", "const r = /[/)]/g.test(s) ? a / b / c : !d;\n"],
    "python": ["", "\ufeffimport os\n\n@dec\nasync def f(a: int = 1, *b, **c) -> dict:\n    '''Doc\n    =======\n    '''\n    return {k: v async for k, v in x if not k}\n"],
}
EXT = {"go": ".go", "java": ".java", "ts": ".ts", "python": ".py"}


def test_invalid_and_valid_files(spark):
    rows, want = [], set()
    for good, table in ((False, BAD), (True, GOOD)):
        for lang, texts in table.items():
            for text in texts:
                rows.append((len(rows), "r", f"d/f{len(rows)}{EXT[lang]}", text))
                if not good:
                    want.add(len(rows) - 1)
    rows += [(900, "r", "d/x.TXT", "(((("), (901, "r", None, "("), (902, "r", "d/n.py", None)]
    df = frame(spark, rows)
    got = {r["file_id"] for r in unparsable(df).collect()}
    assert got == want
    files = spark.createDataFrame([(0, "m"), (1, "")], "id long, module string")
    rates = {(r["language"], r["module"]): (r["n_files"], r["n_invalid"]) for r in invalid_rates(df, files, unparsable(df)).collect()}
    assert rates["go", "m"] == (1, 1) and rates["go", None] == (9, 6)
    assert unparsable(df.where("false")).count() == 0


def test_python_candidates_cover_the_parser():
    pairs = permitted_pairs("python")
    for text in BAD["python"]:
        with pytest.raises(SyntaxError):
            ast.parse(text)
        lines = statement_lines(text, "python")
        odd = any(line[i : i + 2] not in pairs for line in lines for i in range(1, len(line) - 1))
        opened = sum(c in "([{" for line in lines for c in line) != sum(c in ")]}" for line in lines for c in line)
        assert odd or opened or any(line[3:4] in "CWfK" for line in lines)


@pytest.mark.parametrize(
    "doc,name,real",
    [
        ("// Returns the row that was open when the lock was taken.", "Find", True),
        ("// FlushOutbox flushes the outbox.", "FlushOutbox", False),
        ("// TODO(me): write docs", "F", False),
        ("//go:noinline", "F", False),
        ("/** @param key the key to start from */", "f", False),
        ("/** @return true once every row has been written */", "f", True),
        ("// total += step", "f", False),
        ("/** {@inheritDoc} */", "f", False),
        ("// ==========", "f", False),
        ("", "f", False),
    ],
)
def test_prose(doc, name, real):
    assert (prose_words(doc, name, ("key",)) >= 4) is real


def test_documented(spark):
    go = "package p\n\n// Keeps the rows that nobody has asked for.\nfunc (s *T) Keep(a int) {}\n\n// Far away from what it says here.\n\nfunc Far() {}\n"
    py = "class A:\n    # Groups rows by key for the writer\n    def f(self):\n        '''Groups rows by key for the writer.'''\n    # Groups rows by key for the writer\n    def g(self): pass\n"
    java = "class B {\n    /** Blocks until every row is written. */\n    @Override\n    public int f() { return 1; }\n}\n"
    df = frame(spark, [(1, "r", "a.go", go), (2, "r", "x/b.py", py), (3, "r", "B.java", java), (4, "r", "c.ts", None), (5, "r", "d.ts", "")])
    assert {(r["file_id"], r["name"]) for r in documented_functions(df).collect()} == {(1, "Keep"), (2, "f"), (3, "f")}
    symbols = [(1, "method", "Keep", "p.(*T).Keep"), (1, "method", "Keep", "p.(*T).Keep"), (2, "method", "f", "x.(A).f"), (3, "method", "f", None), (1, "const", "Keep", "p.Keep")]
    index = spark.createDataFrame(symbols, "file_id long, kind string, name string, qualified_name string")
    assert sorted((r["file_id"], r["qualified_name"]) for r in documented_symbols(df, index).collect()) == [(1, "p.(*T).Keep"), (2, "x.(A).f")]


def unit(name, calls=20):
    return f"package {name}\n\nfunc {name.title()}(a int) int {{\n" + "".join(f"\tx{i} := {name}Step(a, {i})\n" for i in range(calls)) + "\treturn a\n}\n"


def copies(spark, rows):
    rows = [(i, *row) for i, row in enumerate(rows)]
    found = foreign_files(frame(spark, rows)).collect()
    return {tuple(rows[r["file_id"]][1:3]): r["kind"] for r in found}


def test_copies_in_the_root_and_far_below(spark):
    own = [(r, f"app/{r}{i}/f.go", unit(f"{r}own{i}")) for r in ("r1", "r2") for i in range(4)]
    deep = "/".join(f"d{i}" for i in range(40))
    rows = [*own, ("r1", "root.go", LIB), ("r2", "root.go", LIB), ("r1", f"{deep}/kit/a.go", unit("deep")), ("r2", f"x/{deep}/kit/b.go", unit("deep"))]
    assert copies(spark, rows) == {("r1", "root.go"): "vendored", ("r2", "root.go"): "vendored", ("r1", f"{deep}/kit/a.go"): "vendored", ("r2", f"x/{deep}/kit/b.go"): "vendored"}
    # Trees that differ far below: their ancestors do not count as equal, so the small file beside them is no copy.
    rows = [*own, *((r, f"{deep}/f.go", unit(f"{r}deep")) for r in ("r1", "r2")), *((r, "d0/small.go", "package a") for r in ("r1", "r2"))]
    assert copies(spark, rows) == {}
    # A directory with the same content throughout is one, files too small to count included.
    rows = [*own, *((r, f"lib/kit/{n}.go", f"package kit\n\nfunc F{n}(a int) int {{ return a * {n} + kitBase{n}(a, {n}, a) + kitRemainder(a, a) }}\n") for r in ("r1", "r2") for n in range(3))]
    assert len(copies(spark, rows)) == 6


def test_forks_and_a_repository_that_is_mostly_copies(spark):
    shared = [(f"src/{n}/f.go", unit(f"same{n}")) for n in range(6)]
    fork = [(r, p, t) for r in ("a", "b") for p, t in shared]
    assert copies(spark, fork) == {}
    other = [("c", f"src/{n}/g.go", unit(f"other{n}")) for n in range(12)]
    # What two forks share with a third repository is a copy in all three.
    third = [*fork, *other, ("c", "lib/0/f.go", shared[0][1])]
    assert set(copies(spark, third)) == {("a", "src/0/f.go"), ("b", "src/0/f.go"), ("c", "lib/0/f.go")}
    # Most files of d come from elsewhere; they are found although hardly anything is its own.
    most = [*other, *(("e", f"src/{n}/h.go", unit(f"more{n}")) for n in range(12)), *(("d", f"x/{n}/g.go", unit(f"other{n}")) for n in range(4)), *(("d", f"y/{n}/h.go", unit(f"more{n}")) for n in range(4)), ("d", "main.go", unit("own"))]
    assert {p for r, p in copies(spark, most) if r == "d"} == {f"x/{n}/g.go" for n in range(4)} | {f"y/{n}/h.go" for n in range(4)}
