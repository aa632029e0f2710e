"""Every Python file is judged by the standard parser."""

from codeloom.llm.syntax import unparsable

BAD = ["try:\n    f()\nexcept A, e:\n    g()\n", "raise E, 'm'\n", "else:\n    f()\n", "try:\n    f()\ng()\n", "f(a=1, 2)\n", "def f(a=1, b):\n    pass\n", "f(x) = 3\n"]
GOOD = ["try:\n    f()\nexcept (A, B) as e:\n    g()\n", "f(2, a=1)\n", ""]


def test_legal_pairs_in_a_wrong_statement(spark):
    rows = [(i, f"a/m{i}.py", t) for i, t in enumerate(BAD + GOOD)]
    df = spark.createDataFrame(rows, "file_id long, path string, content string")
    assert {r["file_id"] for r in unparsable(df).collect()} == set(range(len(BAD)))
