"""Layout rules see every file, whatever its comments and quotes."""

import pytest

from codeloom.llm.foreign import judge

BLOB = "\n".join("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 2 for _ in range(20))
TABLE = "package a\n\nvar t = []int{\n" + "".join(f"\t{i * 7919 % 65536}, {i * 31 + 1000}, // the row of the station by the river number {i}\n" for i in range(60)) + "}\n"
GETTERS = "".join(f"    def get_{n}(self):\n        return self._values['{n}']\n\n" for n in "abcdef")
OTHER = "".join(f"{n} = y{'+y' * k}\n" for k, n in enumerate("abcdefghij"))


@pytest.mark.parametrize(
    "path,text,kind",
    [
        ("a/blob.py", f'X = """{BLOB}"""\n', "data"),
        ("a/Blob.java", f'class B {{ String X = """\n{BLOB}"""; }}\n', "data"),
        ("a/table.go", TABLE, "data"),
        ("a/row.py", OTHER + "class Row:\n" + GETTERS, "generated"),
    ],
)
def test_judge_without_prefilter(path, text, kind):
    assert judge(path, text) == kind
