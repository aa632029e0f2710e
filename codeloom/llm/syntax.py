"""Source files that do not parse.

Files are lexed into rows, one per statement line: the token classes as a string
(its *shape*) with the kind of block around it and the token before it, and the
brackets that the line leaves open.  Shapes repeat enormously, so grammar checks
run on distinct shapes: the adjacent token pairs of a shape are anti-joined
against the pairs the grammar permits, and statement forms that no production
yields are looked for.  Nesting is checked by windows over the bracket rows of
each file.  For Python, candidates are confirmed by the standard parser.
"""

from __future__ import annotations

import ast
import functools
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.lexer import COMMENT, LANGUAGES, NEWLINE, Token, language, lex
from codeloom.session import cut_lineage, spread

_EXPR = {
    "go": "nds([u!FMSw",
    "java": "nds(u!iNvtC@",
    "js": "nyds([{u!ifKrv<I@#",
    "python": "nds([{u!tvlwe",
}
_STATEMENT = {
    "go": "FTVRBCKDG}{;PI",
    "java": "PIKm;CWRBkDt}{@x<W",
    "js": "IZVCWRBkD;}",
    "python": "fKCWIFRBy@",
}

# For each token class the classes that may follow it in the grammar.
# 1 stands for the starts of an expression, 2 for those of a statement; ^ is the
# start of a file and $ its end.
_FOLLOW = {
    "go": {
        "^": "P", "P": "n", "I": "sn(.", "F": "n(", "T": "n()", "V": "n(", "S": "{", "M": "[nuw(SMF", "R": "1;}", "B": "n;}", "C": "1;{g", "E": "{C", "K": "1MS", "D": ":", "G": "1", "g": "1",
        "n": ".,;:=()[]{}bui<>eSMFnsw", "d": ",;:)]}{bu<>i", "s": ",;:)]}{bu<>.[", "(": "1)eMST", ")": ".,;()[]{}bu<>=inSMFews:", "[": "1]e:MS", "]": "nu[(.,;:=)]}{b<>iSMFsw", "{": "12}",
        "}": ";,)].([{E:bu}e", ",": "1)]}eSMF{", ";": "12)$}.", ":": "12;]}SM", ".": "n(s", "=": "1MSgFw", "b": "1", "u": "1nSMF[(", "!": "1", "i": ";{)", "<": "1", ">": "1", "e": "nu[(SMF),]", "w": "1MSn",
    },
    "java": {
        "^": "PIKm@;nWv$", "P": "n", "I": "nm", "m": "mtKn@<{(", "K": "n", "x": "nv@", "t": "n[.)>,eAt", "C": "(", "W": "{(21", "R": "1;", "B": "n;", "k": "1tn", "D": ":AtmnK<1{",
        "N": "nt@<;,)", "o": "ntm(@", "v": ".)],;(bu<>o?:=[}A1", "n": "n()[]{}<>.,;=:?bu!ioAe@xv", "d": ",;)]}bu<>?:oiA", "s": ".,;)]}bu<>?:oA",
        "(": "1tm);n@v{", ")": ".,;()[]{}bu<>?:oAndsvxN!=itm@CWRB21K", "[": "1]", "]": ".,;)]}{[=bu<>?:inoe(A@", "{": "12}m", "}": "12).,;]$:uboA?([", ";": "12})$m",
        ",": "1ntm@};?", ".": "nNvuK<tR", "=": "1{tC", "?": "1x>,", ":": "12tm}k;", "b": "1", "u": "1;n>,(", "<": "1nt?>@", ">": "1n(){},.[;etmx=?K>:@", "!": "1", "i": "1;),]bu}:?.",
        "A": "1{2Rt", "@": "1Kmt@n();,{})", "e": "n),",
    },
    "js": {
        "^": "12$", "I": "{nysu(.*", "Z": "VfKDny{u@I=", "f": "ny(u", "K": "ny{x", "V": "ny[{", "C": "(r{y", "W": "{C12", "R": "1;}N", "r": "1;.)],}:KfN(>", "B": "ny;}", "k": "1", "D": ":1fKny;,}",
        "o": "1", "v": ".,;:)]}buo?=[(y<>A!Ns", "x": "1", "n": ".,;:=()[]{}buio?<>Axy!$so", "y": ".,;:=()[]{}buio?<>Axy!$s1nfKVZI@rv#", "d": ".,;:)]}buo?<>yx$", "s": ".,;:)]}buo?<>y[($s=!{",
        "(": "1)VeN,@y", ")": ".,;:()[]{}buio?<>A=nydsvRBCWVrfK!I$Nx@", "[": "1]e,", "]": ".,;:=()[]{}buio?<>Ay!s$@n", "{": "12e}b@", "}": "N12.,;)](:[buo?A=$<>!s", ",": "1)]}e,>b",
        ";": "12)$,", ":": "12bKDx", ".": "ny([s", "=": "1bf", "b": "1b;", "u": "1,)ny{>;(]", "?": "1.:),=;]>}b", "<": "1>b", ">": "1(){},;.[]=>A?:byo$!xin", "!": "1.;),]b=:[(?}o", "i": "1;),]}bu:?$",
        "A": "1{bA", "e": "1", "@": "ny(", "#": "ny", "N": "12b$",
    },
    "python": {
        # A line starts with J or Q (the line before opened a block or not), then > (deeper), < (shallower) or = (level); $ ends it.
        "f": "n", "K": "n", "l": "n:u", "C": "1:", "W": ":C1", "I": "n(u", "F": "n.ev1", "R": "1$;", "B": "$;", "a": "n([", "o": "1to", "t": "1o", "v": ".,)]}:buo=tCWya;$[(aF<>",
        "w": "1F)$],;}:=", "y": "fC1n", "n": ".,;:=()[]{}butoaCWIA<>$yF@", "d": ".,;:)]}buotaCW<>$y=FI", "s": ".,;:)]}buotaCW<>$y[(s=F@", "(": "1)ey", ")": ".,;:)]}[(buotaCW=A<>$yF@", "[": "1]:ye",
        "]": ".,;:)]}[(buotaCW=A<>$yFI{@", "{": "1}ye", "}": ".,;:)]}[(buotaCW=<>$yF@", ",": "1)]}$:=uyC", ";": "21$", ":": "12e$),]=}:", ".": "n.I", "=": "1y", "b": "1", "u": "1,):F]",
        "<": "1", ">": "1", "!": "1", "A": "1", "e": ".,;:)]}buo$=CW", "@": "1",
    },
}


def permitted_pairs(lang: str) -> set[str]:
    """Two-letter strings of token classes that may stand side by side."""
    base = "js" if lang in ("js", "ts") else lang
    pairs = set()
    for first, after in _FOLLOW[base].items():
        letters = set(after) - {"1", "2"}
        if "1" in after or "2" in after:
            letters |= set(_EXPR[base])
        if "2" in after:
            letters |= set(_STATEMENT[base])
        pairs |= {first + x for x in letters}
    if base == "python":
        level = set(_EXPR[base]) | set(_STATEMENT[base])
        pairs |= {"J" + "\u2192"} | {"Q\u2190", "Q\u2194", "^Q"} | {x + y for x in "\u2192\u2190\u2194" for y in level}
    return pairs


# Statement forms that no production yields, by language.  They are
# matched against a shape: the block around the line (t top level, b block, s list
# of fields or members, o other braces, p parentheses), the token before, the tokens.
_FORBIDDEN = {
    "go": (
        r"^t[;}^][^PIFTV);}\]$]",  # only declarations at top level
        r"^[bso].P|^[bso].I",  # package and import only there
        r"^b.Fn",  # a named function inside another
        r"^b[;{:]nn",  # two names do not make a statement
        r"^b[;{:](?:n\.)*n;",  # nor does one
        r"^t[;}]I(?!.*[s(.n])",
        r"E(?![{C])",
        r"nnn",
    ),
    "java": (
        r"^t[;}^](?:[^PImK@;}$/xn]|n(?!n[(<]|K|un))",
        r"^[bs].P|^[bs].I",
        r"^b[;{}]n[;,]",
        r"nnn",
        r"[nds\])v]N",
    ),
    "js": (
        r"fn?\([^()]*\)(?![:{<])$",
        r"^[bt][;{}N](?:I|Z)[^{nysu(.*VfKDynu@I=]",
    ),
    "python": (r"^b.[\u2192\u2190\u2194]y?(?:C|W|f|K)[^:]*\$$", r"^..[\u2192\u2190\u2194]y?(?:f|K)(?!n)"),
}

_OPEN, _CLOSE = "([{", ")]}"
_RUN = re.compile(r"((?:u?[dns]|n:u?[dsn]),)(?:(?:u?[dns]|n:u?[dsn]),){2,}")
_NET = re.compile(r"\(\)|\[\]|\{\}")


@functools.lru_cache(maxsize=1 << 16)
def _net(shape: str) -> str:
    """Brackets of a line that it does not itself pair."""
    left = "".join(c for c in shape if c in "()[]{}")
    while left:
        fewer = _NET.sub("", left)
        if fewer == left:
            break
        left = fewer
    return left


@functools.lru_cache(maxsize=1 << 16)
def _shortened(line: str) -> str:
    """A shape with long runs of literals cut to one."""
    return _RUN.sub(r"\1", line) if len(line) > 12 else line


def statement_lines(text: str | None, lang: str, markup: bool = False) -> list[str]:
    """Shapes of a file's statement lines in order: block letter, token before, token classes."""
    tokens = lex(text, lang, markup)
    return _python_lines(text or "", tokens) if lang == "python" else _brace_lines(text or "", tokens, "js" if lang == "ts" else lang)


def _brace_lines(text: str, tokens: list[Token], lang: str) -> list[str]:
    lines: list[str] = []
    stack: list[str] = []
    row: list[str] = []
    prev, start_prev, broken = "^", "^", False
    ends = {"go": "nds)]}iRB", "java": "ndsv]", "js": "nydsv)]}iRB"}[lang]
    block = "t"

    def close_row() -> None:
        nonlocal row
        if row:
            lines.append(block_at + start_prev + "".join(row))
            row = []

    block_at = block
    annotation = 0
    size = len(tokens)
    for k in range(size + 1):
        kind, at, end = tokens[k] if k < size else ("$", 0, 0)
        if kind == COMMENT:
            if lang != "java" and not broken and text.find("\n", at, end) >= 0:
                broken = True
            continue
        if kind == NEWLINE:
            broken = True
            continue
        if annotation and lang == "java":
            if kind == "." or kind == "n" and prev in "@.":
                prev = "." if kind == "." else "@"
                annotation = 1
                continue
            annotation = 0
            prev = "@"
        if broken or kind == "$":
            inside = stack[-1] if stack else "t"
            if lang == "go" and prev in ends:
                row.append(";")
                prev = ";"
            elif lang == "java" and broken and inside in "tbs" and prev in ends and kind in "ndsvtRCWBNmK":
                row.append("N")
            elif lang == "js" and broken and inside in "tbso" and prev in ends and kind not in ".?:buoA=)]},;<>$":
                row.append("N")
                prev = "N"
            if broken and prev in ";N}" or len(row) > 400:
                close_row()
            broken = False
        if kind == "}":
            close_row()
        if not row:
            block_at, start_prev = (stack[-1] if stack else "t"), prev
        if kind == "$":
            if lang == "go" and not tokens:
                break
            row.append("$")
            break
        row.append(kind)
        if kind == "@" and lang == "java":
            annotation = 1
        if kind in _OPEN:
            if kind != "{":
                stack.append("p")
            elif lang == "go":
                stack.append("s" if prev == "S" else "b" if _go_block(row) else "o")
            elif lang == "java":
                stack.append("s" if "K" in row else "o" if prev in "]=,{(" and not (prev == "{" and stack and stack[-1] in "bs") else "b")
            else:
                stack.append("o" if prev in "=(,:[?bruRoI" or prev in "Zny" and ("I" in row or "Z" in row and "K" not in row and "y" not in row) else "s" if "K" in row or "y" in row else "b")
        elif kind in _CLOSE and stack:
            stack.pop()
        prev = kind
        if kind in ";{":
            close_row()
    close_row()
    return list(map(_shortened, lines))


def _go_block(row: list[str]) -> bool:
    """Whether the bracket at the end of a Go line opens statements and not a value."""
    return bool(set(row) & set("FCE")) or row[-2:-1] in ([], [":"], [";"], ["}"]) or row == ["{"]


def _python_lines(text: str, tokens: list[Token]) -> list[str]:
    lines: list[str] = []
    indents = [0]
    row: list[str] = []
    depth, before, first = 0, "^", 0

    def end_row() -> None:
        nonlocal before, row
        if not row:
            return
        start = text.rfind("\n", 0, first) + 1
        width = 0
        for c in text[start:first].lstrip("\ufeff\f"):
            width = width + 1 if c != "\t" else (width // 8 + 1) * 8
        mark = "\u2194"
        if width > indents[-1]:
            indents.append(width)
            mark = "\u2192"
        elif width < indents[-1]:
            mark = "\u2190"
            while indents[-1] > width:
                indents.pop()
            if indents[-1] != width:
                mark = "X"
        lead = "^Q" if before == "^" else before
        lines.append("b" + lead + mark + "".join(row) + "$")
        before = "J" if row[-1] == ":" else "Q"
        row = []

    for kind, at, _ in tokens:
        if kind == COMMENT:
            continue
        if kind == NEWLINE:
            if depth <= 0:
                end_row()
            continue
        if not row:
            first = at
        row.append(kind)
        if kind in _OPEN:
            depth += 1
        elif kind in _CLOSE:
            depth -= 1
    end_row()
    if before == "J":
        lines.append("bJX")
    return list(map(_shortened, lines))


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file: language, distinct shapes, and the open brackets of its lines in order.

    Python files go to the standard parser instead: ``bad`` is its verdict, and
    they have no shapes.
    """
    for batch in batches:
        files, paths, texts = (batch[c].to_pylist() for c in ("file_id", "path", "content"))
        rows: list[tuple] = []
        for file, path, text in zip(files, paths, texts, strict=True):
            lang = language(path)
            if lang is None:
                continue
            base = "js" if lang == "ts" else lang
            if lang == "python":
                rows.append((file, base, [], "", _rejects(text or "")))
                continue
            lines = statement_lines(text, lang, lang == "js" or path.rstrip().lower().endswith("x"))
            rows.append((file, base, list(dict.fromkeys(lines)), "".join(_net(line[2:]) for line in lines), False))
        cells = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
        kinds = (batch.schema.field("file_id").type, pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["file_id", "lang", "shapes", "nets", "bad"])


def _unbalanced(lexed: DataFrame) -> DataFrame:
    """Files whose brackets do not pair, by running depth and, per depth, alternation of matching kinds."""
    marks = lexed.where("nets <> ''").select("file_id", F.posexplode(F.split("nets", "")).alias("at", "mark")).where("mark <> ''")
    step = F.when(F.col("mark").isin(*_OPEN), 1).otherwise(-1)
    order = Window.partitionBy("file_id").orderBy("at")
    deep = marks.withColumn("step", step).withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    chain = Window.partitionBy("file_id", "level").orderBy("at")
    paired = deep.withColumn("level", level).withColumn("opener", F.lag("mark").over(chain)).withColumn("later", F.lead("mark").over(chain))
    wrong = (
        (F.col("level") < 1)
        | ((F.col("step") == -1) & (F.coalesce(F.translate("opener", _OPEN, _CLOSE), F.lit("")) != F.col("mark")))
        | ((F.col("step") == 1) & F.coalesce(F.col("later").isin(*_OPEN), F.lit(True)))
    )
    return paired.where(wrong).select("file_id").distinct()


def _rejects(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.removeprefix("\ufeff"))  # a byte order mark is legal in a file
        except (SyntaxError, ValueError):
            return True
        except (RecursionError, MemoryError):  # too deep for this parser, which says nothing on the grammar
            return False
    return False


def _bad_shapes(lexed: DataFrame) -> DataFrame:
    """Distinct shapes with a pair the grammar does not permit or of a forbidden form."""
    spark = lexed.sparkSession
    shapes = lexed.select("lang", F.explode("shapes").alias("shape")).distinct()
    table = [(lang, pair) for lang in _FOLLOW for pair in sorted(permitted_pairs(lang))]
    permitted = spark.createDataFrame(table, "lang string, pair string")
    tokens = F.col("shape").substr(F.lit(2), F.length("shape"))
    pairs = shapes.select("lang", "shape", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(tokens) - 1), lambda i: tokens.substr(i, F.lit(2))))).alias("pair"))
    unknown = pairs.join(F.broadcast(permitted), ["lang", "pair"], "left_anti").select("lang", "shape")  # a fixed table of a few thousand rows
    form = F.lit(False)
    for lang, rules in _FORBIDDEN.items():
        form = form | ((F.col("lang") == lang) & F.col("shape").rlike("|".join(f"(?:{r})" for r in rules)))
    return unknown.unionByName(shapes.where(form)).distinct()


def unparsable(sources: DataFrame) -> DataFrame:
    """``(file_id)`` of files whose content is not valid in the language of their extension.

    ``sources`` holds ``file_id``, ``path`` and ``content``.  Files of other
    languages are not judged.  Null and empty content is valid except in Go, where
    a file needs its package clause: an empty text has no tokens and is let pass.
    Repeated rows give one row.  Texts are read whole.
    """
    own = sources.select("file_id", F.col("path").cast("string").alias("path"), F.col("content").cast("string").alias("content"))
    key = own.schema["file_id"].dataType.simpleString()
    lexed = cut_lineage(spread(own).mapInArrow(_lexed, f"file_id {key}, lang string, shapes array<string>, nets string, bad boolean"))
    listed = lexed.select("file_id", "lang", F.explode("shapes").alias("shape"))
    by_shape = listed.join(_bad_shapes(lexed), ["lang", "shape"], "left_semi").select("file_id")
    by_nesting = lexed.select("file_id").join(_unbalanced(lexed), "file_id", "left_semi")
    return by_shape.unionByName(by_nesting).unionByName(lexed.where("bad").select("file_id")).distinct()


def invalid_rates(sources: DataFrame, files: DataFrame, bad: DataFrame) -> DataFrame:
    """``(repo, language, module, n_files, n_invalid, rate)``; module is null where it is not set.

    A file without a row in ``files`` counts with a null module; files in
    languages that are not judged are left out.
    """
    ext = F.lower(F.regexp_extract(F.trim("path"), r"(\.[A-Za-z]+)$", 1))
    lang = F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)
    own = sources.select("file_id", "repo", lang.alias("language")).where(F.col("language").isNotNull())
    module = files.select(F.col("id").alias("file_id"), F.nullif("module", F.lit("")).alias("module"))
    flagged = bad.withColumn("invalid", F.lit(1))
    return (
        own.join(module, "file_id", "left")
        .join(flagged, "file_id", "left")
        .groupBy("repo", "language", "module")
        .agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("n_invalid"))
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
