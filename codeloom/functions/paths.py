"""Request paths, identifiers and display names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_path(path: Column | str, template_slots: bool = True) -> Column:
    """A request path in its general form: variable segments become ``{id}``.

    A leading ``/api`` goes if a ``/`` follows.  Variable are segments that begin
    with ``:``, ``$`` or ``{``, hold ``${`` (unless ``template_slots`` is off), are
    all digits, a UUID or 32 hexadecimal digits.  Null stays null.
    """
    p = F.regexp_replace(path, r"^/api(?=/)", "")
    variable = r"^[:$].+$|^\{.*\}$|^\d+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9a-fA-F]{32}$" + (r"|\$\{" if template_slots else "")
    return F.array_join(F.transform(F.split(p, "/"), lambda s: F.when(s.rlike(variable), F.lit("{id}")).otherwise(s)), "/")


def slashes(path: Column | str) -> Column:
    """A file path with forward slashes and without a leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def extension(path: Column | str) -> Column:
    """Extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def last_segment(name: Column | str, by: str = ".") -> Column:
    """What stands after the last separator."""
    return F.element_at(F.split(name, rf"\Q{by}\E"), -1)


def package_of(qualified: Column | str) -> Column:
    """What stands before the first dot of a qualified name; the name itself without a dot."""
    return F.split_part(qualified, F.lit("."), F.lit(1))


# Framework and weight of its entry points, by extension, then by file name or by the name of the directory.
FRAMEWORK_FILES = {"py": {"views.py": ("django", 3.0), "urls.py": ("django", 2.0), "__init__.py": None}}
FRAMEWORK_FOLDERS = {
    "py": {"routers": ("fastapi", 2.5), "endpoints": ("fastapi", 2.5), "routes": ("flask", 2.5), "api": ("python-api", 2.0)},
    "java": {"controller": ("spring", 3.0), "controllers": ("spring", 3.0), "handler": ("spring", 2.5), "service": ("spring", 1.8), "resource": ("jax-rs", 3.0)},
}


def framework_hint(path: Column | str) -> Column:
    """``struct(framework, multiplier)`` guessed from the names of a file and its directory; null where nothing hints.

    Only Python and Java files hint at one.  The name of the file goes before that
    of its directory; case counts but for the extension.
    """
    p = slashes(path)
    name, folder, ext = F.element_at(F.split(p, "/"), -1), F.regexp_extract(p, r"([^/]+)/[^/]*$", 1), F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    pair = lambda v: F.struct(F.lit(v[0]).alias("framework"), F.lit(v[1]).alias("multiplier")) if v else F.lit(None)
    out = F.lit(None).cast("struct<framework:string,multiplier:double>")
    for table, column in ((FRAMEWORK_FOLDERS, folder), (FRAMEWORK_FILES, name)):
        for language, known in table.items():
            for word, hint in known.items():
                out = F.when((ext == language) & (column == word), pair(hint)).otherwise(out)
    return out


def expo_route(path: Column | str) -> Column:
    """Route of a file under ``app/``: groups in parentheses and ``index`` vanish, ``[x]`` becomes ``:x``; null for layout files."""
    p = F.regexp_extract(slashes(path), r"(?:^|/)app/(.*)\.(?:tsx|jsx|ts|js)$", 1)
    r = F.regexp_replace(p, r"(?:^|(?<=/))\([^)]*\)(?:/|$)", "")
    r = F.regexp_replace(F.regexp_replace(r, r"\[\.\.\.([^\]]+)\]", "*$1"), r"\[([^\]]+)\]", ":$1")
    r = F.regexp_replace(r, r"(?:^|/)index$", "")
    return F.when((p == "") | p.rlike(r"(?:^|/)[_+][^/]*$"), F.lit(None)).otherwise(F.concat(F.lit("/"), r))
