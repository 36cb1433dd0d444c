"""Imports named in source text: four languages, without grammars.

Comments are dropped and string literals are set aside behind numbered marks in one pass, so that a keyword inside either
never counts and the statements can be read with plain patterns. Texts above MAX_BYTES or without an import keyword name
nothing. Unterminated literals end with their line (a block comment with the text).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 512 * 1024
_KEYWORD = {
    "rust": re.compile(r"\b(?:use|extern)\b"),
    "typescript": re.compile(r"\b(?:import|require|from)\b"),
    "python": re.compile(r"\b(?:import|from)\b"),
    "go": re.compile(r"\bimport\b"),
}
_C_LIKE = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<raw>r(?P<h>#*)\".*?\"(?P=h))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?)|(?P<char>'(?:\\.[^'\n]*|[^'\\\n])')", re.S
)
_SCRIPT = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)", re.S)
_PYTHON = re.compile(r"(?P<comment>#[^\n]*)|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)", re.S)
_MARK = "\x01{}\x01"


def set_aside(text: str, pattern: re.Pattern) -> tuple[str, list[str]]:
    """(text without comments and with a mark for each string literal, the literals without their quotes)."""
    literals: list[str] = []

    def swap(m: re.Match) -> str:
        if m.lastgroup is None or m.group("comment") is not None:
            return "\n" * m.group().count("\n") or " "
        s = m.group()
        if s[0] == "r":
            s = s[1 + len(m.group("h")) : len(s) - len(m.group("h"))]
        literals.append(s[1:-1] if len(s) > 1 and s[-1] == s[0] else s[1:])
        if s[0] == "`" and "${" in s:
            literals[-1] = "\x00"  # not a fixed name
        return _MARK.format(len(literals) - 1)

    return pattern.sub(swap, text), literals


def rust_imports(text: str) -> list[str]:
    code, _ = set_aside(text, _C_LIKE)
    out = []
    for statement in code.split(";"):
        m = re.search(r"(?:^|[\n{}\]])\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:use\s+([^;]+)|extern\s+crate\s+(\w+))\Z", statement.rstrip(), re.S)
        if not m:
            continue
        name = m.group(2) or re.sub(r"\s+", " ", m.group(1)).strip().removeprefix("::").split("::")[0].strip()
        if name and name not in ("crate", "self", "super"):
            out.append(name)
    return out


_SCRIPT_FORMS = re.compile(
    r"\b(?:import|export)\b(?P<clause>[^;\x01()=]*?)\bfrom\s*\x01(?P<a>\d+)\x01|\bimport\s*\x01(?P<b>\d+)\x01|\b(?:require|import)\s*\(\s*\x01(?P<c>\d+)\x01\s*(?:,[^()]*)?\)"
)


def typescript_imports(text: str) -> list[str]:
    code, literals = set_aside(text, _SCRIPT)
    found = [literals[int(m.group("a") or m.group("b") or m.group("c"))] for m in _SCRIPT_FORMS.finditer(code)]
    return [x for x in found if x and x != "\x00"]


def python_imports(text: str) -> list[str]:
    try:
        return [x for node in ast.walk(ast.parse(text)) for x in _python_node(node)] if "\x00" not in text else []
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    code, _ = set_aside(text, _PYTHON)
    out = []
    for line in re.sub(r"\\\n", " ", code).replace(";", "\n").split("\n"):
        if m := re.match(r"\s*import\s+(.+)", line):
            out += [x.strip().split(" ")[0].split(".")[0] for x in m.group(1).split(",") if x.strip()]
        elif m := re.match(r"\s*from\s+(\.*)\s*([\w.]*)\s+import\s+(.+)", line):
            names = [x.strip().split(" ")[0] for x in m.group(3).strip("() ").split(",") if x.strip()]
            out += _python_from(len(m.group(1)), m.group(2), names)
    return out


def _python_from(level: int, module: str, names: list[str]) -> list[str]:
    if not level:
        return [module.split(".")[0]]
    return ["." * level + module] if module else ["." * level + n for n in names]


def _python_node(node) -> list[str]:
    if isinstance(node, ast.Import):
        return [a.name.split(".")[0] for a in node.names]
    if isinstance(node, ast.ImportFrom):
        return _python_from(node.level, node.module or "", [a.name for a in node.names])
    return []


def go_imports(text: str) -> list[str]:
    code, literals = set_aside(text, _C_LIKE)
    out = []
    for m in re.finditer(r"\bimport\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\x01(\d+)\x01)", code):
        out += [literals[int(m.group(2))]] if m.group(2) else [literals[int(i)] for i in re.findall(r"\x01(\d+)\x01", m.group(1))]
    return [x for x in out if x]


_EXTRACT = {"rust": rust_imports, "typescript": typescript_imports, "python": python_imports, "go": go_imports}


def parse_imports(language: str | None, text: str | None) -> list[str]:
    """The imports that a source text names, in order; none for null, unknown languages and texts that are too long."""
    if not text or language not in _EXTRACT or len(text.encode("utf-8", "replace")) > MAX_BYTES or not _KEYWORD[language].search(text):
        return []
    return _EXTRACT[language](text)


def extract(files: DataFrame, key: list[str], language: str, text: str, blob: str) -> DataFrame:
    """(key..., imports): the imports of each file; equal blobs of a language are parsed once. A file without a blob id counts as
    equal to those with its text."""
    same = F.coalesce(F.col(blob).cast("string"), F.concat(F.lit("text "), F.sha2(F.col(text), 256)))
    own = files.select(*key, F.col(language).alias("_l"), same.alias("_b"), F.col(text).alias("_t"))
    once = own.where(F.col("_l").isNotNull()).groupBy("_l", "_b").agg(F.first("_t", ignorenulls=True).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_imports(la, t) for la, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.string()))], ["_l", "_b", "imports"])

    parsed = once.mapInArrow(run, "_l string, _b string, imports array<string>")
    joined = own.drop("_t").join(parsed, (own["_l"].eqNullSafe(parsed["_l"])) & (own["_b"].eqNullSafe(parsed["_b"])), "left")
    return joined.select(*key, F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))


def register_table_function(spark) -> None:
    """module_imports(text, language): a SQL table function with one row (import_name) for each import."""
    from pyspark.sql.functions import udtf

    class ModuleImports:
        def eval(self, text: str, language: str):
            for name in parse_imports(language, text):
                yield (name,)

    spark.udtf.register("module_imports", udtf(ModuleImports, returnType="import_name: string"))
