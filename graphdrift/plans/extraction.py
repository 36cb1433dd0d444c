"""Queries of import extraction over the source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import imports as I
from ..functions import paths as P
from ..functions.names import file_path
from .runtime import table


def _imports(s, d):
    files = table(s, d, "source_files").select("file_id", "blob_oid", "body", file_path(F.col("file_path")).alias("file_path"))
    files = files.withColumn("language", P.detect_language(F.col("file_path")))
    return I.extract(files, ["file_id", "file_path", "language"], "language", "body", "blob_oid")


def _targets(s, d):
    each = _imports(s, d).select("file_id", "file_path", "language", F.explode("imports").alias("name"))
    found = P.with_import_target(each, F.col("language"), P.package_name(F.col("file_path")), F.col("file_path"), F.col("name"))
    # a filter on `value` itself would be pushed through all steps and repeat their expressions
    return found.groupBy("file_id", F.col("value").alias("target")).agg(F.count("value").alias("weight")).where("weight > 0")


def _blobs(s, d):
    t = table(s, d, "source_files")
    return t.groupBy("lang_name", "blob_oid").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file"))


#: name, language, source text, the imports that it names.
SAMPLES = (
    ("rust_use", "rust", "use tokio::net::TcpStream;\npub use serde;\nextern crate libc;\nuse crate::own;\nuse super::near;\n", ("tokio", "serde", "libc")),
    ("rust_masked", "rust", "/* use gone::a; /* nested use gone::b; */ */\nlet s = r#\"use gone::c;\"#; // use gone::d;\nuse kept::x;\n", ("kept",)),
    ("ts_forms", "typescript", "import a from './one';\nexport { b } from \"./two\";\nimport c = require('three');\nconst d = require('./four');\nconst e = import(\"./five\");\n", ("./one", "./two", "three", "./four", "./five")),
    ("ts_lines", "typescript", "const f = require(\n  './six'\n);\nconst g = import(\n  './seven'\n);\n", ("./six", "./seven")),
    ("ts_masked", "typescript", "// import x from 'gone';\nconst t = \"import y from 'gone'\";\n/* require('gone') */\nconst u = import(`./${name}`);\nconst v = require(w ? 'a' : 'b');\n", ()),
    ("py_forms", "python", "import os, json.decoder as d\nfrom a.b import c\nfrom . import config\nfrom .sub import item\nfrom ..up import x\n", ("os", "json", "a", ".config", ".sub", "..up")),
    ("py_masked", "python", "\'\'\'import gone\'\'\'\n# import gone\ns = 'import gone'\nimport re\n", ("re",)),
    ("go_block", "go", "package main\n\nimport (\n  \"fmt\"\n  // \"gone\"\n  log \"net/http\"\n)\n", ("fmt", "net/http")),
    ("go_single", "go", "package main\nimport \"os\"\n/* import \"gone\" */\n", ("os",)),
    ("none", "cobol", "import x", ()),
    ("too_long", "python", "import os\n" + " " * I.MAX_BYTES, ()),
)


def _samples(s, d):
    rows = s.createDataFrame([(n, la, t, n) for n, la, t, _ in SAMPLES], "sample string, language string, body string, blob_oid string")
    got = I.extract(rows, ["sample"], "language", "body", "blob_oid")
    return got.select("sample", F.posexplode_outer("imports").alias("position", "import_name"))


def _values() -> str:
    rows = [(n, i, x) for n, _, _, xs in SAMPLES for i, x in (enumerate(xs) if xs else [(None, None)])]
    show = lambda v: "NULL" if v is None else repr(v)
    return "SELECT * FROM (VALUES " + ", ".join(f"({show(a)}, {show(b)}, {show(c)})" for a, b, c in rows) + ") AS v(sample, position, import_name)"


QUERIES = {
    "ext_samples": _samples,
    "ext_parse_imports": lambda s, d: _imports(s, d).select("file_id", F.posexplode("imports").alias("position", "import_name")),
    "ext_file_targets": _targets,
    "ext_dedup_blobs": _blobs,
}
ORACLES = {"ext_samples": _values(), "ext_dedup_blobs": "SELECT lang_name, blob_oid, count(*) AS n_files, min(file_id) AS first_file FROM source_files GROUP BY 1, 2"}
for _l in P.LANGUAGE_SUFFIXES:
    QUERIES[f"ext_{_l}"] = lambda s, d, la=_l: _imports(s, d).where(F.col("language") == la).select("file_id", F.size("imports").alias("n_imports"))
