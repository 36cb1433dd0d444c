"""Column expressions over file paths and import strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the model.
LANGUAGE_SUFFIXES = {
    "rust": ("rs",),
    "typescript": ("ts", "tsx", "js", "jsx", "mjs", "cjs"),
    "python": ("py",),
    "go": ("go",),
}
WORKSPACE_ROOTS = ("packages", "apps")
PLAIN_ROOTS = ("src", "lib", "internal")
TEST_FRAGMENTS = (
    "/test/", "/tests/", "/testdata/", "/test_data/", "/__tests__/", "/spec/", "/fixtures/", "/fixture/", "/snapshots/", "/e2e/",
)
ASSET_SUFFIXES = ("css", "scss", "json", "svg", "png", "jpg", "wasm", "html", "md", "txt")
IGNORE_PRESETS = {
    "tooling": (".github/**", ".husky/**", ".vscode/**", ".idea/**", ".devcontainer/**"),
    "artifacts": (
        "coverage/**", "**/coverage/**", "dist/**", "**/dist/**", "build/**", "**/build/**", "target/**", "**/target/**", ".next/**", "**/.next/**",
        ".turbo/**", "**/.turbo/**", ".cache/**", "**/.cache/**", "tmp/**", "**/tmp/**", "temp/**", "**/temp/**",
    ),
    "generated": ("**/__generated__/**", "**/generated/**", "**/*.generated.*", "**/*.d.ts"),
}


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parts_of(path: Column) -> Column:
    """The non-empty segments of a path."""
    return F.filter(F.split(slashes(path), "/"), lambda x: x != "")


def detect_language(path: Column) -> Column:
    """Language by the text after the last dot, null if unknown."""
    suffix = F.element_at(F.split(path, r"\."), -1)
    out = None
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        cond = suffix.isin(*suffixes)
        out = F.when(cond, language) if out is None else out.when(cond, language)
    return out


def file_stem(path: Column) -> Column:
    """Last segment without its last suffix; a name that is only a dotted suffix stays whole; '' without segments."""
    name = F.coalesce(F.try_element_at(parts_of(path), F.lit(-1)), F.lit(""))
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def package_name(path: Column, depth: int = 2) -> Column:
    """Package of a file: the child of a workspace root, else up to `depth` directories after one plain root, else the stem."""
    return package_of_parts(parts_of(path), depth)


def _stem_of_parts(parts: Column) -> Column:
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def package_of_parts(parts: Column, depth: int = 2) -> Column:
    """package_name of a path that is split already."""
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(F.transform(dirs, lambda x: x.isin(*WORKSPACE_ROOTS)), True).cast("int")
    rest = F.when(F.get(dirs, F.lit(0)).isin(*PLAIN_ROOTS), F.slice(dirs, F.lit(2), F.size(dirs))).otherwise(dirs)
    return (
        F.when(F.size(parts) <= 1, _stem_of_parts(parts))
        .when((at > 0) & (at < F.size(dirs)), F.get(dirs, at))
        .when(F.size(rest) == 0, _stem_of_parts(parts))
        .otherwise(F.array_join(F.slice(rest, F.lit(1), F.lit(max(depth, 1))), "/"))
    )


def is_test_path(path: Column, fragments: tuple[str, ...] = TEST_FRAGMENTS) -> Column:
    bounded = F.concat(F.lit("/"), F.btrim(slashes(F.lower(path)), F.lit("/")), F.lit("/"))
    return F.exists(F.array(*map(F.lit, fragments)), lambda f: F.contains(bounded, f))


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: `*` and `?` may cross '/', `**/` spans any directories, `{a,b}` is a choice."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/") and i == 0:
            out, i = out + "(?:|.*/)", i + 3
        elif rest.startswith("/**/"):
            out, i = out + "(?:/|/.*/)", i + 4
        elif rest == "/**":
            out, i = out + "/.*", i + 3
        elif rest[0] == "*":
            out, i = out + ".*", i + len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out, i = out + ".", i + 1
        elif rest[0] == "[" and "]" in rest[2:]:
            j = rest.index("]", 2)
            out, i = out + "[" + ("^" if rest[1] == "!" else "") + rest[1 + (rest[1] == "!") : j] + "]", i + j + 1
        elif rest[0] in "{}," and (depth or rest[0] == "{"):
            out += {"{": "(?:", "}": ")", ",": "|"}[rest[0]]
            depth += {"{": 1, "}": -1, ",": 0}[rest[0]]
            i += 1
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def globs_regex(globs) -> str:
    """One anchored expression that matches what any of the globs does; nothing for no globs."""
    return "^(?:" + "|".join(map(glob_regex, globs)) + ")$" if globs else r"^\b$"


def default_ignores() -> tuple[str, ...]:
    return tuple(dict.fromkeys(g for gs in IGNORE_PRESETS.values() for g in gs))


def ignored(path: Column, globs: tuple[str, ...] | None = None) -> Column:
    return path.rlike(globs_regex(default_ignores() if globs is None else globs))


def tracked(path: Column) -> Column:
    """Whether a scan keeps the file: not ignored, a known language, no test."""
    return ~ignored(path) & detect_language(path).isNotNull() & ~is_test_path(path)


def noise_import(name: Column) -> Column:
    """Imports that name no module: one byte, addresses and runtime schemes, assets, versions and numbers."""
    n = F.trim(name)
    return (
        (F.octet_length(n) <= 1)
        | n.rlike(r"^(?:https?://|npm:|node:)")
        | F.lower(n).rlike(r"\.(?:" + "|".join(ASSET_SUFFIXES) + ")$")
        | (n.rlike(r"^[0-9]") & F.contains(n, F.lit(".")))
        | n.rlike(r"^[0-9.]*$")
    )


def normalize_import(name: Column) -> Column:
    """Trimmed; 'npm:' and a version after it, or 'node:', taken off."""
    n = F.trim(name)
    return (
        F.when(n.startswith("npm:"), F.regexp_extract(n, r"^npm:(@?[^@]*)", 1)).when(n.startswith("node:"), F.substring(n, 6, 100000)).otherwise(n)
    )


def source_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def resolve_relative(directory: Column, name: Column) -> Column:
    """Path that a './' or '../' import names from a directory; null above the root or for nothing."""
    start = F.struct(parts_of(directory).alias("p"), F.lit(True).alias("ok"))

    def step(acc, x):
        up = F.struct(F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok"))
        down = F.struct(F.concat(acc["p"], F.array(x)).alias("p"), acc["ok"].alias("ok"))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(down)

    end = F.aggregate(F.split(name, "/"), start, step)
    return F.when(end["ok"] & (F.size(end["p"]) > 0), F.array_join(end["p"], "/"))


def resolve_python_relative(path: Column, name: Column) -> Column:
    """Module path that a dotted relative import names from a file; null above the root or for nothing."""
    return _python_relative(parts_of(path), name)


def _python_relative(parts: Column, name: Column) -> Column:
    level = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    up = F.greatest(level - 1, F.lit(0))
    dirs = F.size(parts) - 1
    kept = F.slice(parts, F.lit(1), F.greatest(dirs - up, F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(name, r"^\.*", ""), r"\."), lambda x: x != "")
    whole = F.concat(kept, rest)
    return F.when((F.size(parts) > 0) & (up <= dirs) & (F.size(whole) > 0), F.array_join(whole, "/"))


def with_import_target(df: DataFrame, language: Column, package: Column, path: Column, name: Column, depth: int = 2) -> DataFrame:
    """df with `value`, the module that an import points to: null for noise, for nothing and for the file's own package."""
    kept = df.withColumn("_n", normalize_import(name)).withColumn("_noise", noise_import(name)).withColumn("_l", language).withColumn("_p", package)
    n = F.col("_n")
    dotted, relative = (F.col("_l") == "python") & n.startswith("."), n.startswith("./") | n.startswith("../")
    kept = kept.withColumn("_f", parts_of(path))
    kept = kept.withColumn("_r", F.when(dotted, _python_relative(F.col("_f"), n)).when(relative, resolve_relative(source_dir(path), n)).otherwise(n))
    kept = kept.withColumn("_q", parts_of(F.col("_r")))
    kept = kept.withColumn("_t", F.when(F.coalesce(dotted, F.lit(False)) | F.contains(n, F.lit("/")), package_of_parts(F.col("_q"), depth)).otherwise(n))
    t = F.col("_t")
    value = F.when(~F.col("_noise") & (n != "") & (t != "") & (t != F.col("_p")), t)
    return kept.withColumn("value", value).drop("_n", "_noise", "_l", "_p", "_r", "_t", "_f", "_q")
