"""Queries and oracles of the scalar functions over paths, imports, labels, messages and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import paths as P
from ..functions.names import module_name
from .runtime import table

NAME = "nullif(trim(replace({}, chr(92), '/'), ' ' || chr(9)), '')"


def _paths(s, d) -> DataFrame:
    return table(s, d, "dependency_edges").select("file_path").where("file_path IS NOT NULL").distinct()


def _labels(s, d) -> DataFrame:
    e = table(s, d, "dependency_edges")
    cols = [e.select(module_name(F.col(c)).alias("label")) for c in ("from_module", "to_module")]
    cols.append(table(s, d, "node_metadata").select(module_name(F.col("module_name")).alias("label")))
    return cols[0].unionByName(cols[1]).unionByName(cols[2]).where("label IS NOT NULL").distinct()


def _pairs(s, d) -> DataFrame:
    e = table(s, d, "dependency_edges")
    return e.select(module_name(F.col("from_module")).alias("from_module"), module_name(F.col("to_module")).alias("to_module")).dropna().distinct()


PREFIXES = ("", "./", "../", "../../", "npm:", "npm:@", "node:", ".", "..", "https://", "1.")
SUFFIXES = ("", "@1.2", ".css", "/x/y")


def _imports(s, d) -> DataFrame:
    """(file_path, name): an import string of every form for every target a file has."""
    e = table(s, d, "dependency_edges").select("file_path", module_name(F.col("to_module")).alias("t")).dropna().distinct()
    e = e.withColumn("p", F.explode(F.array(*map(F.lit, PREFIXES)))).withColumn("x", F.explode(F.array(*map(F.lit, SUFFIXES))))
    return e.select("file_path", F.concat("p", "t", "x").alias("name"))


def _names(s, d) -> DataFrame:
    return _imports(s, d).select("name").distinct()


def _commits(s, d) -> DataFrame:
    return table(s, d, "commits").select("repo_id", "hash", "message", "commit_ts").distinct()


def _drift(s, d) -> DataFrame:
    return table(s, d, "snapshot_frames").select("repo_id", "commit_hash", F.col("drift.total").alias("total"), F.col("drift.hub_debt").alias("hub_debt")).distinct()


def _weights(s, d) -> DataFrame:
    return table(s, d, "dependency_edges").select(F.coalesce("weight", F.lit(1)).alias("weight")).distinct()


def _lines(s, d) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines


_SQL_PATHS = "SELECT DISTINCT file_path FROM dependency_edges WHERE file_path IS NOT NULL"
_SQL_LABELS = (
    f"SELECT DISTINCT label FROM (SELECT {NAME.format('from_module')} AS label FROM dependency_edges UNION ALL SELECT {NAME.format('to_module')} FROM dependency_edges"
    f" UNION ALL SELECT {NAME.format('module_name')} FROM node_metadata) WHERE label IS NOT NULL"
)
_SQL_PAIRS = f"SELECT DISTINCT f AS from_module, t AS to_module FROM (SELECT {NAME.format('from_module')} AS f, {NAME.format('to_module')} AS t FROM dependency_edges) WHERE f IS NOT NULL AND t IS NOT NULL"


def _values(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


_SQL_IMPORTS = (
    f"SELECT file_path, p || t || x AS name FROM (SELECT file_path, t, p, unnest({_values(SUFFIXES)}) AS x FROM (SELECT file_path, t, unnest({_values(PREFIXES)}) AS p FROM"
    f" (SELECT DISTINCT file_path, {NAME.format('to_module')} AS t FROM dependency_edges) WHERE file_path IS NOT NULL AND t IS NOT NULL))"
)
_SQL_NAMES = f"SELECT DISTINCT name FROM ({_SQL_IMPORTS})"
_SQL_COMMITS = "SELECT DISTINCT repo_id, hash, message, commit_ts FROM commits"
_SQL_DRIFT = "SELECT DISTINCT repo_id, commit_hash, drift.total AS total, drift.hub_debt AS hub_debt FROM snapshot_frames"
_SQL_LINES = "SELECT doc_id, (unnest(generate_series(1, len(ls))) - 1)::INTEGER AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"


def _sql_parts(x: str) -> str:
    return f"list_filter(string_split(replace({x}, chr(92), '/'), '/'), lambda z: z <> '')"


def _sql_stem(x: str) -> str:
    return f"regexp_replace(coalesce({_sql_parts(x)}[-1], ''), '^(.+)\\.[^.]*$', '\\1')"


def sql_package(x: str, depth: int = 2) -> str:
    p = _sql_parts(x)
    dirs = f"{p}[:-2]"
    at = f"coalesce(list_position(list_transform({dirs}, lambda z: z IN ('packages', 'apps')), true), 0)"
    rest = f"(CASE WHEN {dirs}[1] IN ('src', 'lib', 'internal') THEN {dirs}[2:] ELSE {dirs} END)"
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN len({p}) <= 1 THEN {_sql_stem(x)} WHEN {at} > 0 AND {at} < len({dirs}) THEN {dirs}[{at} + 1]"
        f" WHEN len({rest}) = 0 THEN {_sql_stem(x)} ELSE array_to_string({rest}[:{depth}], '/') END)"
    )


_SQL_LANGUAGE = (
    "(CASE string_split(file_path, '.')[-1] "
    + " ".join(f"WHEN '{x}' THEN '{k}'" for k, xs in P.LANGUAGE_SUFFIXES.items() for x in xs)
    + " END)"
)
_SQL_TEST = "(" + " OR ".join(f"contains('/' || trim(replace(lower(file_path), chr(92), '/'), '/') || '/', '{f}')" for f in P.TEST_FRAGMENTS) + ")"
_SQL_IGNORED = "regexp_full_match(file_path, '(?s)" + "|".join(P.glob_regex(g) for g in P.default_ignores()) + "')"
_SQL_NOISE = (
    "(strlen(trim(name)) <= 1 OR regexp_matches(trim(name), '^(https?://|npm:|node:)') OR regexp_matches(lower(trim(name)), '\\.("
    + "|".join(P.ASSET_SUFFIXES)
    + ")$') OR (regexp_matches(trim(name), '^[0-9]') AND contains(trim(name), '.')) OR regexp_full_match(trim(name), '[0-9.]*'))"
)
_SQL_NORMAL = (
    "(CASE WHEN starts_with(trim(name), 'npm:') THEN regexp_extract(trim(name), '^npm:(@?[^@]*)', 1) WHEN starts_with(trim(name), 'node:') THEN substr(trim(name), 6) ELSE trim(name) END)"
)
_SQL_DIR = "regexp_extract(file_path, '^(.*)[/\\\\][^/\\\\]*$', 1)"
# closed forms for names with any number of leading '../', for which folding over the segments is not needed
_SQL_UPS = "len(string_split({n}, '../')) - 1"
_SQL_RELATIVE = (
    "(CASE WHEN {ups} > len({dp}) THEN NULL ELSE nullif(array_to_string(list_concat({dp}[:len({dp}) - ({ups})], list_filter(string_split(replace({n}, '../', ''), '/'), lambda z: z NOT IN ('', '.'))), '/'), '') END)"
).format(ups=_SQL_UPS.format(n="{n}"), dp=_sql_parts(_SQL_DIR), n="{n}")
_SQL_PY = (
    "(CASE WHEN greatest(length(regexp_extract({n}, '^(\\.*)', 1)) - 1, 0) > len({p}) - 1 OR len({p}) = 0 THEN NULL ELSE nullif(array_to_string(list_concat("
    "{p}[:greatest(len({p}) - 1 - greatest(length(regexp_extract({n}, '^(\\.*)', 1)) - 1, 0), 0)], list_filter(string_split(regexp_replace({n}, '^\\.*', ''), '.'), lambda z: z <> '')), '/'), '') END)"
).format(n="{n}", p=_sql_parts("file_path"))


def _sql_target() -> str:
    inner = f"SELECT file_path, name, {_SQL_NORMAL} AS n, {_SQL_NOISE} AS noise, {_SQL_LANGUAGE} AS lang, {sql_package('file_path')} AS pkg FROM ({_SQL_IMPORTS})"
    resolved = f"SELECT *, CASE WHEN lang = 'python' AND starts_with(n, '.') THEN {_SQL_PY.format(n='n')} WHEN starts_with(n, './') OR starts_with(n, '../') THEN {_SQL_RELATIVE.format(n='n')} ELSE n END AS r FROM ({inner})"
    target = f"CASE WHEN (lang = 'python' AND starts_with(n, '.')) OR contains(n, '/') THEN {sql_package('r')} ELSE n END"
    return f"SELECT file_path, name, CASE WHEN NOT noise AND n <> '' AND t <> '' AND t <> pkg THEN t END AS value FROM (SELECT *, {target} AS t FROM ({resolved}))"


def _sql_band(x: str, scale: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} <= {b} THEN '{n}'" for b, n in L.BANDS[scale][:-1]) + f" ELSE '{L.BANDS[scale][-1][1]}' END)"


_SQL_ROOT = "(CASE WHEN contains(label, '_') AND strlen(split_part(label, '_', 1)) >= 3 THEN split_part(label, '_', 1) WHEN contains(label, '-') AND strlen(split_part(label, '-', 1)) >= 3 THEN split_part(label, '-', 1) END)"


def _sql_compact(x: str) -> str:
    return f"nullif(substr(trim({x}), 1, 16), '')"


_SQL_SUFFIX = (
    "(CASE WHEN to_module = '' OR lower(to_module) = lower(from_module) THEN NULL "
    + " ".join(f"WHEN starts_with(to_module, from_module || '{s}') THEN {_sql_compact('substr(to_module, length(from_module) + 2)')}" for s in "/_-")
    + " "
    + " ".join(f"WHEN contains(to_module, '{s}') THEN {_sql_compact(chr(115) + 'tring_split(to_module, ' + repr(s) + ')[-1]')}" for s in "/_-")
    + f" ELSE {_sql_compact('to_module')} END)"
)

QUERIES, ORACLES = {}, {}


def _scalar(name: str, source, sql_source: str, value: Callable[[], Column], sql_value: str | None) -> None:
    QUERIES[name] = lambda s, d: source(s, d).withColumn("value", value())
    if sql_value is not None:
        ORACLES[name] = f"SELECT *, {sql_value} AS value FROM ({sql_source})"


for _n, _src, _sql, _v, _q in (
    ("fn_detect_language", _paths, _SQL_PATHS, lambda: P.detect_language(F.col("file_path")), _SQL_LANGUAGE),
    ("fn_package_name", _paths, _SQL_PATHS, lambda: P.package_name(F.col("file_path")), sql_package("file_path")),
    ("fn_package_name_depth1", _paths, _SQL_PATHS, lambda: P.package_name(F.col("file_path"), 1), sql_package("file_path", 1)),
    ("fn_file_stem", _paths, _SQL_PATHS, lambda: P.file_stem(F.col("file_path")), _sql_stem("file_path")),
    ("fn_is_test_path", _paths, _SQL_PATHS, lambda: P.is_test_path(F.col("file_path")), _SQL_TEST),
    ("fn_ignore_match", _paths, _SQL_PATHS, lambda: P.ignored(F.col("file_path")), _SQL_IGNORED),
    ("fn_source_dir", _paths, _SQL_PATHS, lambda: P.source_dir(F.col("file_path")), _SQL_DIR),
    ("fn_is_noise_import", _names, _SQL_NAMES, lambda: P.noise_import(F.col("name")), _SQL_NOISE),
    ("fn_normalize_import", _names, _SQL_NAMES, lambda: P.normalize_import(F.col("name")), _SQL_NORMAL),
    ("fn_is_entry_stem", _labels, _SQL_LABELS, lambda: L.is_entry_stem(F.col("label")), f"split_part(string_split(label, '/')[-1], '.', 1) IN {L.ENTRY_STEMS}"),
    ("fn_root_token", _labels, _SQL_LABELS, lambda: L.root_token(F.col("label")), _SQL_ROOT),
    ("fn_truncate", _labels, _SQL_LABELS, lambda: L.truncate(F.col("label"), 8), "CASE WHEN length(label) <= 8 THEN label ELSE substr(label, 1, 7) || '…' END"),
    ("fn_compact_label", _labels, _SQL_LABELS, lambda: L.compact_label(F.col("label")), _sql_compact("label")),
    ("fn_cluster_suffix", _pairs, _SQL_PAIRS, lambda: L.cluster_suffix(F.col("from_module"), F.col("to_module")), _SQL_SUFFIX),
    ("fn_short_hash", _commits, _SQL_COMMITS, lambda: F.left(F.col("hash"), F.lit(7)), "left(hash, 7)"),
    ("fn_first_line", _commits, _SQL_COMMITS, lambda: L.first_line(F.col("message")), "coalesce(split_part(replace(message, chr(13) || chr(10), chr(10)), chr(10), 1), '')"),
    ("fn_format_ts", _commits, _SQL_COMMITS, lambda: L.format_epoch(F.col("commit_ts")), "coalesce(strftime(make_timestamp(commit_ts * 1000000), '%Y-%m-%d %H:%M'), '?')"),
    ("rp_bands", _drift, _SQL_DRIFT, lambda: F.concat_ws("|", L.band(F.col("total"), "level"), L.band(F.col("total"), "node"), L.band(F.col("hub_debt"), "sub_score")),
     f"concat_ws('|', {_sql_band('total', 'level')}, {_sql_band('total', 'node')}, {_sql_band('hub_debt', 'sub_score')})"),
    ("rp_edge_band", _weights, "SELECT DISTINCT coalesce(weight, 1) AS weight FROM dependency_edges", lambda: L.band(F.col("weight"), "edge_weight"), _sql_band("weight", "edge_weight")),
    ("rp_health", _drift, _SQL_DRIFT, lambda: F.greatest(F.lit(0), 100 - F.col("total")), "greatest(0, 100 - total)"),
):
    _scalar(_n, _src, _sql, _v, _q)

QUERIES["flt_track_file"] = lambda s, d: _paths(s, d).where(P.tracked(F.col("file_path")))
ORACLES["flt_track_file"] = f"SELECT * FROM ({_SQL_PATHS}) WHERE NOT {_SQL_IGNORED} AND {_SQL_LANGUAGE} IS NOT NULL AND NOT {_SQL_TEST}"
QUERIES["fn_resolve_relative"] = lambda s, d: _imports(s, d).where("name LIKE './%' OR name LIKE '../%'").withColumn("value", P.resolve_relative(P.source_dir(F.col("file_path")), F.col("name")))
ORACLES["fn_resolve_relative"] = f"SELECT *, {_SQL_RELATIVE.format(n='name')} AS value FROM ({_SQL_IMPORTS}) WHERE name LIKE './%' OR name LIKE '../%'"
QUERIES["fn_resolve_python_relative"] = lambda s, d: _imports(s, d).where("name LIKE '.%'").withColumn("value", P.resolve_python_relative(F.col("file_path"), F.col("name")))
ORACLES["fn_resolve_python_relative"] = f"SELECT *, {_SQL_PY.format(n='name')} AS value FROM ({_SQL_IMPORTS}) WHERE name LIKE '.%'"
QUERIES["fn_import_target"] = lambda s, d: P.with_import_target(_imports(s, d), P.detect_language(F.col("file_path")), P.package_name(F.col("file_path")), F.col("file_path"), F.col("name"))
ORACLES["fn_import_target"] = _sql_target()
# each pair under a side of the rules chosen by the length of its names: some pairs break one
_SIDES = [sorted({r[i] for r in L.PREFIX_RULES}) for i in (0, 1)]


def _sided(s, d):
    put = lambda c, sides: F.concat(F.get(F.array(*map(F.lit, sides)), (F.length(c) % len(sides)).cast("int")), F.col(c)).alias(c)
    return _pairs(s, d).select(put("from_module", _SIDES[0]), put("to_module", _SIDES[1]))


QUERIES["fn_prefix_rule"] = lambda s, d: _sided(s, d).where(L.prefix_rule(F.col("from_module"), F.col("to_module")))
ORACLES["fn_prefix_rule"] = f"SELECT * FROM (SELECT {_SIDES[0]}[length(from_module) % {len(_SIDES[0])} + 1] || from_module AS from_module, {_SIDES[1]}[length(to_module) % {len(_SIDES[1])} + 1] || to_module AS to_module FROM ({_SQL_PAIRS})) WHERE " + " OR ".join(f"(starts_with(from_module, '{a}') AND starts_with(to_module, '{b}'))" for a, b in L.PREFIX_RULES)
QUERIES["fn_advisory_filter"] = lambda s, d: _lines(s, d).where(L.advisory(F.col("line")))
ORACLES["fn_advisory_filter"] = f"SELECT * FROM ({_SQL_LINES}) WHERE " + " OR ".join(f"contains(lower(line), '{w}')" for w in L.ADVICE_WORDS)
QUERIES["flt_label_search"] = lambda s, d: _labels(s, d).where(F.contains(F.lower("label"), F.lit("core")))
ORACLES["flt_label_search"] = f"SELECT * FROM ({_SQL_LABELS}) WHERE contains(lower(label), 'core')"
