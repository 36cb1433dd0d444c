"""The model's base relations as DataFrames and as SQL, and operators written once as SQL text over them.

An operator text names its inputs in braces, e.g. {edges}. `run` binds them to DataFrames for Spark, `duck` prefixes the
text with the same relations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import module_name
from ..operators.snapshot_diff import current_edges, named_edges
from .runtime import table


def snapshot_id() -> F.Column:
    return F.concat_ws("@", "repo_id", "commit_hash")


def edges(s: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, from_module, to_module, weight): the weighted graph of each snapshot without self-edges."""
    rows = current_edges(table(s, d, "dependency_edges")).where("from_module != to_module")
    return rows.select(snapshot_id().alias("snapshot_id"), "from_module", "to_module", "weight")


def deliveries(s: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, from_module, to_module, delivery) of each stored edge, repeated ones and self-edges too; of an edge's deliveries
    the greatest counts."""
    return named_edges(table(s, d, "dependency_edges")).select(snapshot_id().alias("snapshot_id"), "from_module", "to_module", "delivery")


def links(s: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, from_module, to_module) of each stored edge: repeated ones and self-edges too, which edges leaves out."""
    e = table(s, d, "dependency_edges").where("repo_id IS NOT NULL AND commit_hash IS NOT NULL")
    named = e.select(snapshot_id().alias("snapshot_id"), module_name(F.col("from_module")).alias("from_module"), module_name(F.col("to_module")).alias("to_module"))
    return named.where("from_module IS NOT NULL AND to_module IS NOT NULL")


def modules(s: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, module_name) of each stored module; with the ends of links these are the rows of nodes."""
    n = table(s, d, "node_metadata").where("repo_id IS NOT NULL AND commit_hash IS NOT NULL")
    return n.select(snapshot_id().alias("snapshot_id"), module_name(F.col("module_name")).alias("module_name")).where("module_name IS NOT NULL")


def nodes(s: SparkSession, d: str) -> DataFrame:
    """(snapshot_id, module_name, is_internal, importer_count): stored modules and ends of edges of each snapshot."""
    e = table(s, d, "dependency_edges").where("repo_id IS NOT NULL AND commit_hash IS NOT NULL")
    both = (module_name(F.col("from_module")).isNotNull()) & (module_name(F.col("to_module")).isNotNull())
    ends = e.where(both).select(snapshot_id().alias("snapshot_id"), F.explode(F.array(
        F.struct(module_name(F.col("from_module")).alias("m"), F.lit(1).alias("i")), F.struct(module_name(F.col("to_module")).alias("m"), F.lit(0).alias("i"))
    )).alias("x"))
    stored = table(s, d, "node_metadata").where("repo_id IS NOT NULL AND commit_hash IS NOT NULL").select(
        snapshot_id().alias("snapshot_id"), module_name(F.col("module_name")).alias("module_name"),
        F.when(F.col("node_kind") == "internal", 1).otherwise(0).alias("internal"), "importer_count",
    )
    rows = stored.unionByName(
        ends.select("snapshot_id", F.col("x.m").alias("module_name"), F.col("x.i").alias("internal"), F.lit(None).cast("bigint").alias("importer_count"))
    )
    return (
        rows.where("module_name IS NOT NULL")
        .groupBy("snapshot_id", "module_name")
        .agg((F.max("internal") == 1).alias("is_internal"), F.max("importer_count").alias("importer_count"))
    )


_DRIFT = ("total", "fan_in_delta", "fan_out_delta", "new_cycles", "boundary_violations", "layering_violations", "cycle_debt", "layering_debt", "hub_debt", "coupling_debt", "cognitive_debt", "instability_debt")
_META = ("external_min_importers", "included_external_count", "filtered_external_count")
_FRAME = ("repo_id", "commit_hash", "scan_order", "frame_ts", "node_count", "edge_count", "analysis_version", "config_fingerprint", "has_full_artifacts")


def frames(s: SparkSession, d: str) -> DataFrame:
    """One row per stored frame; of repeated rows the latest ingested."""
    f = table(s, d, "snapshot_frames").where("repo_id IS NOT NULL AND commit_hash IS NOT NULL AND scan_order IS NOT NULL")
    flat = f.select(
        *_FRAME, "ingested_at", F.col("drift").isNotNull().alias("has_drift"), F.col("scan_metadata").isNotNull().alias("has_metadata"),
        *[F.col(f"drift.{c}").alias(c) for c in _DRIFT], *[F.col(f"scan_metadata.{c}").alias(c) for c in _META],
    )
    rest = [c for c in flat.columns if c not in ("repo_id", "commit_hash", "ingested_at")]
    best = flat.groupBy("repo_id", "commit_hash").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", *rest)).alias("r"))
    return best.select("repo_id", "commit_hash", snapshot_id().alias("snapshot_id"), "r.*")


def commit_rows(s: SparkSession, d: str) -> DataFrame:
    """One row per commit; of repeated rows the latest ingested. Undecodable authors are unknown."""
    c = table(s, d, "commits").where("repo_id IS NOT NULL AND hash IS NOT NULL")
    rest = ("scan_order", "author_name", "author_email", "message", "commit_ts", "tree_id")
    best = c.groupBy("repo_id", "hash").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", *rest)).alias("r"))
    return best.select("repo_id", "hash", "r.*")


NAME = "nullif(trim(replace({}, chr(92), '/'), ' ' || chr(9)), '')"
_E0 = f"SELECT repo_id || '@' || commit_hash AS snapshot_id, {NAME.format('from_module')} AS from_module, {NAME.format('to_module')} AS to_module, coalesce(weight, 1)::BIGINT AS weight, delivered_at FROM dependency_edges WHERE repo_id IS NOT NULL AND commit_hash IS NOT NULL"
_ROW = "row_number() OVER (PARTITION BY {} ORDER BY ingested_at DESC)"
SQL = {
    "edges": f"SELECT snapshot_id, from_module, to_module, weight FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, from_module, to_module ORDER BY delivered_at DESC NULLS LAST, weight DESC) AS rn FROM ({_E0}) WHERE from_module IS NOT NULL AND to_module IS NOT NULL) WHERE rn = 1 AND from_module <> to_module",
    "nodes": f"SELECT snapshot_id, module_name, max(internal) = 1 AS is_internal, max(importer_count) AS importer_count FROM (SELECT repo_id || '@' || commit_hash AS snapshot_id, {NAME.format('module_name')} AS module_name, CASE WHEN node_kind = 'internal' THEN 1 ELSE 0 END AS internal, importer_count FROM node_metadata UNION ALL SELECT snapshot_id, from_module, 1, NULL FROM ({_E0}) WHERE from_module IS NOT NULL AND to_module IS NOT NULL UNION ALL SELECT snapshot_id, to_module, 0, NULL FROM ({_E0}) WHERE from_module IS NOT NULL AND to_module IS NOT NULL) WHERE module_name IS NOT NULL GROUP BY 1, 2",
    "frames": f"SELECT repo_id, commit_hash, repo_id || '@' || commit_hash AS snapshot_id, {', '.join(_FRAME[2:])}, has_drift, has_metadata, {', '.join(_DRIFT + _META)} FROM (SELECT {', '.join(_FRAME)}, drift IS NOT NULL AS has_drift, scan_metadata IS NOT NULL AS has_metadata, {', '.join(f'drift.{c} AS {c}' for c in _DRIFT)}, {', '.join(f'scan_metadata.{c} AS {c}' for c in _META)}, {_ROW.format('repo_id, commit_hash')} AS rn FROM snapshot_frames WHERE scan_order IS NOT NULL) WHERE rn = 1",
    "commit_rows": f"SELECT repo_id, hash, scan_order, author_name, author_email, message, commit_ts, tree_id FROM (SELECT *, {_ROW.format('repo_id, hash')} AS rn FROM commits) WHERE rn = 1",
}
BASE = {"edges": edges, "nodes": nodes, "frames": frames, "commit_rows": commit_rows}


#: Recursive relations of oracles that keep one row for each key.
KEYED = {
    "walk": "(snapshot_id, target, node, dist) USING KEY (snapshot_id, target, node)",
    "without": "(snapshot_id, gone, node, label) USING KEY (snapshot_id, gone, node)",
}


def _names(text: str, known) -> list[str]:
    return [n for n in known if "{" + n + "}" in text]


def run(s: SparkSession, d: str, text: str, **more: DataFrame) -> DataFrame:
    """The operator text over the base relations of a data directory and the given ones."""
    args = {n: f(s, d) for n, f in BASE.items() if n in _names(text, BASE) and n not in more} | {n: more[n] for n in _names(text, more)}
    return s.sql(text, **args)


def duck(text: str, **more: str) -> str:
    """The same text as one DuckDB statement; `more` has the SQL of further relations, each over those before it."""
    used, todo = {}, [text]
    while todo:
        t = todo.pop()
        for n in _names(t, SQL | more):
            if n not in used:
                used[n] = more.get(n) or SQL[n]
                todo.append(used[n])
    order = [n for n in [*SQL, *more] if n in used]
    ctes = ", ".join(f"{n}{KEYED.get(n, '')} AS ({used[n]})" for n in order)
    for n in order:
        text, ctes = text.replace("{" + n + "}", n), ctes.replace("{" + n + "}", n)
    text = text.strip()
    return f"WITH RECURSIVE {ctes}, {text[5:]}" if text.startswith("WITH ") else f"WITH RECURSIVE {ctes} {text}"
