"""Queries and oracles of file states and of snapshots rebuilt from checkpoints and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import file_path, module_name
from ..operators import state_ops
from ..operators import snapshots as snap
from . import state_sql
from .model import duck, edges, frames, nodes
from .runtime import cut, lookup, table


def import_rows(s, d):
    """(repo_id, commit_hash, path, package_name, module_name, weight): imports of files as stored."""
    e = table(s, d, "dependency_edges").select(
        "repo_id", "commit_hash", file_path(F.col("file_path")).alias("path"), module_name(F.col("from_module")).alias("package_name"),
        module_name(F.col("to_module")).alias("module_name"), F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"),
    )
    return e.dropna()


def blobs(s, d):
    return table(s, d, "source_files").select("repo_id", file_path(F.col("file_path")).alias("path"), "blob_oid")


IMPORT, PATH = ["path", "package_name", "module_name"], ["path"]
EDGE, NODE = ["from_module", "to_module"], ["module_name"]


def file_rows(s, d):
    """One row (repo_id, frame_no, path, package_name, module_name, weight) for each import of a file in a frame."""
    at = snap.numbered(frames(s, d)).select("repo_id", "commit_hash", "frame_no")
    rows = import_rows(s, d).join(lookup(cut(at)), ["repo_id", "commit_hash"])
    return cut(rows.groupBy("repo_id", "frame_no", *IMPORT).agg(F.max("weight").alias("weight")))


def _frames_no(s, d):
    return cut(snap.numbered(frames(s, d)))


def _held(rows):
    """Frames that have rows, numbered as in rows; the last one is the end of what is known."""
    return rows.groupBy("repo_id").agg(F.max("frame_no").alias("n_frames")).withColumn("frame_no", F.explode(F.sequence(F.lit(1), "n_frames"))).withColumn("commit_hash", F.lit(""))


def _rebuilt(rows, frames_no, key, value):
    """The state of every frame, put together from checkpoints and deltas only."""
    segs = cut(snap.segments(frames_no))
    at = segs.where("frame_no = checkpoint").select("repo_id", "frame_no")
    return snap.rebuild(cut(rows.join(at, ["repo_id", "frame_no"])), cut(snap.deltas(rows, frames_no, key, value)), segs, key, value)


def _file_versions(s, d):
    """(repo_id, frame_no, path, op): files whose imports differ from those of the frame before."""
    rows = file_rows(s, d)
    imports = rows.groupBy("repo_id", "frame_no", "path").agg(F.array_sort(F.collect_list(F.struct("package_name", "module_name", "weight"))).alias("imports"))
    return snap.deltas(imports, _held(rows), PATH, ["imports"]).select("repo_id", "frame_no", "path", "op")


def _blob_lookup(s, d):
    return _file_versions(s, d).where("op = 'upsert'").join(blobs(s, d), ["repo_id", "path"]).select("repo_id", "frame_no", "path", "blob_oid")


def _as_of(s, d):
    rows = file_rows(s, d)
    return _rebuilt(rows, _held(rows), IMPORT, ["weight"])


def _applied(s, d):
    rows = file_rows(s, d)
    held = cut(_held(rows))
    return snap.apply_deltas(rows, snap.deltas(rows, held, IMPORT, ["weight"]), held, IMPORT, ["weight"])


def _framed(df, frames_no):
    at = frames_no.select(F.concat_ws("@", "repo_id", "commit_hash").alias("snapshot_id"), "repo_id", "frame_no")
    return df.join(lookup(at), "snapshot_id").drop("snapshot_id")


def _named(df, frames_no):
    at = frames_no.select(F.concat_ws("@", "repo_id", "commit_hash").alias("snapshot_id"), "repo_id", "frame_no")
    return df.join(lookup(at), ["repo_id", "frame_no"]).drop("repo_id", "frame_no")


def snapshot_edges(s, d):
    """(snapshot_id, from_module, to_module, weight) of every frame, rebuilt from checkpoints and deltas."""
    at = _frames_no(s, d)
    return _named(_rebuilt(cut(_framed(edges(s, d), at)), at, EDGE, ["weight"]), at)


def snapshot_nodes(s, d):
    at = _frames_no(s, d)
    value = ["is_internal", "importer_count"]
    return _named(_rebuilt(cut(_framed(nodes(s, d), at)), at, NODE, value), at)


def _loaded(s, d):
    """(snapshot_id, n_nodes, n_edges, weight, state): what is rebuilt of each frame; 'empty', 'differs' from the stored counts, or
    'loaded'."""
    e = snapshot_edges(s, d).groupBy("snapshot_id").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))
    n = snapshot_nodes(s, d).groupBy("snapshot_id").agg(F.count("*").alias("n_nodes"))
    out = frames(s, d).select("snapshot_id", "node_count", "edge_count").join(n, "snapshot_id", "left").join(e, "snapshot_id", "left").fillna(0, ["n_nodes", "n_edges", "weight"])
    same = F.col("n_nodes").eqNullSafe(F.col("node_count")) & F.col("n_edges").eqNullSafe(F.col("edge_count"))
    state = F.when((F.col("n_nodes") == 0) & (F.col("n_edges") == 0), "empty").when(same, "loaded").otherwise("differs")
    return out.select("snapshot_id", "n_nodes", "n_edges", "weight", state.alias("state"))


def stored_state(s, d, last_only=False):
    """(repo_id, commit_hash, scan_order, path, package_name, module_name, weight) of the frames whose whole state is stored."""
    fr = frames(s, d)
    at = snap.segments(snap.numbered(fr)).where("frame_no = checkpoint" + (" AND next_checkpoint = frame_no + 1" if last_only else ""))
    if last_only:
        at = at.join(snap.numbered(fr).where("frame_no = n_frames").select("repo_id", "frame_no"), ["repo_id", "frame_no"])
    order = fr.select("repo_id", "commit_hash", "scan_order")
    return file_rows(s, d).join(cut(at.select("repo_id", "frame_no", "commit_hash")), ["repo_id", "frame_no"]).join(order, ["repo_id", "commit_hash"]).drop("frame_no")


_N = "nullif(trim(replace({}, chr(92), '/'), ' ' || chr(9)), '')"
_P = "regexp_replace(replace(file_path, chr(92), '/'), '^\\./', '')"
_SQL = {
    "import_rows": f"SELECT * FROM (SELECT repo_id, commit_hash, {_P} AS path, {_N.format('from_module')} AS package_name, {_N.format('to_module')} AS module_name, coalesce(weight, 1)::BIGINT AS weight FROM dependency_edges) WHERE repo_id IS NOT NULL AND commit_hash IS NOT NULL AND path IS NOT NULL AND package_name IS NOT NULL AND module_name IS NOT NULL",
    "blobs": f"SELECT repo_id, {_P} AS path, blob_oid FROM source_files",
    "file_rows": state_sql.FILE_ROWS,
}


QUERIES = {n: (lambda s, d, f=f: f(file_rows(s, d))) for n, f in state_ops.OPS.items()}
QUERIES |= {
    "src_tree_diff": _file_versions,
    "src_blob_lookup": _blob_lookup,
    "st_file_versions": lambda s, d: snap.versions(_file_versions(s, d), PATH),
    "st_state_as_of": _as_of,
    "st_apply_delta": _applied,
    "st_fallback_internal": lambda s, d: state_ops.fallback_internal(edges(s, d), nodes(s, d)),
    "q_snapshot": snapshot_edges,
    "q_snapshot_nodes": snapshot_nodes,
    "q_load_snapshots": _loaded,
}
_COUNTS = """SELECT f.snapshot_id, coalesce(n.n, 0) AS n_nodes, coalesce(e.n, 0) AS n_edges, coalesce(e.w, 0)::BIGINT AS weight, f.node_count, f.edge_count FROM {frames} f
  LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM {nodes} GROUP BY 1) n ON n.snapshot_id = f.snapshot_id LEFT JOIN (SELECT snapshot_id, count(*) AS n, sum(weight) AS w FROM {edges} GROUP BY 1) e ON e.snapshot_id = f.snapshot_id"""
_STATE = {n: t for n, t in state_sql.OPS.items() if n in QUERIES} | {
    "q_snapshot": "SELECT e.* FROM {edges} e JOIN {frames} f ON f.snapshot_id = e.snapshot_id",
    "q_snapshot_nodes": "SELECT n.* FROM {nodes} n JOIN {frames} f ON f.snapshot_id = n.snapshot_id",
    "q_load_snapshots": f"SELECT snapshot_id, n_nodes, n_edges, weight, CASE WHEN n_nodes = 0 AND n_edges = 0 THEN 'empty' WHEN n_nodes IS NOT DISTINCT FROM node_count AND n_edges IS NOT DISTINCT FROM edge_count THEN 'loaded' ELSE 'differs' END AS state FROM ({_COUNTS}) c",
}
ORACLES = {n: duck(t, **_SQL) for n, t in _STATE.items()}
