"""Queries and oracles of globs, families, snapshots as a whole, the report and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.names import file_path
from ..functions.paths import globs_regex
from ..sources.store import SCHEMAS, Store
from .model import duck, frames
from .runtime import ensure_checkpoint_dir, table
from .scalars import _SQL_LABELS, _labels
from .state import _SQL as STATE_SQL
from .state import stored_state

GLOBS = ("trace/**", "*core*", "{src,reader}/*", "p?l*")
#: name, globs, priority: of the matching families the one with the highest priority, then most globs, then the first counts.
FAMILIES = (("tracing", ("trace/**", "*/trace*"), 1), ("base", ("core*", "std*", "log*"), 2), ("short", ("????",), 0), ("all_core", ("*core*",), 2))
ALIASES = {"core": "Core", "stdkit": "Standard kit"}

def _ordered_families():
    return [FAMILIES[i] for i in sorted(range(len(FAMILIES)), key=lambda i: (-FAMILIES[i][2], -len(FAMILIES[i][1]), i))]


def _family(c):
    out = None
    for name, globs, _ in _ordered_families():
        cond = c.rlike(globs_regex(globs))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def _rx(globs) -> str:
    return globs_regex(globs).removeprefix("^").removesuffix("$")


_SQL_FAMILY = "CASE " + " ".join(f"WHEN regexp_full_match(label, '{_rx(g)}') THEN '{n}'" for n, g, _ in _ordered_families()) + " END"
_SQL_ALIAS = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE label END"


def _alias(c):
    out = None
    for k, v in ALIASES.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(c)


def _store(s) -> Store:
    ensure_checkpoint_dir(s)
    folder = s.sparkContext._jsc.sc().getCheckpointDir().get()
    return Store(s, f"{folder}/store-{uuid.uuid4().hex}")


def _sink(name, rows, version=None):
    def query(s, d):
        st = _store(s)
        st.upsert(name, rows(s, d), version)
        return st.read(name)

    return query


def _stored_commits(s, d):
    t = table(s, d, "commits").where("repo_id IS NOT NULL AND hash IS NOT NULL")
    cols = ["scan_order", "author_name", "author_email", "message", "commit_ts", "tree_id"]
    return t.groupBy("repo_id", "hash").agg(F.max_by(F.struct(*cols), F.struct("ingested_at", *cols)).alias("r")).select("repo_id", "hash", "r.*")


def _repositories(s, d):
    st = _store(s)
    st.insert_absent("repositories", table(s, d, "repositories"))
    st.insert_absent("repositories", table(s, d, "repositories").withColumn("repo_root", F.lit("later")))
    return st.read("repositories")


def _subtrees(s, d):
    """The files of each repository's newest tree, kept and read back; a tree of another version is not."""
    st, c = _store(s), _stored_commits(s, d)
    last = c.groupBy("repo_id").agg(F.max_by("tree_id", F.struct("scan_order", "hash")).alias("tree_id"))
    files = table(s, d, "source_files").where("blob_oid IS NOT NULL").select("repo_id", file_path(F.col("file_path")).alias("path"), "blob_oid")
    st.save_subtrees(last.join(files, "repo_id").select("repo_id", "tree_id", "path", "blob_oid"))
    stale = s.createDataFrame([("r", "abcdef0", "a.py", "abcdef1", 0, "old")], SCHEMAS["subtrees"])
    st.upsert("subtrees", stale)
    return st.load_subtrees()


QUERIES = {
    "fn_glob_match": lambda s, d: _labels(s, d).where(F.col("label").rlike(globs_regex(GLOBS))),
    "fn_family_match": lambda s, d: _labels(s, d).withColumn("value", _family(F.col("label"))),
    "fn_alias": lambda s, d: _labels(s, d).withColumn("value", _alias(F.col("label"))),
    "fn_fingerprint": lambda s, d: frames(s, d).select("repo_id", "commit_hash", F.get_json_object("config_fingerprint", "$.scan.package_depth").cast("int").alias("package_depth")),
    "sink_commit": _sink("commits", _stored_commits),
    "sink_frame": _sink("frames", lambda s, d: frames(s, d)),
    "sink_repository": _repositories,
    "sink_subtree_cache": _subtrees,
    "sink_scan_state": _sink("scan_state", lambda s, d: stored_state(s, d, last_only=True)),
    "sink_checkpoint": _sink("checkpoints", stored_state),
}
_HELD = """SELECT r.repo_id, o.commit_hash, o.scan_order, r.path, r.package_name, r.module_name, r.weight, o.k, o.n FROM {file_rows} r JOIN (
  SELECT repo_id, commit_hash, scan_order, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS k, count(*) OVER (PARTITION BY repo_id) AS n FROM {frames}) o ON o.repo_id = r.repo_id AND o.k = r.frame_no"""
ORACLES = {
    "fn_glob_match": f"SELECT * FROM ({_SQL_LABELS}) WHERE regexp_full_match(label, '{_rx(GLOBS)}')",
    "fn_family_match": f"SELECT label, {_SQL_FAMILY} AS value FROM ({_SQL_LABELS})",
    "fn_alias": f"SELECT label, {_SQL_ALIAS} AS value FROM ({_SQL_LABELS})",
    "fn_fingerprint": duck("SELECT repo_id, commit_hash, TRY_CAST(json_extract_string(nullif(config_fingerprint, ''), '$.scan.package_depth') AS INTEGER) AS package_depth FROM {frames}"),
    "sink_commit": duck("SELECT repo_id, hash, scan_order, author_name, author_email, message, commit_ts, tree_id FROM {commit_rows}"),
    "sink_frame": duck("SELECT repo_id, commit_hash, scan_order, frame_ts, node_count, edge_count, analysis_version, config_fingerprint, total FROM {frames}"),
    "sink_repository": "SELECT repo_id, repo_root FROM repositories",
    "sink_subtree_cache": duck("SELECT c.repo_id, c.tree_id, regexp_replace(replace(f.file_path, chr(92), '/'), '^\\./', '') AS path, f.blob_oid FROM (SELECT repo_id, tree_id, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order DESC, hash DESC) AS k FROM {commit_rows}) c JOIN source_files f ON f.repo_id = c.repo_id WHERE c.k = 1 AND f.blob_oid IS NOT NULL"),
    "sink_scan_state": duck(f"SELECT repo_id, commit_hash, path, package_name, module_name, weight FROM ({_HELD}) x WHERE k = n", **STATE_SQL),
    "sink_checkpoint": duck(f"SELECT repo_id, commit_hash, scan_order, path, package_name, module_name, weight FROM ({_HELD}) x WHERE k = 1 OR k = n OR k % 20 = 0", **STATE_SQL),
}
