"""DuckDB counterparts of file states, versions and their projection to a graph, as SQL text over {file_rows} and {frames}.

{file_rows} has one row (repo_id, frame_no, path, package_name, module_name, weight) for each import of a file in a frame;
frame_no counts a repository's frames from 1. A file's version is valid from the frame it changed in up to the next change.
"""

from __future__ import annotations

from ..functions.labels import FIXED_PREFIXES, FIXED_ROOTS

MIN_IMPORTERS, SAMPLES, FILTERED = 3, 5, 10

FILE_ROWS = """SELECT f.repo_id, f.frame_no, x.path, x.package_name, x.module_name, max(x.weight) AS weight
  FROM (SELECT repo_id, commit_hash, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS frame_no FROM {frames}) f
  JOIN {import_rows} x ON x.repo_id = f.repo_id AND x.commit_hash = f.commit_hash GROUP BY 1, 2, 3, 4, 5"""
_PATHS = "SELECT DISTINCT repo_id, frame_no, path FROM {file_rows}"
_STEP = "SELECT repo_id, frame_no + 1 AS frame_no, path, package_name, module_name, weight FROM {file_rows}"
_LAST = "SELECT repo_id, max(frame_no) AS n FROM {file_rows} GROUP BY 1"
CHANGES = f"""SELECT d.repo_id, d.frame_no, d.path, CASE WHEN p.path IS NULL THEN 'delete' ELSE 'upsert' END AS op
  FROM (SELECT DISTINCT repo_id, frame_no, path FROM (
      (SELECT repo_id, frame_no, path, package_name, module_name, weight FROM {{file_rows}} EXCEPT {_STEP})
      UNION ALL ({_STEP} EXCEPT SELECT repo_id, frame_no, path, package_name, module_name, weight FROM {{file_rows}})) u) d
  JOIN ({_LAST}) l ON l.repo_id = d.repo_id AND d.frame_no <= l.n
  LEFT JOIN ({_PATHS}) p ON p.repo_id = d.repo_id AND p.frame_no = d.frame_no AND p.path = d.path"""
VERSIONS = f"""SELECT repo_id, path, valid_from, valid_to FROM (
  SELECT repo_id, path, op, frame_no AS valid_from, lead(frame_no) OVER (PARTITION BY repo_id, path ORDER BY frame_no) AS valid_to FROM ({CHANGES}) c) v WHERE op = 'upsert'"""
INTERNAL = "SELECT repo_id, frame_no, package_name AS module_name, count(DISTINCT path) AS n_files FROM {file_rows} GROUP BY 1, 2, 3"
WEIGHTS = "SELECT repo_id, frame_no, package_name AS from_module, module_name AS to_module, CAST(sum(weight) AS BIGINT) AS weight FROM {file_rows} GROUP BY 1, 2, 3, 4"
IMPORTERS = "SELECT repo_id, frame_no, module_name, count(DISTINCT package_name) AS importer_count FROM {file_rows} GROUP BY 1, 2, 3"
EXTERNAL = f"SELECT t.repo_id, t.frame_no, t.module_name, t.importer_count FROM ({IMPORTERS}) t LEFT JOIN ({INTERNAL}) i ON i.repo_id = t.repo_id AND i.frame_no = t.frame_no AND i.module_name = t.module_name WHERE i.module_name IS NULL"
VISIBLE = f"SELECT * FROM ({EXTERNAL}) e WHERE importer_count >= {MIN_IMPORTERS}"
KEPT = f"SELECT repo_id, frame_no, module_name FROM ({INTERNAL}) i UNION ALL SELECT repo_id, frame_no, module_name FROM ({VISIBLE}) v"

FALLBACK = "contains(module_name, '/') OR module_name IN (" + ", ".join(f"'{r}'" for r in FIXED_ROOTS) + ")" + "".join(f" OR starts_with(module_name, '{p}')" for p in FIXED_PREFIXES)
OPS = {
    "src_tree_diff": CHANGES,
    "src_blob_lookup": f"SELECT c.repo_id, c.frame_no, c.path, s.blob_oid FROM ({CHANGES}) c JOIN {{blobs}} s ON s.repo_id = c.repo_id AND s.path = c.path WHERE c.op = 'upsert'",
    "st_file_versions": VERSIONS,
    "st_state_as_of": "SELECT repo_id, frame_no, path, package_name, module_name, weight FROM {file_rows}",
    "st_apply_delta": "SELECT repo_id, frame_no, path, package_name, module_name, weight FROM {file_rows} r WHERE frame_no > 1",
    "st_internal_nodes": INTERNAL,
    "st_edge_weights": WEIGHTS,
    "st_edge_samples": f"SELECT repo_id, frame_no, from_module, to_module, rank, path FROM (SELECT repo_id, frame_no, package_name AS from_module, module_name AS to_module, path, row_number() OVER (PARTITION BY repo_id, frame_no, package_name, module_name ORDER BY path) AS rank FROM (SELECT DISTINCT repo_id, frame_no, package_name, module_name, path FROM {{file_rows}}) p) r WHERE rank <= {SAMPLES}",
    "st_target_importers": IMPORTERS,
    "st_visible_external": VISIBLE,
    "st_project": f"SELECT w.repo_id, w.frame_no, w.from_module, w.to_module, w.weight FROM ({WEIGHTS}) w JOIN ({KEPT}) a ON a.repo_id = w.repo_id AND a.frame_no = w.frame_no AND a.module_name = w.from_module JOIN ({KEPT}) b ON b.repo_id = w.repo_id AND b.frame_no = w.frame_no AND b.module_name = w.to_module WHERE w.weight > 0 AND w.from_module <> w.to_module",
    "st_project_nodes": KEPT,
    "st_node_metadata": f"SELECT repo_id, frame_no, module_name, 'internal' AS node_kind, CAST(NULL AS BIGINT) AS importer_count FROM ({INTERNAL}) i UNION ALL SELECT repo_id, frame_no, module_name, 'external', importer_count FROM ({VISIBLE}) v",
    "st_scan_metadata": f"SELECT repo_id, frame_no, {MIN_IMPORTERS} AS external_min_importers, count_if(importer_count >= {MIN_IMPORTERS}) AS included_external_count, count_if(importer_count < {MIN_IMPORTERS}) AS filtered_external_count FROM ({EXTERNAL}) e GROUP BY 1, 2",
    "st_filtered_samples": f"SELECT repo_id, frame_no, module_name, importer_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, frame_no ORDER BY importer_count DESC, module_name) AS rank FROM ({EXTERNAL}) e WHERE importer_count < {MIN_IMPORTERS}) r WHERE rank <= {FILTERED}",
    "st_incremental": f"""WITH signed AS (
          SELECT repo_id, frame_no, package_name, module_name, weight FROM {{file_rows}}
          UNION ALL SELECT r.repo_id, r.frame_no + 1, r.package_name, r.module_name, -r.weight FROM {{file_rows}} r JOIN ({_LAST}) l ON l.repo_id = r.repo_id AND r.frame_no < l.n),
        delta AS (SELECT repo_id, frame_no, package_name, module_name, CAST(sum(weight) AS BIGINT) AS change FROM signed GROUP BY 1, 2, 3, 4)
        SELECT repo_id, frame_no, package_name AS from_module, module_name AS to_module, change, CAST(sum(change) OVER (PARTITION BY repo_id, package_name, module_name ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS weight FROM delta""",
    "st_fallback_internal": "SELECT DISTINCT snapshot_id, module_name FROM (SELECT snapshot_id, from_module AS module_name FROM {edges} UNION ALL SELECT snapshot_id, module_name FROM {nodes} WHERE " + FALLBACK + ") u",
    "ext_target_counts": "SELECT repo_id, frame_no, path, package_name, count(*) AS n_targets, CAST(sum(weight) AS BIGINT) AS n_imports FROM {file_rows} GROUP BY 1, 2, 3, 4",
}
