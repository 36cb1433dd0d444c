"""Queries and oracles of the general data operators: snapshot changes and skewed module totals."""

from __future__ import annotations

from ..operators.module_load import hot_modules, module_totals
from ..operators.snapshot_diff import snapshot_changes
from .runtime import table

NAME = "nullif(trim(replace({}, chr(92), '/'), ' ' || chr(9)), '')"


def _changes(spark, d):
    return snapshot_changes(table(spark, d, "dependency_edges"), table(spark, d, "snapshot_frames"))


QUERIES = {
    "p3_found": lambda s, d: _changes(s, d).select("repo_id", "commit_hash", "from_module", "to_module", "change_kind"),
    "p3_changes_weighted": lambda s, d: _changes(s, d),
    "p4_found": lambda s, d: hot_modules(table(s, d, "dependency_edges"), table(s, d, "node_metadata")),
    "p4_module_totals": lambda s, d: module_totals(table(s, d, "dependency_edges"), table(s, d, "node_metadata")),
}

_P3 = f"""
WITH fr AS (SELECT repo_id, commit_hash, min(scan_order) AS scan_order FROM snapshot_frames GROUP BY 1, 2),
ln AS (SELECT repo_id, commit_hash, lag(commit_hash) OVER w AS prev FROM fr WINDOW w AS (PARTITION BY repo_id ORDER BY scan_order, commit_hash)),
e0 AS (SELECT repo_id, commit_hash, {NAME.format('from_module')} AS f, {NAME.format('to_module')} AS t, coalesce(weight, 1) AS w, delivered_at FROM dependency_edges),
e AS (SELECT repo_id, commit_hash, f, t, w FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, commit_hash, f, t ORDER BY delivered_at DESC NULLS LAST, w DESC) AS rn
      FROM e0 WHERE f IS NOT NULL AND t IS NOT NULL) WHERE rn = 1),
cur AS (SELECT l.repo_id, l.commit_hash, f, t, w FROM ln l JOIN e ON e.repo_id = l.repo_id AND e.commit_hash = l.commit_hash WHERE prev IS NOT NULL),
old AS (SELECT l.repo_id, l.commit_hash, f, t, w FROM ln l JOIN e ON e.repo_id = l.repo_id AND e.commit_hash = l.prev)
SELECT coalesce(c.repo_id, o.repo_id) AS repo_id, coalesce(c.commit_hash, o.commit_hash) AS commit_hash,
       coalesce(c.f, o.f) AS from_module, coalesce(c.t, o.t) AS to_module,
       CASE WHEN o.w IS NULL THEN 'added' WHEN c.w IS NULL THEN 'removed' ELSE 'changed' END AS change_kind{{}}
FROM cur c FULL JOIN old o ON c.repo_id = o.repo_id AND c.commit_hash = o.commit_hash AND c.f = o.f AND c.t = o.t
WHERE c.w IS DISTINCT FROM o.w"""

_P4 = f"""
WITH n AS (SELECT {NAME.format('module_name')} AS m, count(*) AS n_nodes, count(*) FILTER (node_kind = 'internal') AS n_internal FROM node_metadata GROUP BY 1),
e AS (SELECT {NAME.format('to_module')} AS to_module, count(*) AS row_count, sum(coalesce(weight, 1))::BIGINT AS total_weight FROM dependency_edges GROUP BY 1)
SELECT to_module, row_count, total_weight, coalesce(n_nodes, 0)::BIGINT AS n_nodes, coalesce(n_internal, 0)::BIGINT AS n_internal
FROM e LEFT JOIN n ON n.m = e.to_module WHERE to_module IS NOT NULL"""

ORACLES = {
    "p3_found": _P3.format(""),
    "p3_changes_weighted": _P3.format(", o.w::BIGINT AS old_weight, c.w::BIGINT AS new_weight"),
    "p4_found": f"SELECT to_module FROM ({_P4}) WHERE row_count > 0.02 * (SELECT sum(row_count) FROM ({_P4}))",
    "p4_module_totals": _P4,
}
