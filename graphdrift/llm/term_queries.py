"""Queries and oracles of term frequencies."""

from __future__ import annotations

from ..plans.runtime import table
from .term_bitmaps import value_frequencies


def _frequencies(spark, d):
    return value_frequencies(table(spark, d, "dependency_edges"), table(spark, d, "node_metadata"))


QUERIES = {
    "p2_found": lambda s, d: _frequencies(s, d).where("mark IS NOT NULL").select("field_name", "term", "mark"),
    "p2_value_frequencies": _frequencies,
}

_P2 = """
WITH r AS (
  SELECT 'to_module' AS field_name, repo_id, commit_hash, nullif(trim(replace(to_module, chr(92), '/'), ' ' || chr(9)), '') AS term FROM dependency_edges
  UNION ALL SELECT 'importer_count', repo_id, commit_hash, CAST(importer_count AS VARCHAR) FROM node_metadata),
n AS (SELECT field_name, count(DISTINCT (repo_id, commit_hash)) AS n FROM r GROUP BY 1),
f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT (repo_id, commit_hash)) AS snapshots FROM r WHERE term IS NOT NULL GROUP BY 1, 2)
SELECT f.field_name, term, occurrences, snapshots,
       CASE WHEN snapshots < 3 THEN 'rare' WHEN snapshots > 0.4 * n.n THEN 'common' END AS mark
FROM f JOIN n ON n.field_name = f.field_name"""

ORACLES = {
    "p2_found": f"SELECT field_name, term, mark FROM ({_P2}) WHERE mark IS NOT NULL",
    "p2_value_frequencies": _P2,
}
