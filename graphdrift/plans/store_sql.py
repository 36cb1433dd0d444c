"""DuckDB counterparts of the store queries, as SQL text over {frames} and {commit_rows}; all repositories at once.

Lists are newest first by scan_order and cut per repository by the feature's own top-k (`P`). Empty tables give no rows.
"""

from __future__ import annotations

LIST_LIMIT, TREND_LIMIT, PREVIOUS_LIMIT, SAMPLES = 10, 20, 3, 20
_NEWEST = "row_number() OVER (PARTITION BY f.repo_id ORDER BY f.scan_order DESC, f.commit_hash DESC)"

OPS = {
    "q_list_graphs": f"""
        SELECT repo_id, commit_hash, scan_order, node_count, edge_count, author_name, message, frame_ts FROM (
          SELECT f.repo_id, f.commit_hash, f.scan_order, f.node_count, f.edge_count, c.author_name, c.message, f.frame_ts, {_NEWEST} AS rn
          FROM {{frames}} f JOIN {{commit_rows}} c ON c.repo_id = f.repo_id AND c.hash = f.commit_hash) WHERE rn <= {LIST_LIMIT}""",
    "q_drift_trend": f"""
        WITH shown AS (SELECT * FROM (SELECT f.repo_id, f.commit_hash, f.scan_order, f.total, {_NEWEST} AS rn
          FROM {{frames}} f JOIN {{commit_rows}} c ON c.repo_id = f.repo_id AND c.hash = f.commit_hash) WHERE rn <= {TREND_LIMIT})
        SELECT repo_id, commit_hash, scan_order, total, total - lag(total) OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS delta FROM shown""",
    "q_latest_scanned": f"SELECT repo_id, commit_hash, scan_order FROM (SELECT f.repo_id, f.commit_hash, f.scan_order, {_NEWEST} AS rn FROM {{frames}} f) WHERE rn = 1",
    "q_scan_order": "SELECT repo_id, commit_hash, scan_order FROM {frames}",
    "q_snapshot_meta": "SELECT repo_id, commit_hash, scan_order, frame_ts, node_count, edge_count, analysis_version, config_fingerprint, has_full_artifacts, total FROM {frames}",
    "q_previous_snapshot": """
        SELECT repo_id, commit_hash, scan_order, lag(commit_hash) OVER w AS previous_hash, lag(scan_order) OVER w AS previous_order
        FROM {frames} WINDOW w AS (PARTITION BY repo_id ORDER BY scan_order, commit_hash)""",
    "q_previous_drift": f"""
        SELECT a.repo_id, a.commit_hash, b.commit_hash AS previous_hash, a.rn - b.rn AS steps_back, a.total - b.total AS total_change
        FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS rn FROM {{frames}}) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS rn FROM {{frames}}) b
          ON a.repo_id = b.repo_id AND b.rn BETWEEN a.rn - {PREVIOUS_LIMIT} AND a.rn - 1""",
    "q_recent_meta": f"SELECT repo_id, commit_hash, scan_order, node_count, edge_count FROM (SELECT f.*, {_NEWEST} AS rn FROM {{frames}} f) WHERE rn <= {SAMPLES}",
    "q_sampled_meta": f"""
        WITH r AS (SELECT f.repo_id, f.commit_hash, f.scan_order, {_NEWEST} - 1 AS pos, count(*) OVER (PARTITION BY f.repo_id) AS n FROM {{frames}} f)
        SELECT repo_id, commit_hash, scan_order FROM r
        WHERE n <= {SAMPLES} OR floor(ceil(pos * {SAMPLES - 1} / CAST(n - 1 AS DOUBLE)) * (n - 1) / CAST({SAMPLES - 1} AS DOUBLE)) = pos""",
    "q_commit_messages": "SELECT f.repo_id, f.commit_hash, c.message FROM {frames} f JOIN {commit_rows} c ON c.repo_id = f.repo_id AND c.hash = f.commit_hash",
    "q_counts": """
        SELECT c.repo_id, c.n_commits, coalesce(f.n_frames, 0) AS n_frames FROM (SELECT repo_id, count(*) AS n_commits FROM {commit_rows} GROUP BY repo_id) c
        LEFT JOIN (SELECT repo_id, count(*) AS n_frames FROM {frames} GROUP BY repo_id) f ON f.repo_id = c.repo_id""",
    "q_checkpoint_artifacts": """
        SELECT repo_id, commit_hash, scan_order, max(CASE WHEN has_full_artifacts THEN scan_order END)
          OVER (PARTITION BY repo_id ORDER BY scan_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS artifacts_order FROM {frames}""",
    "q_load_scan_state": f"SELECT repo_id, commit_hash AS last_hash, scan_order AS last_order, node_count, edge_count FROM (SELECT f.*, {_NEWEST} AS rn FROM {{frames}} f) WHERE rn = 1",
    "q_requires_recompute": """
        SELECT repo_id, commit_hash, analysis_version < 3 OR coalesce(config_fingerprint, '') = '' OR NOT has_metadata OR NOT has_drift AS core,
          NOT coalesce(has_full_artifacts, false) AS runtime_insights FROM {frames}""",
    "rp_trend": """
        SELECT a.repo_id, a.commit_hash, b.commit_hash AS shown_hash, b.rn AS position, coalesce(b.total, 50) AS total
        FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS rn FROM {frames}) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS rn FROM {frames}) b
          ON a.repo_id = b.repo_id AND b.rn BETWEEN a.rn - 49 AND a.rn""",
    "rp_trend_direction": """
        WITH t AS (SELECT repo_id, commit_hash, coalesce(total, 50) AS now, lag(coalesce(total, 50)) OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS before FROM {frames})
        SELECT repo_id, commit_hash, CASE WHEN now < before THEN 'improving' WHEN now > before THEN 'degrading' ELSE 'stable' END AS direction FROM t""",
    "rp_health_stats": """
        SELECT repo_id, min(h) AS least, max(h) AS most, CAST(floor(avg(h)) AS BIGINT) AS mean FROM (SELECT repo_id, greatest(0, 100 - coalesce(total, 50)) AS h FROM {frames}) GROUP BY repo_id""",
    "rp_resolve_analysis": """
        SELECT repo_id, commit_hash, CASE WHEN analysis_version < 3 OR coalesce(config_fingerprint, '') = '' OR NOT has_metadata OR NOT has_drift THEN 'core'
          WHEN NOT coalesce(has_full_artifacts, false) THEN 'runtime' ELSE 'stored' END AS served FROM {frames}""",
    "rp_timeline_seek": """
        SELECT repo_id, commit_hash, scan_order, greatest(1, rn - 1) AS newer, least(n, rn + 1) AS older, greatest(1, rn - 10) AS jump_newer, least(n, rn + 10) AS jump_older FROM (
          SELECT repo_id, commit_hash, scan_order, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order DESC, commit_hash DESC) AS rn, count(*) OVER (PARTITION BY repo_id) AS n FROM {frames})""",
    "sc_recommendations": """
        WITH c AS (SELECT repo_id, commit_hash, total, 'cycle' AS component, cycle_debt AS score FROM {frames} UNION ALL SELECT repo_id, commit_hash, total, 'layering', layering_debt FROM {frames}
          UNION ALL SELECT repo_id, commit_hash, total, 'hub', hub_debt FROM {frames} UNION ALL SELECT repo_id, commit_hash, total, 'coupling', coupling_debt FROM {frames}
          UNION ALL SELECT repo_id, commit_hash, total, 'cognitive', cognitive_debt FROM {frames} UNION ALL SELECT repo_id, commit_hash, total, 'instability', instability_debt FROM {frames})
        SELECT repo_id, commit_hash, component AS rule_id, score FROM c WHERE score > 20
        UNION ALL SELECT repo_id, commit_hash, CASE WHEN total <= 15 THEN 'total_low' ELSE 'total_fair' END, CAST(total AS DOUBLE) FROM {frames} WHERE total <= 30
        UNION ALL SELECT repo_id, commit_hash, 'none', CAST(total AS DOUBLE) FROM {frames} WHERE has_drift AND total > 30 AND greatest(cycle_debt, layering_debt, hub_debt, coupling_debt, cognitive_debt, instability_debt) <= 20""",
    "sc_worst_component": """
        SELECT repo_id, commit_hash, total, worst, CASE WHEN total <= 15 THEN 'great' WHEN total <= 30 THEN 'healthy' WHEN total <= 55 THEN 'attention' ELSE 'urgent' END AS advice FROM (
          SELECT *, greatest(cycle_debt, layering_debt, hub_debt, coupling_debt, cognitive_debt, instability_debt) AS most,
            CASE greatest(cycle_debt, layering_debt, hub_debt, coupling_debt, cognitive_debt, instability_debt) WHEN instability_debt THEN 'instability' WHEN cognitive_debt THEN 'cognitive'
              WHEN coupling_debt THEN 'coupling' WHEN hub_debt THEN 'hub' WHEN layering_debt THEN 'layering' ELSE 'cycle' END AS worst FROM {frames} WHERE has_drift)""",
    "src_commit_count": "SELECT repo_id, count(*) AS n_commits FROM {commit_rows} GROUP BY repo_id",
    "src_commits": "SELECT repo_id, hash, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, hash) AS lineage_order FROM {commit_rows}",
    "src_commit_meta": "SELECT repo_id, hash, coalesce(author_name, 'unknown') AS author_name, coalesce(author_email, 'unknown') AS author_email, coalesce(commit_ts, 0) AS commit_ts, coalesce(message, '') AS message, tree_id FROM {commit_rows}",
    "src_plan_incremental": f"""
        WITH c AS (SELECT repo_id, hash, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order DESC, hash DESC) AS pos FROM {{commit_rows}}),
        stop AS (SELECT c.repo_id, min(c.pos) AS stop_pos FROM c JOIN {{frames}} f ON f.repo_id = c.repo_id AND f.commit_hash = c.hash GROUP BY c.repo_id)
        SELECT c.repo_id, count_if(c.pos < coalesce(s.stop_pos, 1000000000) AND c.pos <= {TREND_LIMIT}) AS n_new, coalesce(max(s.stop_pos), 1000000000) > {TREND_LIMIT} + 1 AND max(c.pos) > {TREND_LIMIT} AS truncated,
          max(s.stop_pos) IS NOT NULL AS reached_stop, max(CASE WHEN c.pos = least(coalesce(s.stop_pos, 1000000000), {TREND_LIMIT} + 1) THEN c.hash END) AS baseline_hash
        FROM c LEFT JOIN stop s ON s.repo_id = c.repo_id GROUP BY c.repo_id""",
    "src_commits_since": """
        WITH c AS (SELECT repo_id, hash, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order DESC, hash DESC) AS pos FROM {commit_rows}),
        stop AS (SELECT c.repo_id, min(c.pos) AS stop_pos FROM c JOIN {frames} f ON f.repo_id = c.repo_id AND f.commit_hash = c.hash GROUP BY c.repo_id)
        SELECT c.repo_id, c.hash, c.pos FROM c JOIN stop s ON s.repo_id = c.repo_id WHERE c.pos < s.stop_pos""",
    "inc_action": """
        WITH c AS (SELECT repo_id, hash, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order DESC, hash DESC) AS pos, count(*) OVER (PARTITION BY repo_id) AS n FROM {commit_rows}),
        p AS (SELECT c.repo_id, max(c.n) AS n, min(CASE WHEN f.commit_hash IS NOT NULL THEN c.pos END) AS stop_pos FROM c LEFT JOIN {frames} f ON f.repo_id = c.repo_id AND f.commit_hash = c.hash GROUP BY c.repo_id)
        SELECT repo_id, CASE WHEN stop_pos = 1 THEN 'skip' WHEN stop_pos IS NULL THEN 'rebuild_full' WHEN stop_pos > 21 THEN 'rebuild_window' ELSE 'append' END AS action FROM p""",
    "inc_depth": """
        SELECT c.repo_id, CASE WHEN max(CASE WHEN f.commit_hash IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN max(c.n) END AS depth
        FROM (SELECT repo_id, hash, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order DESC, hash DESC) AS pos, count(*) OVER (PARTITION BY repo_id) AS n FROM {commit_rows}) c
        LEFT JOIN {frames} f ON f.repo_id = c.repo_id AND f.commit_hash = c.hash AND c.pos = 1 GROUP BY c.repo_id""",
    "inc_invalidate": f"""
        SELECT repo_id, analysis_version < 3 OR coalesce(config_fingerprint, '') = '' OR config_fingerprint <> first_print AS clear_all FROM (
          SELECT f.repo_id, f.analysis_version, f.config_fingerprint, {_NEWEST} AS rn, first_value(f.config_fingerprint) OVER (PARTITION BY f.repo_id ORDER BY f.scan_order, f.commit_hash) AS first_print FROM {{frames}} f) WHERE rn = 1""",
    "inc_detail": "SELECT repo_id, commit_hash, scan_order = max(scan_order) OVER (PARTITION BY repo_id) AS full_artifacts FROM {frames}",
    "inc_checkpoint": """
        SELECT repo_id, commit_hash, scan_order FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS k, count(*) OVER (PARTITION BY repo_id) AS n FROM {frames})
        WHERE k = 1 OR k % 20 = 0 OR k = n""",
    "inc_baseline": f"""
        SELECT c.repo_id, c.hash = f.commit_hash AS reuse_state, f.commit_hash AS state_hash FROM (SELECT repo_id, max_by(hash, scan_order) AS hash FROM {{commit_rows}} GROUP BY repo_id) c
        JOIN (SELECT repo_id, commit_hash FROM (SELECT f.*, {_NEWEST} AS rn FROM {{frames}} f) WHERE rn = 1) f ON f.repo_id = c.repo_id""",
}
