"""DuckDB counterparts of graph algorithms and views, as SQL text over {edges}, {nodes}, {scc} and {blast}."""

from __future__ import annotations

HIGH_IMPACT = 0.3

DEGREES = """SELECT n.snapshot_id, n.module_name, coalesce(i.fan_in, 0) AS fan_in, coalesce(o.fan_out, 0) AS fan_out, coalesce(i.w, 0) + coalesce(o.w, 0) AS weighted_degree
  FROM {nodes} n LEFT JOIN (SELECT snapshot_id, to_module, count(*) AS fan_in, CAST(sum(weight) AS BIGINT) AS w FROM {edges} GROUP BY 1, 2) i ON i.snapshot_id = n.snapshot_id AND i.to_module = n.module_name
  LEFT JOIN (SELECT snapshot_id, from_module, count(*) AS fan_out, CAST(sum(weight) AS BIGINT) AS w FROM {edges} GROUP BY 1, 2) o ON o.snapshot_id = n.snapshot_id AND o.from_module = n.module_name"""
SIZES = "SELECT n.snapshot_id, n.n, coalesce(e.e, 0) AS e FROM (SELECT snapshot_id, count(*) AS n FROM {nodes} GROUP BY 1) n LEFT JOIN (SELECT snapshot_id, count(*) AS e FROM {edges} GROUP BY 1) e ON e.snapshot_id = n.snapshot_id"

OPS = {
    "g_build": "SELECT snapshot_id, from_module, to_module, weight FROM {edges}",
    "g_nodes": "SELECT snapshot_id, module_name, is_internal, importer_count FROM {nodes}",
    "g_pairs": "SELECT DISTINCT snapshot_id, from_module, to_module FROM {edges}",
    "g_undirected": "SELECT snapshot_id, a, b, CAST(sum(greatest(weight, 1)) AS BIGINT) AS weight FROM (SELECT snapshot_id, from_module AS a, to_module AS b, weight FROM {edges} UNION ALL SELECT snapshot_id, to_module, from_module, weight FROM {edges}) u GROUP BY 1, 2, 3",
    "g_layout_arrays": """WITH i AS (SELECT snapshot_id, module_name, row_number() OVER (PARTITION BY snapshot_id ORDER BY module_name) - 1 AS idx FROM {nodes})
        SELECT e.snapshot_id, a.idx AS from_idx, b.idx AS to_idx, e.weight FROM {edges} e JOIN i a ON a.snapshot_id = e.snapshot_id AND a.module_name = e.from_module JOIN i b ON b.snapshot_id = e.snapshot_id AND b.module_name = e.to_module""",
    "gr_scc": "SELECT snapshot_id, module_name, scc_id FROM {scc}",
    "gr_condense": """SELECT e.snapshot_id, a.scc_id AS from_scc, b.scc_id AS to_scc, max(e.weight) AS weight FROM {edges} e JOIN {scc} a ON a.snapshot_id = e.snapshot_id AND a.module_name = e.from_module
        JOIN {scc} b ON b.snapshot_id = e.snapshot_id AND b.module_name = e.to_module WHERE a.scc_id <> b.scc_id GROUP BY 1, 2, 3""",
    "gr_neighborhood": """WITH m AS (SELECT snapshot_id, module_name FROM {nodes} WHERE lower(module_name) LIKE '%core%'),
        v AS (SELECT snapshot_id, module_name FROM m UNION SELECT e.snapshot_id, e.to_module FROM {edges} e JOIN m ON m.snapshot_id = e.snapshot_id AND m.module_name = e.from_module
          UNION SELECT e.snapshot_id, e.from_module FROM {edges} e JOIN m ON m.snapshot_id = e.snapshot_id AND m.module_name = e.to_module),
        i AS (SELECT e.* FROM {edges} e JOIN v a ON a.snapshot_id = e.snapshot_id AND a.module_name = e.from_module JOIN v b ON b.snapshot_id = e.snapshot_id AND b.module_name = e.to_module)
        SELECT s.snapshot_id, i.from_module, i.to_module, i.weight, s.n AS n_visible, (SELECT count(*) FROM i x WHERE x.snapshot_id = s.snapshot_id) AS n_edges FROM (SELECT snapshot_id, count(*) AS n FROM v GROUP BY 1) s LEFT JOIN i ON i.snapshot_id = s.snapshot_id""",
    "rp_hotspots": f"""SELECT snapshot_id, module_name, fan_in, fan_out, round(i, 6) AS instability, i >= 0.95 OR fan_in + fan_out > 20 AS marked, row_number() OVER (PARTITION BY snapshot_id ORDER BY fan_in + fan_out DESC, i DESC, module_name) AS rank,
        row_number() OVER (PARTITION BY snapshot_id ORDER BY fan_in DESC, module_name) AS rank_fan_in, row_number() OVER (PARTITION BY snapshot_id ORDER BY fan_out DESC, module_name) AS rank_fan_out FROM (
          SELECT snapshot_id, module_name, fan_in, fan_out, coalesce(fan_out / nullif(fan_in + fan_out, 0)::DOUBLE, 0) AS i FROM ({DEGREES}) d) x""",
    "rp_module_inspect": f"""SELECT snapshot_id, module_name, fan_in, fan_out, CASE WHEN fan_in > 15 AND fan_out > 15 THEN 'both_ways' WHEN fan_out / CAST(greatest(fan_in + fan_out, 1) AS DOUBLE) > 0.8 AND fan_out > 10 THEN 'dependent'
          WHEN fan_in > 20 THEN 'foundation' ELSE 'healthy' END AS risk FROM ({DEGREES}) d""",
    "rp_module_links": """SELECT snapshot_id, module_name, other, weight, direction, rank, rank <= 5 AS shown FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, module_name, direction ORDER BY weight DESC, other) AS rank FROM (
          SELECT snapshot_id, from_module AS module_name, to_module AS other, weight, 'out' AS direction FROM {edges} UNION ALL SELECT snapshot_id, to_module, from_module, weight, 'in' FROM {edges}) u) r""",
    "rp_label_budget": f"""SELECT snapshot_id, module_name FROM (SELECT d.snapshot_id, d.module_name, row_number() OVER (PARTITION BY d.snapshot_id ORDER BY d.fan_in + d.fan_out DESC, d.module_name) AS r,
          CASE WHEN s.n > 200 THEN least(60, greatest(20, floor(s.n / 7.0))) WHEN s.n > 80 THEN greatest(20, floor(s.n / 3.0)) ELSE s.n END AS k FROM ({DEGREES}) d JOIN ({SIZES}) s ON s.snapshot_id = d.snapshot_id) x WHERE r <= k""",
    "rp_edge_budget": f"""SELECT snapshot_id, from_module, to_module, weight FROM (SELECT e.*, row_number() OVER (PARTITION BY e.snapshot_id ORDER BY e.weight DESC, e.from_module, e.to_module) AS r, s.n FROM {{edges}} e JOIN ({SIZES}) s ON s.snapshot_id = e.snapshot_id) x
        WHERE r <= CASE WHEN n > 200 THEN 400 WHEN n > 100 THEN 600 ELSE r END""",
    "rp_context": "SELECT n.snapshot_id, n.module_name, coalesce(i.w, 0) AS weight_in, coalesce(o.w, 0) AS weight_out FROM {nodes} n LEFT JOIN (SELECT snapshot_id, to_module AS m, CAST(sum(weight) AS BIGINT) AS w FROM {edges} GROUP BY 1, 2) i ON i.snapshot_id = n.snapshot_id AND i.m = n.module_name LEFT JOIN (SELECT snapshot_id, from_module AS m, CAST(sum(weight) AS BIGINT) AS w FROM {edges} GROUP BY 1, 2) o ON o.snapshot_id = n.snapshot_id AND o.m = n.module_name",
    "rp_relation_class": """WITH m AS (SELECT snapshot_id, module_name FROM {nodes} WHERE lower(module_name) LIKE '%core%'),
        v AS (SELECT snapshot_id, module_name FROM m UNION SELECT e.snapshot_id, e.to_module FROM {edges} e JOIN m ON m.snapshot_id = e.snapshot_id AND m.module_name = e.from_module
          UNION SELECT e.snapshot_id, e.from_module FROM {edges} e JOIN m ON m.snapshot_id = e.snapshot_id AND m.module_name = e.to_module),
        c AS (SELECT snapshot_id, min(module_name) AS centre FROM m GROUP BY 1)
        SELECT v.snapshot_id, 'node' AS kind, centre, v.module_name AS from_module, NULL AS to_module, CASE WHEN i.weight IS NOT NULL AND o.weight IS NOT NULL THEN 'bidirectional' WHEN i.weight IS NOT NULL THEN 'inbound' WHEN o.weight IS NOT NULL THEN 'outbound' ELSE 'related' END AS relation
        FROM v JOIN c USING (snapshot_id) LEFT JOIN {edges} i ON i.snapshot_id = v.snapshot_id AND i.from_module = v.module_name AND i.to_module = centre LEFT JOIN {edges} o ON o.snapshot_id = v.snapshot_id AND o.from_module = centre AND o.to_module = v.module_name WHERE v.module_name <> centre
        UNION ALL SELECT e.snapshot_id, 'edge', centre, e.from_module, e.to_module, CASE centre WHEN e.from_module THEN 'outbound' WHEN e.to_module THEN 'inbound' ELSE 'related' END
        FROM {edges} e JOIN c USING (snapshot_id) WHERE (e.snapshot_id, e.from_module) IN (SELECT snapshot_id, module_name FROM v) AND (e.snapshot_id, e.to_module) IN (SELECT snapshot_id, module_name FROM v)""",
    "rp_blast_overlay": """WITH t AS (SELECT snapshot_id, to_module, row_number() OVER (PARTITION BY snapshot_id ORDER BY count(*) DESC, to_module) AS r FROM {edges} GROUP BY 1, 2),
        f AS (SELECT x.snapshot_id, x.node AS module_name, x.d FROM {dist} x JOIN t ON t.snapshot_id = x.snapshot_id AND t.to_module = x.target AND t.r = 1)
        SELECT e.snapshot_id, e.from_module, e.to_module, round((coalesce(a.score, 0) + coalesce(b.score, 0)) / 2, 6) AS edge_score, least(fa.d, fb.d)::BIGINT AS cascade FROM {edges} e LEFT JOIN {blast} a ON a.snapshot_id = e.snapshot_id AND a.module_name = e.from_module
        LEFT JOIN {blast} b ON b.snapshot_id = e.snapshot_id AND b.module_name = e.to_module LEFT JOIN f fa ON fa.snapshot_id = e.snapshot_id AND fa.module_name = e.from_module LEFT JOIN f fb ON fb.snapshot_id = e.snapshot_id AND fb.module_name = e.to_module""",
    "gr_blast_all": f"SELECT snapshot_id, module_name, downstream_count, round(weighted_reach, 6) AS weighted_reach, round(score, 6) AS score, score >= {HIGH_IMPACT} AS is_high_impact, is_articulation_point FROM {{blast}}",
}
# relations that oracles define in SQL: mutual reachability, and breadth-first distances with the greatest weight of a step
SCC_SQL = {
    "reach": "SELECT snapshot_id, from_module AS a, to_module AS b FROM {edges} UNION SELECT r.snapshot_id, r.a, e.to_module FROM reach r JOIN {edges} e ON e.snapshot_id = r.snapshot_id AND e.from_module = r.b",
    "scc": "SELECT n.snapshot_id, n.module_name, least(n.module_name, coalesce(min(r.b), n.module_name)) AS scc_id FROM {nodes} n LEFT JOIN (SELECT x.snapshot_id, x.a, x.b FROM {reach} x JOIN {reach} y ON y.snapshot_id = x.snapshot_id AND y.a = x.b AND y.b = x.a) r ON r.snapshot_id = n.snapshot_id AND r.a = n.module_name GROUP BY 1, 2",
}
BLAST_SQL = {
    "both_ways": "SELECT snapshot_id, from_module AS a, to_module AS b FROM {edges} UNION SELECT snapshot_id, to_module, from_module FROM {edges}",
    "walk": "SELECT snapshot_id, module_name, module_name, 0 FROM {nodes} UNION SELECT DISTINCT w.snapshot_id, w.target, e.from_module, w.dist + 1 FROM walk w JOIN {edges} e ON e.snapshot_id = w.snapshot_id AND e.to_module = w.node LEFT JOIN recurring.walk r ON r.snapshot_id = w.snapshot_id AND r.target = w.target AND r.node = e.from_module WHERE r.node IS NULL",
    "dist": "SELECT snapshot_id, target, node, min(dist) AS d FROM {walk} GROUP BY 1, 2, 3",
    "hits": "SELECT x.snapshot_id, x.target, x.node, x.d, max(e.weight) AS w FROM {dist} x JOIN {edges} e ON e.snapshot_id = x.snapshot_id AND e.from_module = x.node JOIN {dist} y ON y.snapshot_id = x.snapshot_id AND y.target = x.target AND y.node = e.to_module AND y.d = x.d - 1 WHERE x.d > 0 GROUP BY 1, 2, 3, 4",
    # least label that each module reaches without the one that is gone, and the parts into which the neighbours of that one fall
    "without": "SELECT n.snapshot_id, r.module_name, n.module_name, n.module_name FROM {nodes} n JOIN {nodes} r ON r.snapshot_id = n.snapshot_id AND r.module_name <> n.module_name UNION SELECT x.snapshot_id, x.gone, x.node, min(y.label) FROM without y JOIN {both_ways} u ON u.snapshot_id = y.snapshot_id AND u.a = y.node AND u.b <> y.gone JOIN recurring.without x ON x.snapshot_id = y.snapshot_id AND x.gone = y.gone AND x.node = u.b WHERE y.label < x.label GROUP BY 1, 2, 3",
    "cuts": "SELECT u.snapshot_id, u.a AS module_name, count(DISTINCT w.label) AS parts FROM {both_ways} u JOIN {without} w ON w.snapshot_id = u.snapshot_id AND w.gone = u.a AND w.node = u.b GROUP BY 1, 2 HAVING count(DISTINCT w.label) > 1",
    "blast": "SELECT n.snapshot_id, n.module_name, EXISTS (SELECT 1 FROM {cuts} c WHERE c.snapshot_id = n.snapshot_id AND c.module_name = n.module_name) AS is_articulation_point, count(h.node) AS downstream_count, coalesce(sum(ln(1.0 + h.w) / ((1 + h.d) * (1 + h.d))), 0) AS weighted_reach, CASE WHEN count(*) OVER (PARTITION BY n.snapshot_id) > 1 THEN least(1.0, coalesce(sum(ln(1.0 + h.w) / ((1 + h.d) * (1 + h.d))), 0) / (count(*) OVER (PARTITION BY n.snapshot_id) - 1)) ELSE 0.0 END AS score FROM {nodes} n LEFT JOIN {hits} h ON h.snapshot_id = n.snapshot_id AND h.target = n.module_name GROUP BY n.snapshot_id, n.module_name",
}
PATH_SQL = {
    "links": OPS["gr_condense"],
    "steps": "SELECT DISTINCT snapshot_id, scc_id, 0 AS level FROM {scc} UNION SELECT s.snapshot_id, l.to_scc, s.level + 1 FROM steps s JOIN {links} l ON l.snapshot_id = s.snapshot_id AND l.from_scc = s.scc_id",
    "sums": "SELECT DISTINCT snapshot_id, scc_id, 0::BIGINT AS total FROM {scc} UNION SELECT s.snapshot_id, l.to_scc, s.total + l.weight FROM sums s JOIN {links} l ON l.snapshot_id = s.snapshot_id AND l.from_scc = s.scc_id",
}
PATH_ORACLES = {
    "gr_articulation": "SELECT c.snapshot_id, c.module_name, (SELECT count(*) FROM {edges} e WHERE e.snapshot_id = c.snapshot_id AND e.to_module = c.module_name) AS fan_in, (SELECT count(*) FROM {edges} e WHERE e.snapshot_id = c.snapshot_id AND e.from_module = c.module_name) AS fan_out, c.parts AS components_bridged FROM {cuts} c",
    "gr_blast_native": "SELECT snapshot_id, module_name, downstream_count, round(weighted_reach, 6) AS weighted_reach FROM {blast}",
    "gr_critical_path_weights": "SELECT snapshot_id, rank, total_weight FROM (SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY max(total) DESC) AS rank, max(total)::BIGINT AS total_weight FROM {sums} GROUP BY snapshot_id, scc_id HAVING max(total) > 0) WHERE rank <= 5",
    "gr_blast_summary": "SELECT snapshot_id, count(*) FILTER (is_articulation_point) AS articulation_point_count, round(max(score), 6) AS max_blast_score, first(module_name ORDER BY round(score, 9) DESC, module_name) AS most_impactful_module, round(avg(score), 6) AS mean_blast_score FROM {blast} GROUP BY 1",
    "gr_layers": "SELECT c.snapshot_id, c.module_name, max(s.level)::BIGINT AS layer FROM {scc} c JOIN {steps} s ON s.snapshot_id = c.snapshot_id AND s.scc_id = c.scc_id GROUP BY 1, 2",
    "gr_longest_distance": "SELECT snapshot_id, scc_id, max(total)::BIGINT AS distance FROM {sums} GROUP BY 1, 2",
    "gr_blast_single": """WITH t AS (SELECT snapshot_id, to_module, row_number() OVER (PARTITION BY snapshot_id ORDER BY count(*) DESC, to_module) AS r FROM {edges} GROUP BY 1, 2)
        SELECT h.snapshot_id, h.target, h.node AS module_name, h.d::BIGINT AS distance, ln(1.0 + h.w) / ((1 + h.d) * (1 + h.d)) AS impact FROM {hits} h JOIN t ON t.snapshot_id = h.snapshot_id AND t.to_module = h.target AND t.r = 1""",
}
