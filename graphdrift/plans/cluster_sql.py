"""DuckDB counterparts of clusters by namespace and the reports on them, as SQL text over {assign}, {edges} and {nodes}."""

from __future__ import annotations

from ..config import parse_config
from ..functions.labels import FIXED_PREFIXES, FIXED_ROOTS, KIND_BY_NAME
from ..functions.paths import globs_regex

DEPS, ROOT = "__deps__", "__root__"
#: A configuration of namespaces with families, rules, aliases and kinds that meet modules of the given tables.
CONFIGURED = parse_config("""
[clustering]
strategy = "namespace"
[clustering.semantic]
fallback_family = "platform"
[clustering.structural]
post_merge_small_clusters = false
disambiguate_duplicate_names = false
[[clustering.families]]
name = "storage"
kind = "infra"
include = ["store/**", "*backup*"]
exclude = ["store/s*"]
[[clustering.families]]
name = "heads"
priority = 2
include = ["header/**", "*queue*/**", "core"]
[[clustering.rules]]
name = "loops"
match = ["cycle/**", "store/s*"]
[clustering.presentation.aliases]
deps = "third-party"
platform = "Base"
[clustering.presentation.kinds]
Base = "workspace"
third-party = "deps"
heads = "entry"
""").clustering
MIN_REPEATS, KEEP_EDGES, OVERVIEW_NODES = 2, 10, 70

_HEAD = "split_part(module_name, '/', 1)"
TOKEN = "CASE WHEN module_name LIKE '%!_%' ESCAPE '!' AND length(split_part(module_name, '_', 1)) >= 3 THEN split_part(module_name, '_', 1) WHEN module_name LIKE '%-%' AND length(split_part(module_name, '-', 1)) >= 3 THEN split_part(module_name, '-', 1) END"
TOKENS = f"SELECT snapshot_id, token, count(*) AS n FROM (SELECT snapshot_id, {TOKEN} AS token FROM {{nodes}} WHERE is_internal AND module_name NOT LIKE '%/%') t WHERE token IS NOT NULL GROUP BY 1, 2"
HEADS = f"SELECT DISTINCT snapshot_id, {_HEAD} AS head FROM {{nodes}} WHERE is_internal AND module_name LIKE '%/%'"
_FIXED = " ".join(f"WHEN n.module_name LIKE '{p.replace('_', '!_')}%' ESCAPE '!' THEN '{v}'" for p, v in FIXED_PREFIXES.items())
def _match(f) -> str:
    inside = lambda globs: f"regexp_full_match(n.module_name, '{globs_regex(globs)[1:-1]}')"
    return inside(f.include) + (f" AND NOT {inside(f.exclude)}" if f.exclude else "")


_FAMILY = " ".join(f"WHEN {_match(f)} THEN '{f.name}'" for f in sorted(CONFIGURED.families, key=lambda f: (-f.priority, -len(f.include))) + CONFIGURED.rules)
NAMESPACE = f"""SELECT n.snapshot_id, n.module_name, n.is_internal, CASE {_FAMILY} WHEN NOT n.is_internal THEN '{DEPS}' WHEN n.module_name LIKE '%/%' THEN split_part(n.module_name, '/', 1)
    WHEN h.head IS NOT NULL OR n.module_name IN ({', '.join(repr(x) for x in FIXED_ROOTS)}) THEN n.module_name {_FIXED}
    WHEN t.n >= {MIN_REPEATS} THEN t.token WHEN regexp_like(n.module_name, '^[A-Za-z0-9_-]*$') THEN '{ROOT}' END AS namespace
  FROM (SELECT *, {TOKEN} AS own_token FROM {{nodes}}) n LEFT JOIN ({HEADS}) h ON h.snapshot_id = n.snapshot_id AND h.head = n.module_name
  LEFT JOIN ({TOKENS}) t ON t.snapshot_id = n.snapshot_id AND t.token = n.own_token"""
ASSIGN = f"""SELECT a.snapshot_id, a.module_name, a.is_internal, a.namespace AS cluster, CASE a.namespace WHEN '{DEPS}' THEN 'deps' WHEN '{ROOT}' THEN 'platform' ELSE a.namespace END AS base,
    CASE a.namespace WHEN '{DEPS}' THEN 'third-party' WHEN 'deps' THEN 'third-party' WHEN '{ROOT}' THEN 'Base' WHEN 'platform' THEN 'Base' ELSE a.namespace END AS name FROM ({NAMESPACE}) a
  JOIN (SELECT snapshot_id FROM ({NAMESPACE}) b GROUP BY 1 HAVING count(*) = count(namespace) AND count(DISTINCT namespace) >= 2) g ON g.snapshot_id = a.snapshot_id"""
LINKS = "SELECT e.snapshot_id, a.cluster AS from_cluster, b.cluster AS to_cluster, CAST(sum(e.weight) AS BIGINT) AS weight, count(*) AS n_edges FROM {edges} e JOIN {assign} a ON a.snapshot_id = e.snapshot_id AND a.module_name = e.from_module JOIN {assign} b ON b.snapshot_id = e.snapshot_id AND b.module_name = e.to_module GROUP BY 1, 2, 3"
_KINDS = " ".join(f"WHEN lower(c.name) IN ({', '.join(repr(x) for x in xs)}) THEN '{k}'" for k, xs in KIND_BY_NAME.items())
CLUSTERS = f"""SELECT c.snapshot_id, c.cluster, c.name, c.size, c.n_internal, c.size - c.n_internal AS n_external, coalesce(w.internal, 0) AS internal_weight, coalesce(w.outbound, 0) AS outbound_weight, coalesce(i.inbound, 0) AS inbound_weight,
    CASE WHEN c.name = 'Base' THEN 'workspace' WHEN c.name = 'third-party' THEN 'deps' WHEN c.name = 'heads' THEN 'entry' WHEN c.base = 'storage' THEN 'infra' WHEN c.n_internal = 0 THEN 'external' {_KINDS} ELSE 'group' END AS kind,
    CASE WHEN c.n_internal = 0 OR c.name = 'third-party' OR lower(c.name) = 'deps' THEN 0 WHEN c.size - c.n_internal > 3 * c.n_internal AND c.n_internal <= 2 THEN 1 ELSE 2 END AS role_rank
  FROM (SELECT snapshot_id, cluster, min(base) AS base, min(name) AS name, count(*) AS size, count_if(is_internal) AS n_internal FROM {{assign}} GROUP BY 1, 2) c
  LEFT JOIN (SELECT snapshot_id, from_cluster, CAST(sum(CASE WHEN from_cluster = to_cluster THEN weight ELSE 0 END) AS BIGINT) AS internal, CAST(sum(CASE WHEN from_cluster <> to_cluster THEN weight ELSE 0 END) AS BIGINT) AS outbound FROM ({LINKS}) l GROUP BY 1, 2) w ON w.snapshot_id = c.snapshot_id AND w.from_cluster = c.cluster
  LEFT JOIN (SELECT snapshot_id, to_cluster, CAST(sum(weight) AS BIGINT) AS inbound FROM ({LINKS}) l WHERE from_cluster <> to_cluster GROUP BY 1, 2) i ON i.snapshot_id = c.snapshot_id AND i.to_cluster = c.cluster"""
MEMBERS = "SELECT a.snapshot_id, a.cluster, a.base, a.module_name, a.is_internal, coalesce(i.w, 0) AS weight_in, coalesce(o.w, 0) AS weight_out, coalesce(i.w, 0) + coalesce(o.w, 0) AS total FROM {assign} a LEFT JOIN (SELECT snapshot_id, to_module AS m, CAST(sum(weight) AS BIGINT) AS w FROM {edges} GROUP BY 1, 2) i ON i.snapshot_id = a.snapshot_id AND i.m = a.module_name LEFT JOIN (SELECT snapshot_id, from_module AS m, CAST(sum(weight) AS BIGINT) AS w FROM {edges} GROUP BY 1, 2) o ON o.snapshot_id = a.snapshot_id AND o.m = a.module_name"
_RANK = "row_number() OVER (PARTITION BY snapshot_id ORDER BY role_rank DESC, internal_weight + outbound_weight + inbound_weight DESC, internal_weight DESC, size DESC, cluster)"
BRIDGES = f"""SELECT l.snapshot_id, l.from_cluster, l.to_cluster, l.weight, l.n_edges, CASE WHEN a.role_rank = 2 AND b.role_rank = 2 THEN 2 WHEN a.role_rank > 0 AND b.role_rank > 0 THEN 1 ELSE 0 END AS role_rank, a.role_rank AS from_role, b.role_rank AS to_role
  FROM ({LINKS}) l JOIN ({CLUSTERS}) a ON a.snapshot_id = l.snapshot_id AND a.cluster = l.from_cluster JOIN ({CLUSTERS}) b ON b.snapshot_id = l.snapshot_id AND b.cluster = l.to_cluster WHERE l.from_cluster <> l.to_cluster"""
_BRIDGE_ORDER = "role_rank DESC, weight DESC, n_edges DESC, from_cluster, to_cluster"

OPS = {
    "cl_token_counts": TOKENS,
    "cl_known_heads": HEADS,
    "fn_namespace_key": NAMESPACE,
    "cl_namespace": ASSIGN,
    "cl_aggregate": LINKS,
    "cl_weights": f"SELECT snapshot_id, cluster, size, n_internal, n_external, internal_weight, outbound_weight, inbound_weight FROM ({CLUSTERS}) c",
    "cl_anchor": f"SELECT snapshot_id, cluster, module_name AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, cluster ORDER BY total DESC, module_name DESC) AS r FROM ({MEMBERS}) m) x WHERE r = 1",
    "cl_name": f"SELECT snapshot_id, cluster, base, name, count(*) AS n_members FROM ({ASSIGN}) a GROUP BY 1, 2, 3, 4",
    "cl_kind": f"SELECT snapshot_id, cluster, kind FROM ({CLUSTERS}) c",
    "cl_role": f"SELECT snapshot_id, cluster, CASE role_rank WHEN 0 THEN 'external_sink' WHEN 1 THEN 'support' ELSE 'primary' END AS role FROM ({CLUSTERS}) c",
    "cl_overview_flag": "SELECT snapshot_id, count(*) AS n_labels, count(DISTINCT cluster) AS n_clusters, count(*) >= 70 AND count(DISTINCT cluster) >= 2 AND count(DISTINCT cluster) + 6 < count(*) AS overview FROM {assign} GROUP BY 1",
    "rp_cluster_rank": f"SELECT snapshot_id, cluster, {_RANK} AS rank FROM ({CLUSTERS}) c",
    "rp_bridge_rank": f"SELECT snapshot_id, from_cluster, to_cluster, weight, n_edges, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_BRIDGE_ORDER}) AS rank FROM ({BRIDGES}) b",
    "rp_overview_edges": f"""SELECT snapshot_id, from_cluster, to_cluster, weight, k AS place, n_omitted FROM (SELECT *, count(*) FILTER (k > {KEEP_EDGES} AND role_rank = 0) OVER (PARTITION BY snapshot_id) AS n_omitted FROM (
        SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_BRIDGE_ORDER}) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY snapshot_id, from_cluster ORDER BY weight DESC, n_edges DESC, to_cluster) AS r, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_BRIDGE_ORDER}) AS best,
          row_number() OVER (PARTITION BY snapshot_id ORDER BY weight DESC, n_edges DESC, from_cluster, to_cluster) AS heaviest FROM ({BRIDGES}) b) x
        WHERE best = 1 OR (heaviest = 1 AND role_rank = 0) OR (from_role = 2 AND r <= 2) OR r = 1) y) z WHERE k <= {KEEP_EDGES}""",
    "rp_cluster_focus": f"SELECT snapshot_id, cluster, module_name AS focus FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, cluster ORDER BY CASE WHEN module_name = base THEN 0 ELSE 1 END, total DESC, module_name) AS r FROM ({MEMBERS}) m) x WHERE r = 1",
    "rp_cluster_hint": f"SELECT snapshot_id, cluster, CASE kind WHEN 'deps' THEN 'third-party' WHEN 'external' THEN 'third-party' WHEN 'entry' THEN 'entry point' WHEN 'infra' THEN 'shared base' WHEN 'workspace' THEN 'workspace' END AS hint FROM ({CLUSTERS}) c",
    "fn_kind_hint": f"SELECT DISTINCT name, kind FROM ({CLUSTERS}) c",
}
OPS["rp_map_summary"] = f"""WITH c AS (SELECT *, {_RANK} AS rank FROM ({CLUSTERS}) c), b AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {_BRIDGE_ORDER}) AS rank,
      row_number() OVER (PARTITION BY snapshot_id ORDER BY weight DESC, n_edges DESC, from_cluster, to_cluster) AS heaviest FROM ({BRIDGES}) b)
    SELECT c.snapshot_id, any_value(c.cluster) FILTER (c.rank = 1) AS anchor, count(*) FILTER (c.role_rank = 0) AS n_sinks, count(*) FILTER (c.inbound_weight = 0 AND c.outbound_weight = 0) AS n_isolated,
      (SELECT from_cluster || ' -> ' || to_cluster FROM b WHERE b.snapshot_id = c.snapshot_id AND b.rank = 1) AS strongest, (SELECT weight FROM b WHERE b.snapshot_id = c.snapshot_id AND b.rank = 1) AS strongest_weight,
      (SELECT from_cluster || ' -> ' || to_cluster FROM b WHERE b.snapshot_id = c.snapshot_id AND heaviest = 1 AND role_rank = 0 AND b.rank > 1) AS third_party, (SELECT weight FROM b WHERE b.snapshot_id = c.snapshot_id AND heaviest = 1 AND role_rank = 0 AND b.rank > 1) AS third_party_weight,
      coalesce((SELECT max(n_omitted) FROM ({OPS["rp_overview_edges"]}) o WHERE o.snapshot_id = c.snapshot_id), 0) AS n_omitted FROM c GROUP BY c.snapshot_id"""
OPS["rp_cluster_detail"] = f"""SELECT *, row_number() OVER (PARTITION BY snapshot_id, cluster, part ORDER BY total DESC, weight_in DESC, weight_out DESC, name) AS rank FROM (
    SELECT snapshot_id, cluster, 'member' AS part, module_name AS name, total, weight_in, weight_out FROM ({MEMBERS}) m
    UNION ALL SELECT snapshot_id, from_cluster, 'link_out', to_cluster, weight, 0, weight FROM ({LINKS}) l WHERE from_cluster <> to_cluster
    UNION ALL SELECT snapshot_id, to_cluster, 'link_in', from_cluster, weight, weight, 0 FROM ({LINKS}) l WHERE from_cluster <> to_cluster) u"""
OPS["rp_member_lens"] = f"""WITH r AS (SELECT snapshot_id, cluster, role_rank FROM ({CLUSTERS}) c),
    u AS (SELECT e.snapshot_id, e.from_module AS module_name, e.to_module AS other, 'out' AS direction, weight FROM {{edges}} e UNION ALL SELECT e.snapshot_id, e.to_module, e.from_module, 'in', weight FROM {{edges}} e),
    g AS (SELECT u.snapshot_id, u.module_name, u.direction, u.weight, a.cluster = b.cluster AS inside, CASE WHEN a.cluster = b.cluster OR r.role_rank = 0 THEN u.other ELSE b.cluster END AS grp
      FROM u JOIN {{assign}} a ON a.snapshot_id = u.snapshot_id AND a.module_name = u.module_name JOIN {{assign}} b ON b.snapshot_id = u.snapshot_id AND b.module_name = u.other JOIN r ON r.snapshot_id = a.snapshot_id AND r.cluster = a.cluster)
    SELECT snapshot_id, module_name, direction, grp, sum(weight)::BIGINT AS weight, count(*) AS n, (sum(sum(weight)) OVER (PARTITION BY snapshot_id, module_name, direction))::BIGINT AS total,
      (sum(count(*) FILTER (inside)) OVER (PARTITION BY snapshot_id, module_name))::BIGINT AS n_inside FROM g GROUP BY snapshot_id, module_name, direction, grp"""
_SIDE = f"""WITH c AS (SELECT *, {_RANK} AS rank FROM ({CLUSTERS}) c), m AS ({MEMBERS}) SELECT m.snapshot_id, dense_rank() OVER (PARTITION BY m.snapshot_id ORDER BY c.rank) AS place, m.cluster,
    row_number() OVER (PARTITION BY m.snapshot_id, m.cluster ORDER BY CASE WHEN m.is_internal THEN 0 ELSE 1 END, m.total DESC, m.module_name) AS position, m.module_name FROM m JOIN c ON c.snapshot_id = m.snapshot_id AND c.cluster = m.cluster"""
OPS["rp_sidebar"] = _SIDE
OPS["rp_sidebar_search"] = _SIDE + " WHERE contains(lower(c.name || ' (' || c.size || ')'), 'core') OR EXISTS (SELECT 1 FROM m x WHERE x.snapshot_id = m.snapshot_id AND x.cluster = m.cluster AND contains(lower(x.module_name), 'core'))"
