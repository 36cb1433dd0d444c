"""Queries and oracles of the debt score under the default configuration and one that sets everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import parse_config
from ..functions.labels import PREFIX_RULES, prefix_rule
from ..operators import graph_algorithms as A
from ..operators import scoring as S
from ..operators.reports import analyze, chains
from .graph import _MORE
from .model import duck, edges, frames, nodes
from .runtime import cut
from .scoring_sql import FAN_DELTA, boundary_list_sql, component_sql, diagnostics_sql, drift_sql, with_scores

DEFAULT = parse_config("").scoring
#: A configuration that changes every setting of the score; its rules meet edges of the given tables.
CONFIGURED = parse_config("""
[scoring.weights]
cycle = 10
layering = 40
hub = 20
coupling = 10
cognitive = 5
instability = 25
[scoring.thresholds]
hub_exemption_ratio = 0.1
entry_point_max_fan_in = 1
brittle_instability_ratio = 0.6
[scoring.exemptions]
hub_exempt = ["core", "header/s"]
instability_exempt = ["store", "quote"]
entry_point_stems = ["main", "secret", "stock"]
[[scoring.boundaries]]
from = "{store,suggest,socket}/**"
deny = ["*core*", "header/**", "reply/*", "plugin/*"]
[[scoring.boundaries]]
from = "*queue*/**"
deny = ["store/**", "errmark"]
""").scoring


def _graph(s, d):
    e, n = cut(edges(s, d)), cut(nodes(s, d))
    return e, n, cut(A.scc(e, n))


def _component(cfg, score, *keep):
    def query(s, d):
        e, n, scc = _graph(s, d)
        return S.measures(e, n, scc, cfg).selectExpr("snapshot_id", *keep, f"round({score}, 4) AS score")

    return query


def _drift(cfg):
    def query(s, d):
        e, n, scc = _graph(s, d)
        return S.drift(e, n, frames(s, d), scc, cfg)

    return query


def _diagnostics(cfg):
    def query(s, d):
        return S.diagnostics(*_graph(s, d), cfg)

    return query


def _report(s, d):
    e, n, scc = _graph(s, d)
    fr = cut(frames(s, d))
    return analyze(e, n, fr, scc, cut(S.drift(e, n, fr, scc, CONFIGURED)), cut(A.blast_all(e, n)), CONFIGURED)


_ITEMS = ("fan_in_delta", "fan_out_delta", "total", "new_cycles", "boundary_violations", "layering_violations", "cognitive_complexity", *[f"{c}_debt" for c in S.COMPONENTS])
_REPORT = f"""WITH drift AS ({duck(drift_sql(CONFIGURED), **_MORE)}), place AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS k FROM {{frames}}),
    advice AS ({" UNION ALL ".join(f"SELECT snapshot_id, '{c}' AS rule, {c}_debt::DOUBLE AS v FROM drift WHERE {c}_debt > 20" for c in S.COMPONENTS)}
      UNION ALL SELECT snapshot_id, CASE WHEN total <= 15 THEN 'great' ELSE 'healthy' END, total FROM drift WHERE total <= 30),
    every AS (SELECT * FROM advice UNION ALL SELECT snapshot_id, 'acceptable', total FROM drift WHERE snapshot_id NOT IN (SELECT snapshot_id FROM advice))
    {" UNION ALL ".join(f"SELECT snapshot_id, 'drift' AS section, {i + 1} AS rank, '{c}' AS item, {c}::DOUBLE AS value FROM drift" for i, c in enumerate(_ITEMS))}
    UNION ALL SELECT a.snapshot_id, 'temporal', (a.k - b.k)::INT, b.commit_hash, a.total - b.total FROM place a JOIN place b ON b.repo_id = a.repo_id AND a.k - b.k IN (1, 2, 3)
    UNION ALL SELECT snapshot_id, 'boundaries', rank, from_module || ' -> ' || to_module, n_found FROM ({boundary_list_sql(CONFIGURED)})
    UNION ALL SELECT snapshot_id, 'cycles', 1, 'n_cycles', new_cycles FROM drift WHERE new_cycles > 0
    UNION ALL SELECT * FROM (SELECT snapshot_id, 'cut_vertices', row_number() OVER (PARTITION BY snapshot_id ORDER BY parts DESC, module_name) AS r, module_name, parts FROM {{cuts}}) WHERE r <= 5
    UNION ALL SELECT * FROM (SELECT snapshot_id, 'impacts', row_number() OVER (PARTITION BY snapshot_id ORDER BY round(score, 9) DESC, module_name) AS r, module_name || CASE WHEN is_articulation_point THEN ' [keystone]' ELSE '' END, round(score, 6) FROM {{blast}}) WHERE r <= 5
    UNION ALL SELECT snapshot_id, 'recommendations', row_number() OVER (PARTITION BY snapshot_id ORDER BY rule), rule, v FROM every"""


def _degrees(s, d):
    return S.module_degrees(edges(s, d), nodes(s, d))


def _weights(s, d):
    """One row for each component of each configuration."""
    zero = parse_config("[scoring.weights]\n" + "\n".join(f"{c} = 0" for c in S.COMPONENTS)).scoring
    rows = [(name, c, round(cfg.normalized()[c], 6)) for name, cfg in (("default", DEFAULT), ("configured", CONFIGURED), ("all_zero", zero)) for c in S.COMPONENTS]
    return s.createDataFrame(rows, "configuration string, component string, share double")


def _prefixed(s, d):
    """Edges whose ends are put under workspace roots by the length of their names, so that the fixed rules meet some."""
    roots = ("packages/", "libs/", "core::", "runtime/", "ext/", "shared::"), ("apps/", "cli/", "cmd::", "apps::", "runtime/")
    put = lambda c, r: F.concat(F.element_at(F.array(*map(F.lit, r)), (F.length(c) % len(r) + 1).cast("int")), F.col(c)).alias(c)
    return edges(s, d).select("snapshot_id", put("from_module", roots[0]), put("to_module", roots[1])).where(prefix_rule(F.col("from_module"), F.col("to_module")))


_PREFIXED = """SELECT * FROM (SELECT snapshot_id, ['packages/', 'libs/', 'core::', 'runtime/', 'ext/', 'shared::'][length(from_module) % 6 + 1] || from_module AS from_module,
  ['apps/', 'cli/', 'cmd::', 'apps::', 'runtime/'][length(to_module) % 5 + 1] || to_module AS to_module FROM {edges}) WHERE """ + " OR ".join(f"starts_with(from_module, '{a}') AND starts_with(to_module, '{b}')" for a, b in PREFIX_RULES)  # fmt: skip

QUERIES = {
    "sc_weights": _weights,
    "sc_cycle": _component(DEFAULT, "cycle", "n_cycles"),
    "sc_layering": _component(DEFAULT, "structural", "violations AS layering_violations"),
    "sc_boundary": _component(CONFIGURED, "boundary", "boundary_violations"),
    "sc_hub": _component(DEFAULT, "hub", "n_hubs"),
    "sc_hub_configured": _component(CONFIGURED, "hub", "n_hubs"),
    "sc_coupling": _component(DEFAULT, "coupling"),
    "sc_cognitive": _component(DEFAULT, "cognitive"),
    "sc_instability": _component(DEFAULT, "instability", "n_brittle"),
    "sc_instability_configured": _component(CONFIGURED, "instability", "n_brittle"),
    "sc_drift": _drift(DEFAULT),
    "sc_drift_configured": _drift(CONFIGURED),
    "sc_diagnostics": _diagnostics(DEFAULT),
    "sc_diagnostics_configured": _diagnostics(CONFIGURED),
    "sc_cycle_count": lambda s, d: S.cyclic_components(A.scc(edges(s, d), nodes(s, d))).groupBy("snapshot_id").agg(F.count("*").alias("n_cycles")),
    "sc_legacy_boundaries": _prefixed,
    "rp_analyze": lambda s, d: _report(s, d).where("section != 'chains'"),
    "rp_analyze_chains": lambda s, d: chains(edges(s, d), nodes(s, d)),
    "rp_boundary_list": lambda s, d: S.boundary_list(edges(s, d), CONFIGURED),
    "g_degrees": _degrees,
    "g_instability": lambda s, d: _degrees(s, d).select(
        "snapshot_id", "module_name", "fan_in", "fan_out", F.round(F.coalesce(F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")), F.lit(0.0)), 6).alias("instability")
    ),
    "g_node_total_weight": lambda s, d: _degrees(s, d).select("snapshot_id", "module_name", F.col("weighted_degree").alias("total_weight")),
    "g_fan_delta": lambda s, d: S.fan_deltas(cut(_degrees(s, d)), frames(s, d)),
}
_SHARES = {"default": (30, 25, 15, 12, 10, 8), "configured": (10, 40, 20, 10, 5, 25), "all_zero": (30, 25, 15, 12, 10, 8)}
_SQL = {
    "sc_cycle": component_sql(DEFAULT, "cycle", "n_cycles"),
    "sc_layering": component_sql(DEFAULT, "structural", "layering_violations"),
    "sc_boundary": component_sql(CONFIGURED, "boundary", "boundary_violations"),
    "sc_hub": component_sql(DEFAULT, "hub", "n_hubs"),
    "sc_hub_configured": component_sql(CONFIGURED, "hub", "n_hubs"),
    "sc_coupling": component_sql(DEFAULT, "coupling"),
    "sc_cognitive": component_sql(DEFAULT, "cognitive"),
    "sc_instability": component_sql(DEFAULT, "instability", "n_brittle"),
    "sc_instability_configured": component_sql(CONFIGURED, "instability", "n_brittle"),
    "sc_drift": drift_sql(DEFAULT),
    "sc_drift_configured": drift_sql(CONFIGURED),
    "sc_diagnostics": diagnostics_sql(DEFAULT),
    "sc_diagnostics_configured": diagnostics_sql(CONFIGURED),
    "sc_cycle_count": f"{with_scores(DEFAULT)} SELECT snapshot_id, n_cycles FROM score WHERE n_cycles > 0",
    "sc_legacy_boundaries": _PREFIXED,
    "rp_boundary_list": boundary_list_sql(CONFIGURED),
    "g_degrees": f"{with_scores(DEFAULT)} SELECT snapshot_id, module_name, fan_in, fan_out, weighted_degree FROM deg",
    "g_instability": f"{with_scores(DEFAULT)} SELECT snapshot_id, module_name, fan_in, fan_out, round(coalesce(fan_out / nullif(fan_in + fan_out, 0)::DOUBLE, 0), 6) AS instability FROM deg",
    "g_node_total_weight": "SELECT n.snapshot_id, n.module_name, (SELECT coalesce(sum(weight), 0) FROM {edges} e WHERE e.snapshot_id = n.snapshot_id AND n.module_name IN (e.from_module, e.to_module))::BIGINT AS total_weight FROM {nodes} n",
    "g_fan_delta": f"{FAN_DELTA} SELECT * FROM fan",
}
_SQL["rp_analyze"] = _REPORT
ORACLES = {n: duck(t, **_MORE) for n, t in _SQL.items()}
ORACLES["sc_weights"] = " UNION ALL ".join(
    f"SELECT '{name}' AS configuration, '{c}' AS component, round({v} / {sum(vs)}.0, 6) AS share" for name, vs in _SHARES.items() for c, v in zip(S.COMPONENTS, vs, strict=True)
)
