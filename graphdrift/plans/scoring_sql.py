"""DuckDB counterparts of the scoring operators, written from the model's formulas apart from the operators themselves."""

from __future__ import annotations

from ..config import Scoring
from ..functions.paths import globs_regex


def _names(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")" if parts else "false"


def _glob(column: str, globs) -> str:
    return f"regexp_full_match({column}, '{globs_regex(globs)[1:-1]}')"


def crosses(cfg: Scoring) -> str:
    return " OR ".join(f"({_glob('from_module', [r.from_glob])} AND {_glob('to_module', r.deny)})" for r in cfg.boundaries) or "false"


def with_scores(cfg: Scoring) -> str:
    """WITH ... : the relations deg, size, comp, hubs, brittle and raw (one row per snapshot with the score of each component)."""
    t, x, w = cfg.thresholds, cfg.exemptions, cfg.normalized()
    entry = f"split_part(list_extract(string_split(module_name, '/'), -1), '.', 1) IN ({', '.join(repr(s) for s in x.entry_point_stems) or 'NULL'})"
    return f"""WITH deg AS (
      SELECT n.snapshot_id, n.module_name, count(*) FILTER (e.side = 'in') AS fan_in, count(*) FILTER (e.side = 'out') AS fan_out, coalesce(sum(e.weight), 0)::BIGINT AS weighted_degree
      FROM {{nodes}} n LEFT JOIN (SELECT snapshot_id, to_module AS m, 'in' AS side, weight FROM {{edges}} UNION ALL SELECT snapshot_id, from_module, 'out', weight FROM {{edges}}) e
        ON e.snapshot_id = n.snapshot_id AND e.m = n.module_name GROUP BY ALL),
    size AS (SELECT snapshot_id, count(*)::DOUBLE AS n, (SELECT count(*) FROM {{edges}} e WHERE e.snapshot_id = d.snapshot_id)::DOUBLE AS e FROM deg d GROUP BY snapshot_id),
    comp AS (SELECT snapshot_id, scc_id, count(*) AS size FROM {{scc}} GROUP BY ALL HAVING count(*) > 1),
    cyc AS (SELECT snapshot_id, count(*) AS k, sum(size) AS inside, max(size) AS largest FROM comp GROUP BY ALL),
    lay AS (SELECT snapshot_id, sum(greatest(0, links - size)) AS violations FROM (
        SELECT c.snapshot_id, c.scc_id, c.size, (SELECT count(*) FROM {{edges}} e, {{scc}} a, {{scc}} b WHERE e.snapshot_id = c.snapshot_id AND a.snapshot_id = c.snapshot_id AND b.snapshot_id = c.snapshot_id
          AND a.module_name = e.from_module AND b.module_name = e.to_module AND a.scc_id = c.scc_id AND b.scc_id = c.scc_id) AS links FROM comp c) GROUP BY ALL),
    bnd AS (SELECT snapshot_id, count(*) AS violations FROM {{edges}} WHERE {crosses(cfg)} GROUP BY ALL),
    hubs AS (SELECT d.*, {entry} AS is_entry, (fan_in + fan_out - t) / t * least(2.0, greatest(0.5, weighted_degree / (fan_in + fan_out)::DOUBLE / 2)) * least(1.0, fan_out / (fan_in + 1.0)) AS penalty
      FROM deg d JOIN (SELECT snapshot_id, greatest(8.0, 2 * sqrt(n)) AS t FROM size WHERE n >= 6) USING (snapshot_id)
      WHERE fan_in + fan_out >= t AND fan_out / (fan_in + 1.0) >= {t.hub_exemption_ratio} AND fan_in > {t.entry_point_max_fan_in} AND NOT {_names('module_name', x.hub_exempt)}),
    hub AS (SELECT snapshot_id, count(*) AS k, avg(penalty) AS mean FROM hubs WHERE NOT is_entry GROUP BY ALL),
    core AS (SELECT *, {entry} AS is_entry, fan_out / (fan_in + fan_out)::DOUBLE > {t.brittle_instability_ratio} AS is_brittle FROM deg
      WHERE fan_in > 0 AND fan_in + fan_out >= 3 AND NOT {_names('module_name', x.instability_exempt)}),
    ins AS (SELECT snapshot_id, count(*) AS k, count(*) FILTER (is_brittle) AS brittle FROM core WHERE NOT is_entry GROUP BY ALL),
    cou AS (SELECT snapshot_id, sum(ln(1 + weight)) AS total, avg(ln(1 + weight)) AS mean, stddev_pop(ln(1 + weight)) AS dev FROM {{edges}} GROUP BY ALL),
    raw AS (SELECT s.snapshot_id, n, e, coalesce(cyc.k, 0) AS n_cycles, coalesce(cyc.inside, 0)::BIGINT AS n_cyclic, coalesce(cyc.largest, 0) AS largest, CASE WHEN n < 3 THEN 0 ELSE coalesce(lay.violations, 0)::BIGINT END AS layering_violations,
        coalesce(bnd.violations, 0) AS boundary_violations, coalesce(hub.k, 0) AS n_hubs, coalesce(ins.brittle, 0) AS n_brittle, cou.total AS log_sum,
        CASE WHEN cyc.k > 0 THEN 100 * (1 - exp(-3 * (0.5 * cyc.inside / n + 0.3 * cyc.largest / n + 0.2 * least(1.0, ln(1 + cyc.k) / ln(1 + n / 4))))) ELSE 0.0 END AS cycle,
        CASE WHEN n >= 3 AND e > 0 THEN 100 * (1 - exp(-3 * coalesce(lay.violations, 0) / e)) ELSE 0.0 END AS structural,
        CASE WHEN e > 0 THEN 100 * (1 - exp(-3 * coalesce(bnd.violations, 0) / e)) ELSE 0.0 END AS boundary,
        CASE WHEN hub.k > 0 THEN 100 * (1 - exp(-2 * hub.mean * (1 + 0.3 * (hub.k - 1)))) ELSE 0.0 END AS hub,
        CASE WHEN n >= 3 AND e > 0 THEN 100 * (1 - exp(-3 * (0.6 * least(1.0, greatest(0.0, cou.total / n - 3 - 2 * ln(n)) / (3 + 2 * ln(n))) + 0.4 * least(1.0, cou.dev / cou.mean / 2)))) ELSE 0.0 END AS coupling,
        CASE WHEN n >= 3 THEN 100 * (1 - exp(-3 * (1 - exp(-n / 20)) * (0.5 * least(1.0, greatest(0.0, e / n / 2 - 1) / 2) + 0.5 * least(1.0, greatest(0.0, 2 * e / n / greatest(3.0, 2 * ln(n)) - 1))))) ELSE 0.0 END AS cognitive,
        CASE WHEN n >= 3 AND ins.k > 0 THEN 100 * (1 - exp(-3 * ins.brittle / ins.k::DOUBLE * (1 - exp(-n / 30)))) ELSE 0.0 END AS instability
      FROM size s LEFT JOIN cyc USING (snapshot_id) LEFT JOIN lay USING (snapshot_id) LEFT JOIN bnd USING (snapshot_id) LEFT JOIN hub USING (snapshot_id) LEFT JOIN ins USING (snapshot_id) LEFT JOIN cou USING (snapshot_id)),
    score AS (SELECT *, greatest(structural, boundary) AS layering, least(100, round({w['cycle']} * cycle + {w['layering']} * greatest(structural, boundary) + {w['hub']} * hub + {w['coupling']} * coupling
        + {w['cognitive']} * cognitive + {w['instability']} * instability))::INT AS total FROM raw)
    """


FAN_DELTA = """WITH pos AS (SELECT snapshot_id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY scan_order, commit_hash) AS k FROM {frames}),
    fi AS (SELECT n.snapshot_id, n.module_name, count(e.from_module) AS v FROM {nodes} n LEFT JOIN {edges} e ON e.snapshot_id = n.snapshot_id AND e.to_module = n.module_name GROUP BY ALL),
    fo AS (SELECT n.snapshot_id, n.module_name, count(e.from_module) AS v FROM {nodes} n LEFT JOIN {edges} e ON e.snapshot_id = n.snapshot_id AND e.from_module = n.module_name GROUP BY ALL),
    di AS (SELECT p.snapshot_id, trunc(median(a.v - b.v)) AS m FROM pos p JOIN pos q ON q.repo_id = p.repo_id AND q.k = p.k - 1 JOIN fi a ON a.snapshot_id = p.snapshot_id JOIN fi b ON b.snapshot_id = q.snapshot_id AND b.module_name = a.module_name GROUP BY ALL),
    dd AS (SELECT p.snapshot_id, trunc(median(a.v - b.v)) AS m FROM pos p JOIN pos q ON q.repo_id = p.repo_id AND q.k = p.k - 1 JOIN fo a ON a.snapshot_id = p.snapshot_id JOIN fo b ON b.snapshot_id = q.snapshot_id AND b.module_name = a.module_name GROUP BY ALL),
    fan AS (SELECT p.snapshot_id, coalesce(di.m, 0)::INT AS fan_in_delta, coalesce(dd.m, 0)::INT AS fan_out_delta FROM pos p LEFT JOIN di USING (snapshot_id) LEFT JOIN dd USING (snapshot_id))
    """


def drift_sql(cfg: Scoring) -> str:
    debts = ", ".join(f"coalesce(round(score.{c}, 1), 0) AS {c}_debt" for c in ("cycle", "layering", "hub", "coupling", "cognitive", "instability"))
    return f"""{with_scores(cfg).rstrip()}, {FAN_DELTA[5:]} SELECT f.snapshot_id, f.frame_ts AS timestamp, fan.fan_in_delta, fan.fan_out_delta, coalesce(score.total, 0) AS total, coalesce(n_cycles, 0) AS new_cycles,
      coalesce(score.boundary_violations, 0) AS boundary_violations, coalesce(score.layering_violations, 0) AS layering_violations, coalesce(round(score.cognitive, 1), 0) AS cognitive_complexity, {debts}
      FROM {{frames}} f JOIN fan USING (snapshot_id) LEFT JOIN score USING (snapshot_id)"""


def diagnostics_sql(cfg: Scoring) -> str:
    return f"""{with_scores(cfg)} SELECT snapshot_id, CASE WHEN n_cycles = 1 THEN 'one_cycle' ELSE 'cycles' END AS rule_id, 1 AS rank, CASE WHEN n_cycles = 1 THEN n_cyclic::VARCHAR ELSE concat(n_cycles, ' ', n_cyclic, ' ', largest) END AS args
        FROM score WHERE round(cycle, 1) > 10
      UNION ALL SELECT snapshot_id, 'layering', 1, layering_violations::VARCHAR FROM score WHERE round(layering, 1) > 10 AND layering_violations > 0
      UNION ALL SELECT snapshot_id, 'boundary', 1, boundary_violations::VARCHAR FROM score WHERE boundary_violations > 0
      UNION ALL SELECT snapshot_id, 'hub', k, args FROM (SELECT h.snapshot_id, row_number() OVER (PARTITION BY h.snapshot_id ORDER BY fan_in + fan_out DESC, module_name) AS k, concat(module_name, ' ', fan_in, ' ', fan_out) AS args
        FROM hubs h JOIN score s ON s.snapshot_id = h.snapshot_id AND round(s.hub, 1) > 10) WHERE k <= 2
      UNION ALL SELECT snapshot_id, CASE WHEN log_sum / n / (3 + 2 * ln(n)) > 1.5 THEN 'tight' ELSE 'coupling' END, 1, CASE WHEN log_sum / n / (3 + 2 * ln(n)) > 1.5 THEN format('{{:.1f}}', log_sum / n / (3 + 2 * ln(n))) ELSE '' END FROM score WHERE round(coupling, 1) > 10
      UNION ALL SELECT snapshot_id, 'heaviest', 1, concat(x.from_module, ' ', x.to_module, ' ', x.weight) FROM (SELECT snapshot_id, first(e ORDER BY e.weight DESC, e.from_module, e.to_module) AS x FROM {{edges}} e GROUP BY 1) JOIN score USING (snapshot_id) WHERE x.weight > 5 AND round(coupling, 1) > 10
      UNION ALL SELECT snapshot_id, 'cognitive', 1, round((e / (2 * n) - 1) * 100)::INT::VARCHAR FROM score WHERE round(cognitive, 1) > 10 AND round((e / (2 * n) - 1) * 100) > 0
      UNION ALL SELECT snapshot_id, CASE WHEN k <= 3 THEN 'fragile' ELSE 'fragile_many' END, 1, CASE WHEN k <= 3 THEN names ELSE concat(k, ' ', eligible) END FROM (
        SELECT c.snapshot_id, count(*) AS eligible, count(*) FILTER (is_brittle AND NOT is_entry) AS k, string_agg(module_name, ', ' ORDER BY module_name) FILTER (is_brittle AND NOT is_entry) AS names
        FROM core c JOIN score s ON s.snapshot_id = c.snapshot_id AND round(s.instability, 1) > 10 GROUP BY 1) WHERE k > 0"""


def component_sql(cfg: Scoring, score: str, *keep: str) -> str:
    return f"{with_scores(cfg)} SELECT {', '.join(['snapshot_id', *keep])}, round({score}, 4) AS score FROM score"


def boundary_list_sql(cfg: Scoring) -> str:
    return f"SELECT * FROM (SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY from_module, to_module) AS rank, from_module, to_module, count(*) OVER (PARTITION BY snapshot_id) AS n_found FROM {{edges}} WHERE {crosses(cfg)}) WHERE rank <= 10"
