"""Queries and oracles of the graph, scoring and blast operators over all snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Clustering, Thresholds
from ..operators import graph_algorithms as A
from ..operators import graph_views as V
from ..operators.blast_native import blast_native
from ..operators.clustering import architecture_maps
from ..operators.scc_native import scc_native
from ..operators.scoring import module_degrees
from .graph_sql import BLAST_SQL, OPS, PATH_ORACLES, PATH_SQL, SCC_SQL
from .model import duck, edges, links, modules, nodes
from .runtime import cut

_MORE = SCC_SQL | BLAST_SQL | PATH_SQL


HIGH_IMPACT, SEARCH = Thresholds().blast_high_impact_threshold, "core"


def _edges(f):
    return lambda s, d: f(edges(s, d))


def _deg(f):
    return lambda s, d: f(module_degrees(edges(s, d), nodes(s, d)))


def _both(f, *more):
    def query(s, d):
        return f(cut(edges(s, d)), cut(nodes(s, d)), *more)

    return query


def _condense(s, d):
    e = cut(edges(s, d))
    return V.condense(e, cut(A.scc(e, nodes(s, d))))


def _blast_all(s, d):
    b = A.blast_all(edges(s, d), nodes(s, d))
    return b.select(
        "snapshot_id", "module_name", "downstream_count", F.round("weighted_reach", 6).alias("weighted_reach"), F.round("score", 6).alias("score"),
        (F.col("score") >= HIGH_IMPACT).alias("is_high_impact"), "is_articulation_point",
    )


def _overlay(s, d):
    e, n = cut(edges(s, d)), cut(nodes(s, d))
    return V.blast_overlay(e, cut(A.blast_all(e, n)), cut(A.blast_single(e, n)))


def _blast_summary(s, d):
    """One row per snapshot: cut vertices, the greatest impact and its module (ties by name), and the mean impact."""
    first = F.min_by("module_name", F.struct(-F.round("score", 9), "module_name"))
    return A.blast_all(edges(s, d), nodes(s, d)).groupBy("snapshot_id").agg(
        F.count_if("is_articulation_point").alias("articulation_point_count"), F.round(F.max("score"), 6).alias("max_blast_score"),
        first.alias("most_impactful_module"), F.round(F.avg("score"), 6).alias("mean_blast_score"),
    )


def _maps(s, d):
    return architecture_maps(edges(s, d), nodes(s, d))


def _algorithm(f):
    return lambda s, d: f(edges(s, d), nodes(s, d))


ORACLES = {n: duck(t, **_MORE) for n, t in OPS.items()}
QUERIES = {
    "g_build": _edges(lambda e: e),
    "g_nodes": lambda s, d: nodes(s, d),
    "g_pairs": _edges(lambda e: e.select("snapshot_id", "from_module", "to_module").distinct()),
    "g_undirected": _edges(V.undirected),
    "g_layout_arrays": _both(V.layout_arrays),
    "gr_scc": _algorithm(A.scc),
    "gr_condense": _condense,
    "gr_neighborhood": _both(V.neighborhood, SEARCH),
    "gr_blast_all": _blast_all,
    "rp_hotspots": _deg(V.hotspots),
    "rp_module_inspect": _deg(V.inspect),
    "rp_module_links": _edges(V.module_links),
    "rp_label_budget": _deg(V.label_budget),
    "rp_edge_budget": _both(V.edge_budget),
    "rp_context": _both(V.context),
    "rp_relation_class": _both(V.relations, SEARCH),
    "rp_blast_overlay": _overlay,
    "gr_blast_single": _algorithm(A.blast_single),
    "gr_articulation": _algorithm(A.articulation),
    "gr_critical_paths": _algorithm(A.critical_paths),
    "gr_critical_path_weights": lambda s, d: A.critical_paths(edges(s, d), nodes(s, d)).select("snapshot_id", "rank", "total_weight"),
    "gr_chain_depth": lambda s, d: A.critical_paths(edges(s, d), nodes(s, d)).groupBy("snapshot_id").agg(F.max("depth").alias("longest_chain_depth")),
    "gr_blast_summary": _blast_summary,
    "gr_longest_distance": _algorithm(A.longest_distance),
    "gr_layers": _algorithm(A.component_layers),
    "gr_label_propagation": _algorithm(A.label_propagation),
    "gr_blast_native": lambda s, d: blast_native(cut(edges(s, d)), cut(nodes(s, d))).withColumn("weighted_reach", F.round("weighted_reach", 6)),
    "gr_scc_native": lambda s, d: scc_native(links(s, d), modules(s, d)),
    "cl_build": _algorithm(architecture_maps),
    "cl_build_structural": lambda s, d: architecture_maps(edges(s, d), nodes(s, d), Clustering(strategy="structural")),
    "cl_layout_ratio": lambda s, d: _maps(s, d).select("snapshot_id", "cluster", "layer", "x_ratio", "y_ratio").distinct(),
    "cl_unique_names": lambda s, d: _maps(s, d).groupBy("snapshot_id", "cluster").agg(F.count("*").alias("n_members")),
    "ly_force": _algorithm(A.layout),
}
ORACLES["gr_scc_native"] = ORACLES["gr_scc"]
ORACLES |= {n: duck(t, **_MORE) for n, t in PATH_ORACLES.items()}
