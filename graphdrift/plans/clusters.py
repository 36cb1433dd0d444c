"""Queries and oracles of clusters and the reports on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from ..operators import cluster_ops as C
from ..operators.layout import overview
from .cluster_sql import ASSIGN, CONFIGURED, OPS
from .model import deliveries, duck, edges, nodes
from .runtime import Scratch, cut, unsized

SEARCH = "core"


class _Map:
    """The relations of one data directory that several reports share, each computed once."""

    def __init__(self, s, d):
        self.s, self.d = s, d

    @cached_property
    def edges(self):
        return cut(edges(self.s, self.d))

    @cached_property
    def members(self):
        return cut(C.assign(nodes(self.s, self.d), CONFIGURED))

    @property
    def links(self):
        return C.links(self.edges, self.members)

    def clusters(self, linked=None):
        return C.clusters(self.members, self.links if linked is None else linked, CONFIGURED)

    def ranked(self):
        """Clusters and the links between them, ranked. What is used twice is kept as Parquet, a small part of a checkpoint's size."""
        kept = Scratch(self.s)
        members = unsized(kept.keep("members", C.assign(nodes(self.s, self.d), CONFIGURED)))
        kept.free()
        linked = unsized(kept.keep("links", C.delivered_links(deliveries(self.s, self.d), members)))
        kept.free()
        of = unsized(kept.keep("clusters", C.clusters(members, linked, CONFIGURED)))
        kept.drop("members")
        return of, C.bridges(linked, of)

    @property
    def weighted(self):
        return C.member_weights(self.members, self.edges)


def _clusters(*cols):
    return lambda s, d: _Map(s, d).clusters().select("snapshot_id", "cluster", *cols)


def _summary(s, d):
    of, ranked = _Map(s, d).ranked()
    ranked = unsized(Scratch(s).keep("ranked", ranked))
    return C.map_summary(of, ranked, C.overview_edges(ranked))


def _detail(s, d):
    m = _Map(s, d)
    return C.detail(m.weighted, m.links)


def _lens(s, d):
    m = _Map(s, d)
    return C.member_lens(m.edges, m.members, m.clusters())


def _sidebar(search):
    def query(s, d):
        m = _Map(s, d)
        return C.sidebar(m.weighted, m.clusters(), search)

    return query


def _overview(s, d):
    of, ranked = _Map(s, d).ranked()
    return overview(of, ranked)


QUERIES = {
    "cl_token_counts": lambda s, d: C.token_counts(nodes(s, d)),
    "cl_known_heads": lambda s, d: C.known_heads(nodes(s, d)),
    "fn_namespace_key": lambda s, d: C.namespaces(cut(nodes(s, d)), CONFIGURED),
    "cl_namespace": lambda s, d: _Map(s, d).members,
    "cl_aggregate": lambda s, d: _Map(s, d).links,
    "cl_weights": _clusters("size", "n_internal", "n_external", "internal_weight", "outbound_weight", "inbound_weight"),
    "cl_anchor": lambda s, d: C.anchors(_Map(s, d).weighted),
    "cl_name": lambda s, d: _Map(s, d).members.groupBy("snapshot_id", "cluster", "base", "name").agg(F.count("*").alias("n_members")),
    "cl_kind": _clusters("kind"),
    "cl_role": lambda s, d: _Map(s, d).clusters().select("snapshot_id", "cluster", F.element_at(F.array(*map(F.lit, C.ROLES)), F.col("role_rank") + 1).alias("role")),
    "cl_overview_flag": lambda s, d: C.overview_flag(_Map(s, d).members),
    "ly_overview": _overview,
    "rp_cluster_rank": _clusters("rank"),
    "rp_bridge_rank": lambda s, d: _Map(s, d).ranked()[1].select("snapshot_id", "from_cluster", "to_cluster", "weight", "n_edges", "rank"),
    "rp_overview_edges": lambda s, d: C.overview_edges(_Map(s, d).ranked()[1]),
    "rp_map_summary": _summary,
    "rp_cluster_detail": _detail,
    "rp_member_lens": _lens,
    "rp_sidebar": _sidebar(""),
    "rp_sidebar_search": _sidebar(SEARCH),
    "rp_cluster_focus": lambda s, d: C.focus(_Map(s, d).weighted),
    "rp_cluster_hint": lambda s, d: _Map(s, d).clusters().select("snapshot_id", "cluster", C.hint(F.col("kind")).alias("hint")),
    "fn_kind_hint": lambda s, d: _Map(s, d).clusters().select("name", "kind").distinct(),
}
ORACLES = {n: duck(OPS[n].replace("regexp_like", "regexp_full_match"), assign=ASSIGN.replace("regexp_like", "regexp_full_match")) for n in QUERIES if n in OPS}
