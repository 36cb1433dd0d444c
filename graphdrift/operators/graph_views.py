"""Views of a graph: pairs, neighbourhoods, rankings and budgets of what a screen shows, for all snapshots at once.

`edges` is (snapshot_id, from_module, to_module, weight), `deg` the result of scoring.module_degrees. Equal rows are ordered
by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import MODULE, SNAPSHOT

#: Links of a module that an inspection shows in each direction.
LINKS = 5


def ends(edges: DataFrame) -> DataFrame:
    """Each edge once for both of its modules: (snapshot_id, module_name, other, direction, weight)."""
    both = F.array(
        F.struct(F.col("from_module").alias(MODULE), F.col("to_module").alias("other"), F.lit("out").alias("direction")),
        F.struct(F.col("to_module").alias(MODULE), F.col("from_module").alias("other"), F.lit("in").alias("direction")),
    )
    return edges.select(SNAPSHOT, F.explode(both).alias("x"), "weight").select(SNAPSHOT, f"x.{MODULE}", "x.other", "x.direction", "weight")


def undirected(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy(SNAPSHOT, F.col(MODULE).alias("a"), F.col("other").alias("b")).agg(F.sum(F.greatest("weight", F.lit(1))).alias("weight"))


def layout_arrays(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by the places of their modules in the order of names."""
    place = nodes.select(SNAPSHOT, MODULE, (F.row_number().over(Window.partitionBy(SNAPSHOT).orderBy(MODULE)) - 1).alias("i"))
    at = lambda c, i: place.select(SNAPSHOT, F.col(MODULE).alias(c), F.col("i").alias(i))
    return edges.join(at("from_module", "from_idx"), [SNAPSHOT, "from_module"]).join(at("to_module", "to_idx"), [SNAPSHOT, "to_module"]).select(SNAPSHOT, "from_idx", "to_idx", "weight")


def condense(edges: DataFrame, scc: DataFrame) -> DataFrame:
    of = lambda c, o: scc.select(SNAPSHOT, F.col(MODULE).alias(c), F.col("scc_id").alias(o))
    between = edges.join(of("from_module", "from_scc"), [SNAPSHOT, "from_module"]).join(of("to_module", "to_scc"), [SNAPSHOT, "to_module"]).where("from_scc != to_scc")
    return between.groupBy(SNAPSHOT, "from_scc", "to_scc").agg(F.max("weight").alias("weight"))


def matches(nodes: DataFrame, search: str) -> DataFrame:
    """Modules whose name holds the search text, upper and lower case alike."""
    return nodes.where(F.contains(F.lower(MODULE), F.lit(search.lower()))).select(SNAPSHOT, MODULE)


def visible(edges: DataFrame, nodes: DataFrame, search: str) -> DataFrame:
    """(snapshot_id, module_name): the matches and everything one step from them."""
    found = matches(nodes, search)
    near = ends(edges).join(found, [SNAPSHOT, MODULE], "left_semi").select(SNAPSHOT, F.col("other").alias(MODULE))
    return found.unionByName(near).distinct()


def among(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """The edges whose modules are both seen."""
    keep = lambda c: seen.select(SNAPSHOT, F.col(MODULE).alias(c))
    return edges.join(keep("from_module"), [SNAPSHOT, "from_module"], "left_semi").join(keep("to_module"), [SNAPSHOT, "to_module"], "left_semi")


def neighborhood(edges: DataFrame, nodes: DataFrame, search: str) -> DataFrame:
    """(snapshot_id, from_module, to_module, weight, n_visible, n_edges): the subgraph around the matches, with its size; a visible
    part without edges has one row with nulls."""
    seen = visible(edges, nodes, search)
    size = seen.groupBy(SNAPSHOT).agg(F.count("*").alias("n_visible"))
    inner = among(edges, seen)
    return size.join(inner, SNAPSHOT, "left").select(SNAPSHOT, "from_module", "to_module", "weight", "n_visible", F.count("from_module").over(Window.partitionBy(SNAPSHOT)).alias("n_edges"))


def relations(edges: DataFrame, nodes: DataFrame, search: str) -> DataFrame:
    """(snapshot_id, kind, centre, from_module, to_module, relation) of what is visible around the first match, the centre.

    A node is 'bidirectional', 'inbound' or 'outbound' by its edges with the centre, else 'related'; an edge is 'outbound' from
    the centre, 'inbound' to it, else 'related'. Nodes have a null to_module; the centre has no row.
    """
    centre = matches(nodes, search).groupBy(SNAPSHOT).agg(F.min(MODULE).alias("centre"))
    seen = visible(edges, nodes, search)
    links = ends(edges).join(centre, SNAPSHOT).where(F.col(MODULE) == F.col("centre")).groupBy(SNAPSHOT, F.col("other").alias(MODULE)).agg(F.collect_set("direction").alias("ways"))
    of_node = F.when(F.size("ways") == 2, "bidirectional").when(F.array_contains("ways", "in"), "inbound").when(F.array_contains("ways", "out"), "outbound").otherwise("related")
    of_nodes = seen.join(centre, SNAPSHOT).where(F.col(MODULE) != F.col("centre")).join(links, [SNAPSHOT, MODULE], "left")
    of_nodes = of_nodes.select(SNAPSHOT, F.lit("node").alias("kind"), "centre", F.col(MODULE).alias("from_module"), F.lit(None).cast("string").alias("to_module"), of_node.alias("relation"))
    of_edge = F.when(F.col("from_module") == F.col("centre"), "outbound").when(F.col("to_module") == F.col("centre"), "inbound").otherwise("related")
    of_edges = among(edges, seen).join(centre, SNAPSHOT).select(SNAPSHOT, F.lit("edge").alias("kind"), "centre", "from_module", "to_module", of_edge.alias("relation"))
    return of_nodes.unionByName(of_edges)


def instability() -> Column:
    return F.coalesce(F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")), F.lit(0.0))


def hotspots(deg: DataFrame) -> DataFrame:
    """All modules with their place in the three orders of the list, and the mark of unstable or very busy ones."""
    at = Window.partitionBy(SNAPSHOT)
    total, i = F.col("fan_in") + F.col("fan_out"), instability()
    orders = {"rank": (total.desc(), i.desc()), "rank_fan_in": (F.col("fan_in").desc(),), "rank_fan_out": (F.col("fan_out").desc(),)}
    ranks = [F.row_number().over(at.orderBy(*o, MODULE)).alias(n) for n, o in orders.items()]
    return deg.select(SNAPSHOT, MODULE, "fan_in", "fan_out", F.round(i, 6).alias("instability"), *ranks, ((i >= 0.95) | (total > 20)).alias("marked"))


def inspect(deg: DataFrame) -> DataFrame:
    i = F.col("fan_out") / F.greatest(F.col("fan_in") + F.col("fan_out"), F.lit(1))
    risk = F.when((F.col("fan_in") > 15) & (F.col("fan_out") > 15), "both_ways").when((i > 0.8) & (F.col("fan_out") > 10), "dependent").when(F.col("fan_in") > 20, "foundation").otherwise("healthy")
    return deg.select(SNAPSHOT, MODULE, "fan_in", "fan_out", risk.alias("risk"))


def module_links(edges: DataFrame) -> DataFrame:
    """All importers and dependencies of each module, heaviest first; `shown` marks the first LINKS of either."""
    w = Window.partitionBy(SNAPSHOT, MODULE, "direction").orderBy(F.col("weight").desc(), "other")
    ranked = ends(edges).withColumn("rank", F.row_number().over(w))
    return ranked.select(SNAPSHOT, MODULE, "other", "weight", "direction", "rank", (F.col("rank") <= LINKS).alias("shown"))


def label_budget(deg: DataFrame) -> DataFrame:
    """The modules that have a label, by degree, as many as a graph of the size has room for."""
    at = Window.partitionBy(SNAPSHOT)
    sized = deg.withColumn("n", F.count("*").over(at)).withColumn("r", F.row_number().over(at.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), MODULE)))
    room = F.when(F.col("n") > 200, F.least(F.lit(60), F.greatest(F.lit(20), F.expr("n div 7")))).when(F.col("n") > 80, F.greatest(F.expr("n div 3"), F.lit(20))).otherwise(F.col("n"))
    return sized.where(F.col("r") <= room).select(SNAPSHOT, MODULE)


def edge_budget(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    size = nodes.groupBy(SNAPSHOT).agg(F.count("*").alias("n"))
    ranked = edges.join(size, SNAPSHOT).withColumn("r", F.row_number().over(Window.partitionBy(SNAPSHOT).orderBy(F.col("weight").desc(), "from_module", "to_module")))
    room = F.when(F.col("n") > 200, 400).when(F.col("n") > 100, 600)
    return ranked.where(room.isNull() | (F.col("r") <= room)).select(SNAPSHOT, "from_module", "to_module", "weight")


def context(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    weight = lambda d: F.sum(F.when(F.col("direction") == d, F.col("weight")).otherwise(0))
    sums = ends(edges).groupBy(SNAPSHOT, MODULE).agg(weight("in").alias("weight_in"), weight("out").alias("weight_out"))
    return nodes.select(SNAPSHOT, MODULE).join(sums, [SNAPSHOT, MODULE], "left").fillna(0, ["weight_in", "weight_out"])


def blast_overlay(edges: DataFrame, blast: DataFrame, hits: DataFrame) -> DataFrame:
    """(snapshot_id, from_module, to_module, edge_score, cascade): the mean impact of an edge's modules, and the smaller of their
    distances in the cascade of `hits` (null outside; its target has distance 0)."""
    out = edges.select(SNAPSHOT, "from_module", "to_module")
    far = hits.select(SNAPSHOT, MODULE, "distance").unionByName(hits.select(SNAPSHOT, F.col("target").alias(MODULE), F.lit(0).cast("bigint").alias("distance")).distinct())
    for c in ("from_module", "to_module"):
        out = out.join(blast.select(SNAPSHOT, F.col(MODULE).alias(c), F.col("score").alias(f"s_{c}")), [SNAPSHOT, c], "left")
        out = out.join(far.select(SNAPSHOT, F.col(MODULE).alias(c), F.col("distance").alias(f"d_{c}")), [SNAPSHOT, c], "left")
    score = (F.coalesce("s_from_module", F.lit(0.0)) + F.coalesce("s_to_module", F.lit(0.0))) / 2
    return out.select(SNAPSHOT, "from_module", "to_module", F.round(score, 6).alias("edge_score"), F.least("d_from_module", "d_to_module").alias("cascade"))

