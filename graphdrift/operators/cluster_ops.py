"""Clusters of modules by namespace and the reports on them, for all snapshots at once.

`assign` gives each module's namespace and cluster under a clustering configuration; `architecture_maps` in clustering.py
goes on from the same namespaces with the steps that depend on each other (merges, splits, constraints). The reports take
either: rows (snapshot_id, module_name, is_internal, cluster, base, name). Equal rows are ordered by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Clustering
from ..functions.labels import FIXED_PREFIXES, FIXED_ROOTS, kind_by_name, root_token
from ..functions.paths import globs_regex
from .graph_views import ends
from .scoring import MODULE, SNAPSHOT
from .snapshot_diff import delivered_weight

DEPS, ROOT = "__deps__", "__root__"
#: Links that the overview draws, and how many of a primary and of any other cluster.
DRAWN, OF_PRIMARY, OF_OTHERS = 10, 2, 1
#: Modules from which the overview is shown, and how many fewer clusters it must have.
OVERVIEW_MODULES, OVERVIEW_GAIN = 70, 6
ROLES = ("external_sink", "support", "primary")


def token_counts(nodes: DataFrame) -> DataFrame:
    roots = nodes.where(F.col("is_internal") & ~F.contains(MODULE, F.lit("/"))).select(SNAPSHOT, root_token(F.col(MODULE)).alias("token"))
    return roots.where("token IS NOT NULL").groupBy(SNAPSHOT, "token").agg(F.count("*").alias("n"))


def known_heads(nodes: DataFrame) -> DataFrame:
    inside = nodes.where(F.col("is_internal") & F.contains(MODULE, F.lit("/")))
    return inside.select(SNAPSHOT, F.split_part(MODULE, F.lit("/"), F.lit(1)).alias("head")).distinct()


def _chain(cases: list[tuple[Column, Column | str]]) -> Column:
    """The value of the first case that holds, else null."""
    out = F.lit(None).cast("string")
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def family_of(label: Column, cfg: Clustering) -> Column:
    matches = lambda f: label.rlike(globs_regex(f.include)) & ~label.rlike(globs_regex(f.exclude))
    return _chain([(matches(f), f.name) for f in cfg.ordered_families()])


def namespaces(nodes: DataFrame, cfg: Clustering) -> DataFrame:
    """(snapshot_id, module_name, is_internal, namespace): families first, then externals, path heads, fixed roots and prefixes,
    and root tokens that recur; null for a name with other characters than letters, digits, '_' and '-'."""
    label, slash = F.col(MODULE), F.contains(MODULE, F.lit("/"))
    inside = F.col("is_internal") & slash
    head = F.when(inside, F.split_part(MODULE, F.lit("/"), F.lit(1))).otherwise(label)
    rows = nodes.select(SNAPSHOT, MODULE, "is_internal", root_token(label).alias("token"), head.alias("head")).repartition(SNAPSHOT)  # for all windows
    of_token, of_head = Window.partitionBy(SNAPSHOT, "token"), Window.partitionBy(SNAPSHOT, "head")
    repeats = F.count_if(F.col("token").isNotNull() & F.col("is_internal") & ~slash).over(of_token)
    rows = rows.withColumn("n", F.nullif(repeats, F.lit(0).cast("bigint"))).withColumn("is_head", ~slash & F.max(inside).over(of_head))
    family = family_of(label, cfg)
    external = F.lit(DEPS) if cfg.collapse_external else label
    prefixes = [(label.startswith(p), name) for p, name in FIXED_PREFIXES.items()]
    own = _chain([
        (F.contains(label, F.lit("/")), F.split_part(label, F.lit("/"), F.lit(1))),
        (label.isin(*FIXED_ROOTS) | (F.lit(cfg.include_exact_roots) & F.coalesce("is_head", F.lit(False))), label),
        *prefixes,
        (F.col("n") >= cfg.root_token_min_repeats, F.col("token")),
        (label.rlike("^[A-Za-z0-9_-]*$"), ROOT),
    ])
    return rows.select(SNAPSHOT, MODULE, "is_internal", F.coalesce(family, F.when(~F.col("is_internal"), external).otherwise(own)).alias("namespace"))


def assign(nodes: DataFrame, cfg: Clustering) -> DataFrame:
    """(snapshot_id, module_name, is_internal, cluster, base, name): the namespace, which identifies the cluster, and its name before
    and after aliases, which two clusters may share. A snapshot with a module without a namespace, or with fewer than two
    namespaces, has none."""
    at = Window.partitionBy(SNAPSHOT)
    rows = namespaces(nodes, cfg).withColumn("whole", F.count("*").over(at) == F.count("namespace").over(at)).withColumn("kinds", F.size(F.collect_set("namespace").over(at)))
    base = F.when(F.col("namespace") == DEPS, "deps").when(F.col("namespace") == ROOT, cfg.fallback_family).otherwise(F.col("namespace"))
    rows = rows.where("whole AND kinds >= 2").select(SNAPSHOT, MODULE, "is_internal", F.col("namespace").alias("cluster"), base.alias("base"))
    return rows.withColumn("name", F.coalesce(_chain([(F.col("base") == k, F.lit(v)) for k, v in cfg.aliases.items()]), "base"))


def kind_of(cfg: Clustering) -> Column:
    """Kind of a cluster (base, name, n_internal): set for its name, or for its name in lower case, then for its family; else
    external without own modules; else by its name."""
    name, low = F.col("name"), F.lower("name")
    hints = [(name == k, F.lit(v)) for k, v in cfg.kinds.items()] + [(low == k, F.lit(v)) for k, v in cfg.kinds.items()]
    hints += [(F.col("base") == f.name, F.lit(f.kind)) for f in cfg.families if f.kind]
    return F.coalesce(_chain(hints), F.when(F.col("n_internal") == 0, "external").otherwise(kind_by_name(name)))


def links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(snapshot_id, from_cluster, to_cluster, weight, n_edges), inside clusters too."""
    of = lambda c, o: members.select(SNAPSHOT, F.col(MODULE).alias(c), F.col("cluster").alias(o))
    both = edges.join(of("from_module", "from_cluster"), [SNAPSHOT, "from_module"]).join(of("to_module", "to_cluster"), [SNAPSHOT, "to_module"])
    return both.groupBy(SNAPSHOT, "from_cluster", "to_cluster").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_edges"))


def _with_ends(rows: DataFrame, value: str, into: tuple[str, str]) -> DataFrame:
    """The rows of links (SNAPSHOT, a, b, ...) with the value of both ends; one whose end has none is left out.

    The values lie among the rows, under their key as `a` and a null `b`, so that one exchange by snapshot does what two joins
    would need three for; the rows must come from _by_snapshot.
    """
    rows = rows.withColumn(into[0], F.max(value).over(Window.partitionBy(SNAPSHOT, "a"))).withColumn("end", F.coalesce("b", "a"))
    rows = rows.withColumn(into[1], F.max(value).over(Window.partitionBy(SNAPSHOT, "end")))
    return rows.where(F.col("b").isNotNull() & F.col(into[0]).isNotNull() & F.col(into[1]).isNotNull()).drop(value, "end")


def _by_snapshot(rows: DataFrame) -> DataFrame:
    """The rows, those of a snapshot in one partition: as many partitions as the input has, so that a task sorts no more than what
    one reads."""
    n = max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, SNAPSHOT)


def delivered_links(delivered: DataFrame, members: DataFrame) -> DataFrame:
    """links() of the weights that count among stored edges (snapshot_id, from_module, to_module, delivery), with no exchange of the
    edges but one by snapshot, in which stored edges lie side by side and so take little room."""
    both = delivered.select(SNAPSHOT, F.col("from_module").alias("a"), F.col("to_module").alias("b"), "delivery", F.lit(None).cast("string").alias("cluster"))
    both = both.unionByName(members.select(SNAPSHOT, F.col(MODULE).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("decimal(38,0)").alias("delivery"), "cluster"))
    once = _by_snapshot(both).groupBy(SNAPSHOT, "a", "b").agg(F.max("delivery").alias("delivery"), F.max("cluster").alias("cluster"))
    rows = _with_ends(once.where("b IS NULL OR a != b"), "cluster", ("from_cluster", "to_cluster"))
    return rows.groupBy(SNAPSHOT, "from_cluster", "to_cluster").agg(F.sum(delivered_weight(F.col("delivery"))).alias("weight"), F.count("*").alias("n_edges"))


def clusters(members: DataFrame, linked: DataFrame, cfg: Clustering) -> DataFrame:
    """(snapshot_id, cluster, base, name, size, n_internal, n_external, weights, kind, role_rank, rank)."""
    size = members.groupBy(SNAPSHOT, "cluster").agg(F.min("base").alias("base"), F.min("name").alias("name"), F.count("*").alias("size"), F.count_if("is_internal").alias("n_internal"))
    inside = F.col("from_cluster") == F.col("to_cluster")
    sides = F.array(
        F.struct(F.col("from_cluster").alias("cluster"), F.when(inside, F.col("weight")).alias("i"), F.when(~inside, F.col("weight")).alias("o"), F.lit(None).cast("bigint").alias("b")),
        F.struct(F.col("to_cluster").alias("cluster"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("o"), F.when(~inside, F.col("weight")).alias("b")),
    )
    sums = linked.select(SNAPSHOT, F.explode(sides).alias("x")).groupBy(SNAPSHOT, F.col("x.cluster").alias("cluster")).agg(
        F.sum("x.i").alias("internal_weight"), F.sum("x.o").alias("outbound_weight"), F.sum("x.b").alias("inbound_weight")
    )
    weights = ["internal_weight", "outbound_weight", "inbound_weight"]
    rows = size.join(sums, [SNAPSHOT, "cluster"], "left").fillna(0, weights).withColumn("n_external", F.col("size") - F.col("n_internal")).withColumn("kind", kind_of(cfg))
    support = (F.col("n_external") > 3 * F.col("n_internal")) & (F.col("n_internal") <= 2)
    role = F.when((F.col("kind") == "deps") | (F.col("n_internal") == 0), 0).when(support, 1).otherwise(2)
    order = [F.col("role_rank").desc(), sum((F.col(c) for c in weights), F.lit(0)).desc(), F.col("internal_weight").desc(), F.col("size").desc(), "cluster"]
    return rows.withColumn("role_rank", role).withColumn("rank", F.row_number().over(Window.partitionBy(SNAPSHOT).orderBy(*order)))


def bridges(linked: DataFrame, of: DataFrame) -> DataFrame:
    """Links between clusters with the roles of both ends, and their rank: links of primary clusters before those with support,
    both before links with a sink."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    rows = linked.where("from_cluster != to_cluster").select(SNAPSHOT, F.col("from_cluster").alias("a"), F.col("to_cluster").alias("b"), "weight", "n_edges", none("role", "int"))
    rows = rows.unionByName(of.select(SNAPSHOT, F.col("cluster").alias("a"), none("b", "string"), none("weight", "bigint"), none("n_edges", "bigint"), F.col("role_rank").alias("role")))
    rows = _with_ends(_by_snapshot(rows), "role", ("from_role", "to_role")).withColumnsRenamed({"a": "from_cluster", "b": "to_cluster"})
    rows = rows.withColumn("role_rank", F.least("from_role", "to_role"))
    strength = [F.col("weight").desc(), F.col("n_edges").desc(), "from_cluster", "to_cluster"]
    at = Window.partitionBy(SNAPSHOT)
    return rows.withColumn("rank", F.row_number().over(at.orderBy(F.col("role_rank").desc(), *strength))).withColumn("by_weight", F.row_number().over(at.orderBy(*strength)))


def overview_edges(ranked: DataFrame) -> DataFrame:
    """(snapshot_id, from_cluster, to_cluster, weight, place, n_omitted): the strongest links of each cluster, the best bridge, and the
    strongest link of all if it leads to or from a sink; DRAWN of them, and how many links with sinks are left out."""
    own = Window.partitionBy(SNAPSHOT, "from_cluster").orderBy(F.col("weight").desc(), F.col("n_edges").desc(), "to_cluster")
    of_cluster = F.row_number().over(own) <= F.when(F.col("from_role") == 2, OF_PRIMARY).otherwise(OF_OTHERS)
    sink = F.col("role_rank") == 0
    chosen = ranked.withColumn("take", of_cluster | (F.col("rank") == 1) | ((F.col("by_weight") == 1) & sink)).where("take")
    at = Window.partitionBy(SNAPSHOT)
    placed = chosen.withColumn("place", F.row_number().over(at.orderBy("rank")))
    placed = placed.withColumn("n_omitted", F.count_if((F.col("place") > DRAWN) & sink).over(at))
    return placed.where(F.col("place") <= DRAWN).select(SNAPSHOT, "from_cluster", "to_cluster", "weight", "place", "n_omitted")


def map_summary(of: DataFrame, ranked: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row per snapshot: anchor, strongest link with its ends, the strongest link with a sink if it is heavier, and counts."""
    counts = of.groupBy(SNAPSHOT).agg(
        F.max(F.when(F.col("rank") == 1, F.col("cluster"))).alias("anchor"), F.count_if(F.col("role_rank") == 0).alias("n_sinks"),
        F.count_if((F.col("inbound_weight") == 0) & (F.col("outbound_weight") == 0)).alias("n_isolated"),
    )
    text = F.concat_ws(" -> ", "from_cluster", "to_cluster")
    best = ranked.where("rank = 1").select(SNAPSHOT, text.alias("strongest"), F.col("weight").alias("strongest_weight"))
    third = ranked.where("by_weight = 1 AND role_rank = 0 AND rank != 1").select(SNAPSHOT, text.alias("third_party"), F.col("weight").alias("third_party_weight"))
    omitted = drawn.groupBy(SNAPSHOT).agg(F.max("n_omitted").alias("n_omitted"))
    return counts.join(best, SNAPSHOT, "left").join(third, SNAPSHOT, "left").join(omitted, SNAPSHOT, "left").fillna(0, ["n_omitted"])


def member_weights(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with weight_in, weight_out and total."""
    weight = lambda d: F.sum(F.when(F.col("direction") == d, F.col("weight")).otherwise(0))
    sums = ends(edges).groupBy(SNAPSHOT, MODULE).agg(weight("in").alias("weight_in"), weight("out").alias("weight_out"))
    return members.join(sums, [SNAPSHOT, MODULE], "left").fillna(0, ["weight_in", "weight_out"]).withColumn("total", F.col("weight_in") + F.col("weight_out"))


def _first(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(SNAPSHOT, "cluster").orderBy(*order))).where("r = 1").drop("r")


def anchors(weighted: DataFrame) -> DataFrame:
    return _first(weighted, F.col("total").desc(), F.col(MODULE).desc()).select(SNAPSHOT, "cluster", F.col(MODULE).alias("anchor"))


def focus(weighted: DataFrame) -> DataFrame:
    return _first(weighted, (F.col(MODULE) != F.col("base")).cast("int"), F.col("total").desc(), MODULE).select(SNAPSHOT, "cluster", F.col(MODULE).alias("focus"))


def detail(weighted: DataFrame, linked: DataFrame) -> DataFrame:
    """(snapshot_id, cluster, part, name, total, weight_in, weight_out, rank): members, and the clusters that it links to and that
    link to it, heaviest first."""
    at = Window.partitionBy(SNAPSHOT, "cluster", "part")
    own = weighted.select(SNAPSHOT, "cluster", F.lit("member").alias("part"), F.col(MODULE).alias("name"), "total", "weight_in", "weight_out")
    between = linked.where("from_cluster != to_cluster")
    zero = F.lit(0).cast("bigint")
    to = between.select(SNAPSHOT, F.col("from_cluster").alias("cluster"), F.lit("link_out").alias("part"), F.col("to_cluster").alias("name"), F.col("weight").alias("total"), zero.alias("weight_in"), F.col("weight").alias("weight_out"))
    by = between.select(SNAPSHOT, F.col("to_cluster").alias("cluster"), F.lit("link_in").alias("part"), F.col("from_cluster").alias("name"), F.col("weight").alias("total"), F.col("weight").alias("weight_in"), zero.alias("weight_out"))
    order = at.orderBy(F.col("total").desc(), F.col("weight_in").desc(), F.col("weight_out").desc(), "name")
    return own.unionByName(to).unionByName(by).withColumn("rank", F.row_number().over(order))


def member_lens(edges: DataFrame, members: DataFrame, of: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, direction, grp, weight, n, total, n_inside): a module's links, grouped by the other module within its
    own cluster or if its cluster is a sink, else by the other's cluster; the total of the direction, and the links inside."""
    mine = members.join(of.select(SNAPSHOT, "cluster", "role_rank"), [SNAPSHOT, "cluster"]).select(SNAPSHOT, MODULE, "cluster", "role_rank")
    theirs = members.select(SNAPSHOT, F.col(MODULE).alias("other"), F.col("cluster").alias("other_cluster"))
    rows = ends(edges).join(mine, [SNAPSHOT, MODULE]).join(theirs, [SNAPSHOT, "other"])
    inside = F.col("cluster") == F.col("other_cluster")
    rows = rows.withColumn("grp", F.when(inside | (F.col("role_rank") == 0), F.col("other")).otherwise(F.col("other_cluster"))).withColumn("inside", inside.cast("bigint"))
    per = rows.groupBy(SNAPSHOT, MODULE, "direction", "grp").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.sum("inside").alias("inside"))
    way, module = Window.partitionBy(SNAPSHOT, MODULE, "direction"), Window.partitionBy(SNAPSHOT, MODULE)
    return per.select(SNAPSHOT, MODULE, "direction", "grp", "weight", "n", F.sum("weight").over(way).alias("total"), F.sum("inside").over(module).alias("n_inside"))


def sidebar(weighted: DataFrame, of: DataFrame, search: str = "") -> DataFrame:
    """(snapshot_id, place, cluster, position, module_name): clusters by role and weight, and their members, own ones first, by weight.
    With a search, only clusters whose label or members hold the text."""
    order = Window.partitionBy(SNAPSHOT).orderBy("rank")
    rows = weighted.join(of.select(SNAPSHOT, "cluster", "rank", "size"), [SNAPSHOT, "cluster"])
    if search:
        holds = lambda c: F.contains(F.lower(c), F.lit(search.lower()))
        label = F.concat(F.col("name"), F.lit(" ("), F.col("size").cast("string"), F.lit(")"))
        rows = rows.withColumn("hit", F.max(holds(F.col(MODULE)) | holds(label)).over(Window.partitionBy(SNAPSHOT, "cluster"))).where("hit")
    position = Window.partitionBy(SNAPSHOT, "cluster").orderBy(F.col("is_internal").desc(), F.col("total").desc(), MODULE)
    return rows.select(SNAPSHOT, F.dense_rank().over(order).alias("place"), "cluster", F.row_number().over(position).alias("position"), MODULE)


def hint(kind: Column) -> Column:
    return F.when(kind.isin("deps", "external"), "third-party").when(kind == "entry", "entry point").when(kind == "infra", "shared base").when(kind == "workspace", "workspace")


def overview_flag(members: DataFrame) -> DataFrame:
    n = members.groupBy(SNAPSHOT).agg(F.count("*").alias("n_labels"), F.countDistinct("cluster").alias("n_clusters"))
    return n.withColumn("overview", (F.col("n_labels") >= OVERVIEW_MODULES) & (F.col("n_clusters") >= 2) & (F.col("n_clusters") + OVERVIEW_GAIN < F.col("n_labels")))
