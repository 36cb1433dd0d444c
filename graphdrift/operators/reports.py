"""The point-in-time report on snapshots, all of them at once, as rows (snapshot_id, section, rank, item, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions.labels import prefix_rule
from . import graph_algorithms as A
from .scoring import COMPONENTS, SNAPSHOT, boundary_list, cyclic_components

#: How many earlier frames, crossings, cut vertices, impacts and chains the report shows.
EARLIER, CROSSINGS, CUTS, IMPACTS, CHAINS = 3, 10, 5, 5, 3
#: Debt above which a component is recommended for work, and totals up to which the whole is called great or healthy.
ADVISE, GREAT, HEALTHY = 20.0, 15, 30


def _section(df: DataFrame, section: str, rank: Column, item: Column, value: Column) -> DataFrame:
    return df.select(SNAPSHOT, F.lit(section).alias("section"), rank.cast("int").alias("rank"), item.cast("string").alias("item"), F.round(value.cast("double"), 6).alias("value"))


def _top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(SNAPSHOT).orderBy(*order))).where(F.col("rank") <= k)


def temporal(frames: DataFrame) -> DataFrame:
    """(snapshot_id, rank, commit_hash, change): the EARLIER frames before each one, nearest first, and the change of the stored
    total since. Offsets within an ordered window, so no frame is joined with another."""
    w = Window.partitionBy("repo_id").orderBy("scan_order", "commit_hash")
    back = F.array(*[F.struct(F.lit(i).alias("rank"), F.lag("commit_hash", i).over(w).alias("commit_hash"), F.lag("total", i).over(w).alias("before")) for i in range(1, EARLIER + 1)])
    each = frames.select(SNAPSHOT, "total", back.alias("back")).select(SNAPSHOT, "total", F.explode("back").alias("x")).where("x.commit_hash IS NOT NULL")
    return each.select(SNAPSHOT, "x.rank", "x.commit_hash", (F.col("total") - F.col("x.before")).alias("change"))


def crossings(edges: DataFrame, cfg: Scoring) -> DataFrame:
    """boundary_list under the configured rules, or under the fixed prefix rules where none is configured."""
    if cfg.boundaries:
        return boundary_list(edges, cfg, CROSSINGS)
    found = edges.where(prefix_rule(F.col("from_module"), F.col("to_module")))
    return _top(found.withColumn("n_found", F.count("*").over(Window.partitionBy(SNAPSHOT))), CROSSINGS, "from_module", "to_module")


def recommendations(drift: DataFrame) -> DataFrame:
    """(snapshot_id, rule_id, value): components to work on, what the total says, or 'acceptable' where neither applies."""
    advised = F.array(*[F.when(F.col(f"{c}_debt") > ADVISE, F.struct(F.lit(c).alias("rule_id"), F.col(f"{c}_debt").cast("double").alias("value"))) for c in COMPONENTS])
    total = F.struct(F.when(F.col("total") <= GREAT, "great").when(F.col("total") <= HEALTHY, "healthy").alias("rule_id"), F.col("total").cast("double").alias("value"))
    all_ = F.array_compact(F.concat(advised, F.array(F.when(F.col("total") <= HEALTHY, total))))
    none = F.array(F.struct(F.lit("acceptable").alias("rule_id"), F.col("total").cast("double").alias("value")))
    return drift.select(SNAPSHOT, F.explode(F.when(F.size(all_) > 0, all_).otherwise(none)).alias("x")).select(SNAPSHOT, "x.rule_id", "x.value")


def chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The section chains, which needs nothing but the graph."""
    return _section(A.critical_paths(edges, nodes, CHAINS), "chains", F.col("rank"), F.col("chain"), F.col("total_weight"))


def analyze(edges: DataFrame, nodes: DataFrame, frames: DataFrame, scc: DataFrame, drift: DataFrame, blast: DataFrame, cfg: Scoring | None = None, snapshot_id: str | None = None) -> DataFrame:
    """The sections drift, temporal, boundaries, cycles, cut_vertices, impacts, chains and recommendations of one snapshot or all.

    `drift` and `blast` are the results of scoring.drift and graph_algorithms.blast_all. Ranks start at 1 and equal rows are
    ordered by name; a section without findings has no row.
    """
    cfg = cfg or Scoring()
    if snapshot_id is not None:
        edges, nodes, scc, drift, blast = (df.where(F.col(SNAPSHOT) == snapshot_id) for df in (edges, nodes, scc, drift, blast))
    numbers = [c for c in drift.columns if c not in (SNAPSHOT, "timestamp")]
    debts = drift.select(SNAPSHOT, F.explode(F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for i, c in enumerate(numbers)])).alias("x"))
    earlier = temporal(frames)
    if snapshot_id is not None:
        earlier = earlier.where(F.col(SNAPSHOT) == snapshot_id)
    cuts = _top(A.articulation(edges, nodes), CUTS, F.col("components_bridged").desc(), "module_name")
    hits = _top(blast, IMPACTS, F.round("score", 9).desc(), "module_name")
    cross = crossings(edges, cfg)
    rec = _top(recommendations(drift), 100, "rule_id")
    one, keystone = F.lit(1), F.when(F.col("is_articulation_point"), F.lit(" [keystone]")).otherwise("")
    parts = [
        _section(debts, "drift", F.col("x.rank"), F.col("x.item"), F.col("x.value")),
        _section(earlier, "temporal", F.col("rank"), F.col("commit_hash"), F.col("change")),
        _section(cross, "boundaries", F.col("rank"), F.concat_ws(" -> ", "from_module", "to_module"), F.col("n_found")),
        _section(cyclic_components(scc).groupBy(SNAPSHOT).agg(F.count("*").alias("n")), "cycles", one, F.lit("n_cycles"), F.col("n")),
        _section(cuts, "cut_vertices", F.col("rank"), F.col("module_name"), F.col("components_bridged")),
        _section(hits, "impacts", F.col("rank"), F.concat("module_name", keystone), F.col("score")),
        chains(edges, nodes),
        _section(rec, "recommendations", F.col("rank"), F.col("rule_id"), F.col("value")),
    ]
    return reduce(DataFrame.unionByName, parts)
