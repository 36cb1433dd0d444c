"""Row count and total weight for every module that edges point to, and the modules that draw most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import module_name
from .balanced import fragment_replicate_join

#: A module that holds more than this share of the rows draws too much.
HOT_SHARE = 0.02


def module_totals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(to_module, row_count, total_weight, n_nodes, n_internal) over all stored rows of edges.

    Modules are named in normal form; rows whose to_module names none are left out. A null weight means 1. n_nodes and
    n_internal count the node rows of that name (0 where there are none). Empty tables give no rows.
    """
    fact = edges.select(
        module_name(F.col("to_module")).alias("to_module"), F.coalesce(F.col("weight"), F.lit(1)).cast("bigint").alias("weight")
    ).where("to_module IS NOT NULL")
    side = (
        nodes.select(module_name(F.col("module_name")).alias("to_module"), "node_kind")
        .where("to_module IS NOT NULL")
        .groupBy("to_module")
        .agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node_kind") == "internal").alias("n_internal"))
    )
    placed = fragment_replicate_join(fact, side, "to_module", "left", hash_side=True)
    shards = placed.groupBy("_task", "to_module").agg(
        F.count("*").alias("row_count"),
        F.sum("weight").alias("total_weight"),
        F.max("n_nodes").alias("n_nodes"),
        F.max("n_internal").alias("n_internal"),
    )
    return shards.groupBy("to_module").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("total_weight").alias("total_weight"),
        F.coalesce(F.max("n_nodes"), F.lit(0)).cast("bigint").alias("n_nodes"),
        F.coalesce(F.max("n_internal"), F.lit(0)).cast("bigint").alias("n_internal"),
    )


def hot_modules(edges: DataFrame, nodes: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """(to_module) for modules holding more than `share` of the rows that name a module."""
    whole = edges.where(module_name(F.col("to_module")).isNotNull()).count()
    return module_totals(edges, nodes).where(F.col("row_count") > F.lit(whole) * F.lit(share)).select("to_module")
