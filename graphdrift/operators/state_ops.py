"""File states and their projection to a graph.

`rows` has one row (repo_id, frame_no, path, package_name, module_name, weight) for each import of a file in a frame;
frame_no counts a repository's frames from 1. All frames are projected at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import FIXED_PREFIXES, FIXED_ROOTS

#: Importers that make an external module visible, samples kept for an edge, and modules left out that are named.
MIN_IMPORTERS, SAMPLES, FILTERED = 3, 5, 10
FRAME = ["repo_id", "frame_no"]


def internal_nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FRAME, F.col("package_name").alias("module_name")).agg(F.countDistinct("path").alias("n_files"))


def edge_weights(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FRAME, F.col("package_name").alias("from_module"), F.col("module_name").alias("to_module")).agg(F.sum("weight").alias("weight"))


def edge_samples(rows: DataFrame) -> DataFrame:
    """The first SAMPLES paths of each edge, by name."""
    edge = [*FRAME, "from_module", "to_module"]
    paths = rows.select(*FRAME, F.col("package_name").alias("from_module"), F.col("module_name").alias("to_module"), "path").distinct()
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy(*edge).orderBy("path")))
    return ranked.where(F.col("rank") <= SAMPLES).select(*edge, "rank", "path")


def target_importers(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FRAME, "module_name").agg(F.countDistinct("package_name").alias("importer_count"))


def externals(rows: DataFrame) -> DataFrame:
    """(frame, module_name, importer_count) of imported modules that no file belongs to."""
    return target_importers(rows).join(internal_nodes(rows), [*FRAME, "module_name"], "left_anti")


def visible(rows: DataFrame) -> DataFrame:
    return externals(rows).where(F.col("importer_count") >= MIN_IMPORTERS)


def node_metadata(rows: DataFrame) -> DataFrame:
    own = internal_nodes(rows).select(*FRAME, "module_name", F.lit("internal").alias("node_kind"), F.lit(None).cast("bigint").alias("importer_count"))
    return own.unionByName(visible(rows).select(*FRAME, "module_name", F.lit("external").alias("node_kind"), "importer_count"))


def project_nodes(rows: DataFrame) -> DataFrame:
    return node_metadata(rows).select(*FRAME, "module_name")


def project(rows: DataFrame) -> DataFrame:
    """Edges between kept modules. Every source is one, so only targets that are hidden externals or the source itself go."""
    hidden = externals(rows).where(F.col("importer_count") < MIN_IMPORTERS).select(*FRAME, F.col("module_name").alias("to_module"))
    return edge_weights(rows).where("weight > 0 AND from_module != to_module").join(hidden, [*FRAME, "to_module"], "left_anti").select(*FRAME, "from_module", "to_module", "weight")


def scan_metadata(rows: DataFrame) -> DataFrame:
    seen = F.col("importer_count") >= MIN_IMPORTERS
    return externals(rows).groupBy(*FRAME).agg(
        F.lit(MIN_IMPORTERS).alias("external_min_importers"), F.count_if(seen).alias("included_external_count"), F.count_if(~seen).alias("filtered_external_count")
    )


def filtered_samples(rows: DataFrame) -> DataFrame:
    few = externals(rows).where(F.col("importer_count") < MIN_IMPORTERS)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.col("importer_count").desc(), "module_name")))
    return ranked.where(F.col("rank") <= FILTERED).select(*FRAME, "module_name", "importer_count", "rank")


def incremental(rows: DataFrame) -> DataFrame:
    """(frame, from_module, to_module, change, weight): the change of each edge's weight in a frame that has or had it, and the sum
    of all changes so far."""
    last = rows.groupBy("repo_id").agg(F.max("frame_no").alias("n"))
    sides = F.array(F.struct(F.col("frame_no").alias("at"), F.col("weight").alias("w")), F.struct((F.col("frame_no") + 1).alias("at"), (-F.col("weight")).alias("w")))
    edge = ["repo_id", "from_module", "to_module"]
    signed = rows.join(last, "repo_id").select("repo_id", "n", F.col("package_name").alias("from_module"), F.col("module_name").alias("to_module"), F.explode(sides).alias("x"))
    change = signed.where("x.at <= n").groupBy(*edge, F.col("x.at").alias("frame_no")).agg(F.sum("x.w").alias("change"))
    w = Window.partitionBy(*edge).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return change.select(*FRAME, "from_module", "to_module", "change", F.sum("change").over(w).alias("weight"))


def fallback_internal(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Modules taken for internal where no metadata says so: sources of edges, and names with a slash, of a fixed root, or with a
    fixed prefix."""
    name = F.col("module_name")
    fixed = F.contains(name, F.lit("/")) | name.isin(*FIXED_ROOTS)
    for p in FIXED_PREFIXES:
        fixed = fixed | name.startswith(p)
    return edges.select("snapshot_id", F.col("from_module").alias("module_name")).unionByName(nodes.where(fixed).select("snapshot_id", "module_name")).distinct()


def target_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FRAME, "path", "package_name").agg(F.count("*").alias("n_targets"), F.sum("weight").alias("n_imports"))


OPS = {
    "st_internal_nodes": internal_nodes,
    "st_edge_weights": edge_weights,
    "st_edge_samples": edge_samples,
    "st_target_importers": target_importers,
    "st_visible_external": visible,
    "st_project": project,
    "st_project_nodes": project_nodes,
    "st_node_metadata": node_metadata,
    "st_scan_metadata": scan_metadata,
    "st_filtered_samples": filtered_samples,
    "st_incremental": incremental,
    "ext_target_counts": target_counts,
}
