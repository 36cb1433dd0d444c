"""What changed between consecutive full snapshots.

Every frame of a repository delivers all its edges anew. The edges of frame n that equal those of frame n-1 are removed by
EXCEPT ALL in both directions; a full join of the two residues by edge key labels what is left as added, removed or changed.

Both differences come from one signed count, which is also how EXCEPT ALL itself is planned: each edge row of a frame counts
+1 for that frame and -1 for the next one, so a positive balance of (key, weight) is a row of `cur EXCEPT ALL prev` and a
negative one of `prev EXCEPT ALL cur`. Since both residues lie in the same table, partitioned by the key, their full join is
an aggregate by the key: of a key's residues at most one has either sign.

Frames are numbered, so that rows carry two integers instead of a repository and a commit hash. All steps group by supersets of
(repo_no, from_module, to_module), so one hash exchange on these three serves them all, and a hot module or repository is
spread over the other columns. A group holds at most one row per frame of its repository.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import module_name
from ..plans.runtime import cut, lookup

_HALF, _WHOLE = Decimal(2**63), Decimal(2**64)


def _delivery(delivered_at: Column, weight: Column) -> Column:
    """Time and weight as one number that sorts by time (null first), then weight, so that its maximum can be hash-aggregated."""
    micros = F.coalesce(F.unix_micros(delivered_at), F.lit(-(10**18))).cast("decimal(19,0)")
    return (micros * F.lit(_WHOLE).cast("decimal(20,0)") + (weight.cast("decimal(19,0)") + F.lit(_HALF).cast("decimal(19,0)"))).cast("decimal(38,0)")


def delivered_weight(delivery: Column) -> Column:
    """The weight in a delivery of named_edges."""
    return (F.pmod(delivery, F.lit(_WHOLE).cast("decimal(20,0)")) - F.lit(_HALF).cast("decimal(19,0)")).cast("bigint")


def frame_links(frames: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, repo_no, at, n): each existing frame, its place among the frames of its repository, and their number.

    Repeated frame rows count once (the smallest scan_order); rows without a key or a scan_order are no frames. Equal
    scan_orders are ordered by commit_hash.
    """
    one = (
        frames.where("repo_id IS NOT NULL AND commit_hash IS NOT NULL AND scan_order IS NOT NULL")
        .groupBy("repo_id", "commit_hash")
        .agg(F.min("scan_order").alias("scan_order"))
    )
    repos = cut(one.select("repo_id").distinct().withColumn("repo_no", F.monotonically_increasing_id()))
    w = Window.partitionBy("repo_id").orderBy("scan_order", "commit_hash")
    placed = one.select("repo_id", "commit_hash", F.row_number().over(w).alias("at"), F.count("*").over(Window.partitionBy("repo_id")).cast("int").alias("n"))
    return cut(placed.join(lookup(repos), "repo_id").select("repo_id", "commit_hash", "repo_no", "at", "n"))


def named_edges(edges: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, from_module, to_module, delivery): stored edges with both modules in the form in which they are
    compared. An edge whose end names no module is none; a null weight means 1."""
    return edges.select(
        "repo_id",
        "commit_hash",
        module_name(F.col("from_module")).alias("from_module"),
        module_name(F.col("to_module")).alias("to_module"),
        _delivery(F.col("delivered_at"), F.coalesce(F.col("weight"), F.lit(1)).cast("bigint")).alias("delivery"),
    ).where("repo_id IS NOT NULL AND commit_hash IS NOT NULL AND from_module IS NOT NULL AND to_module IS NOT NULL")


def current_edges(edges: DataFrame) -> DataFrame:
    """One row per (repo_id, commit_hash, from_module, to_module) with the weight that counts.

    Of several deliveries the latest `delivered_at` counts (null is earliest), of equal ones the greater weight.
    """
    key = ["repo_id", "commit_hash", "from_module", "to_module"]
    return named_edges(edges).groupBy(*key).agg(F.max("delivery").alias("d")).select(*key, delivered_weight(F.col("d")).alias("weight"))


def snapshot_changes(edges: DataFrame, frames: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, from_module, to_module, change_kind, old_weight, new_weight), commit_hash of the later frame.

    The first frame of a repository yields nothing; a frame without edge rows is an empty snapshot, so all edges of its
    predecessor are removed. Edges of a snapshot without a frame row are ignored. Empty tables give no rows; extra columns
    are ignored.
    """
    links = frame_links(frames)
    edge = ["repo_no", "from_module", "to_module"]
    rows = named_edges(edges).join(lookup(links), ["repo_id", "commit_hash"]).select(*edge, "at", "n", "delivery")
    current = (
        rows.repartition(*edge)
        .groupBy(*edge, "at")
        .agg(F.max("delivery").alias("d"), F.max("n").alias("n"))
        .select(*edge, "at", "n", delivered_weight(F.col("d")).alias("weight"))
    )
    # +1 where a row is in the later frame of a pair of frames, -1 where it is in the earlier one
    sides = F.array(
        F.struct(F.when(F.col("at") > 1, F.col("at")).alias("at"), F.lit(1).alias("sign")),
        F.struct(F.when(F.col("at") < F.col("n"), F.col("at") + 1).alias("at"), F.lit(-1).alias("sign")),
    )
    residues = (
        current.select(*edge, "weight", F.explode(sides).alias("x"))
        .select(*edge, "weight", F.col("x.at").alias("at"), F.col("x.sign").alias("sign"))
        .where("at IS NOT NULL")
        .groupBy(*edge, "at", "weight")
        .agg(F.sum("sign").alias("balance"))
        .where("balance != 0")
    )
    joined = residues.groupBy(*edge, "at").agg(
        F.max(F.when(F.col("balance") < 0, F.col("weight"))).alias("old_weight"), F.max(F.when(F.col("balance") > 0, F.col("weight"))).alias("new_weight")
    )
    kind = (
        F.when(F.col("old_weight").isNull(), "added").when(F.col("new_weight").isNull(), "removed").otherwise("changed")
    )
    return joined.join(lookup(links), ["repo_no", "at"]).select(
        "repo_id", "commit_hash", "from_module", "to_module", kind.alias("change_kind"), "old_weight", "new_weight"
    )
