"""Snapshots kept as checkpoints and deltas, and rebuilt from them, for all frames of all repositories at once.

A state is a set of rows (repo_id, frame_no, key..., value) with frames numbered from 1. Deltas come from one ordered window
per key, not from comparing whole frames; a snapshot is rebuilt from the checkpoint before it and the deltas since, so the
work is spread over (repository, checkpoint, key) and no chain is longer than the distance between checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store_queries import CHECKPOINT_EVERY


def numbered(frames: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, frame_no, n_frames) in the order of scan_order, then hash."""
    w = Window.partitionBy("repo_id").orderBy("scan_order", "commit_hash")
    return frames.select("repo_id", "commit_hash", F.row_number().over(w).alias("frame_no"), F.count("*").over(Window.partitionBy("repo_id")).cast("int").alias("n_frames"))


def segments(frames_no: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """(repo_id, frame_no, checkpoint, next_checkpoint): the checkpoint that each frame starts from, and the frame before which it
    ends. The first frame, every `every`-th and the last one are checkpoints."""
    k, n = F.col("frame_no"), F.col("n_frames")
    w = Window.partitionBy("repo_id").orderBy("frame_no")
    at = frames_no.withColumn("is_checkpoint", (k == 1) | (k % every == 0) | (k == n))
    at = at.withColumn("checkpoint", F.max(F.when(F.col("is_checkpoint"), k)).over(w))
    ends = F.coalesce(F.min(F.when(F.col("is_checkpoint"), k)).over(w.rowsBetween(1, Window.unboundedFollowing)), n + 1)
    return at.select("repo_id", "commit_hash", "frame_no", "checkpoint", ends.alias("next_checkpoint"))


def deltas(rows: DataFrame, frames_no: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """(repo_id, frame_no, key..., op, value...): 'upsert' where a key appears or changes its value, 'delete' (with null values)
    in the frame after the last one that has it. The first frame is all upserts."""
    w = Window.partitionBy("repo_id", *key).orderBy("frame_no")
    last = frames_no.groupBy("repo_id").agg(F.max("frame_no").alias("_n"))
    v = F.struct(*value) if value else F.lit(0)
    seen = rows.withColumn("_v", v).withColumn("_b", F.lag("frame_no").over(w)).withColumn("_bv", F.lag("_v").over(w)).withColumn("_a", F.lead("frame_no").over(w)).join(last, "repo_id")
    new = F.col("_b").isNull() | (F.col("_b") != F.col("frame_no") - 1) | ~F.col("_v").eqNullSafe(F.col("_bv"))
    gone = (F.coalesce("_a", F.lit(-1)) != F.col("frame_no") + 1) & (F.col("frame_no") < F.col("_n"))
    ops = F.array(
        F.when(new, F.struct(F.col("frame_no").alias("at"), F.lit("upsert").alias("op"))), F.when(gone, F.struct((F.col("frame_no") + 1).alias("at"), F.lit("delete").alias("op")))
    )
    each = seen.withColumn("_x", F.explode(F.array_compact(ops)))
    kept = [F.when(F.col("_x.op") == "upsert", F.col(c)).alias(c) for c in value]
    return each.select("repo_id", F.col("_x.at").alias("frame_no"), *key, F.col("_x.op").alias("op"), *kept)


def rebuild(checkpoints: DataFrame, changes: DataFrame, segs: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """(repo_id, frame_no, key..., value...) of every frame, from the rows of the checkpoint frames and the deltas of all others."""
    cols = ["repo_id", "frame_no", *key, "op", *value]
    base = checkpoints.withColumn("op", F.lit("upsert")).select(cols)
    # at a checkpoint only its own rows count
    of = segs.select("repo_id", "frame_no", "checkpoint", "next_checkpoint")
    between = changes.select(cols).join(of.where("frame_no != checkpoint"), ["repo_id", "frame_no"])
    placed = base.join(of.where("frame_no = checkpoint"), ["repo_id", "frame_no"]).unionByName(between)
    w = Window.partitionBy("repo_id", "checkpoint", *key).orderBy("frame_no")
    held = placed.withColumn("_to", F.coalesce(F.lead("frame_no").over(w), F.col("next_checkpoint"))).where("op = 'upsert'")
    return held.select("repo_id", F.explode(F.sequence(F.col("frame_no"), F.col("_to") - 1)).alias("frame_no"), *key, *value)


def apply_deltas(state: DataFrame, changes: DataFrame, frames_no: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """(repo_id, frame_no, key..., value...) for frames from the second on: the state of the frame before with its deltas applied."""
    at = ["repo_id", "frame_no", *key]
    more = frames_no.where("frame_no < n_frames").select("repo_id", "frame_no")
    before = state.join(more, ["repo_id", "frame_no"]).withColumn("frame_no", F.col("frame_no") + 1)
    kept = before.join(changes.select(at), at, "left_anti")
    new = changes.where("op = 'upsert' AND frame_no > 1")
    return kept.select(*at, *value).unionByName(new.select(*at, *value))


def versions(changes: DataFrame, key: list[str]) -> DataFrame:
    """(repo_id, key..., valid_from, valid_to): the frames between which a version of a key is valid; the last one is open."""
    w = Window.partitionBy("repo_id", *key).orderBy("frame_no")
    return changes.withColumn("valid_to", F.lead("frame_no").over(w)).where("op = 'upsert'").select("repo_id", *key, F.col("frame_no").alias("valid_from"), "valid_to")
