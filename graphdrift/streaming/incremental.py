"""Incremental maintenance of edge weights from a stream of file changes.

A change is (repo_id, path, seq, op, package_name, targets): the file's new list of targets, or its removal. The state of
a file is its last package and targets; each change retracts them and adds the new ones, as signed rows
(repo_id, from_module, to_module, weight). Edge weights are the running sums of those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "repo_id string, from_module string, to_module string, weight bigint, seq bigint"
STATE = "seq bigint, package string, targets array<string>"


def _signed(repo: str, package: str | None, targets, sign: int, seq: int) -> list[tuple]:
    return [(repo, package, t, sign, seq) for t in (targets if targets is not None else []) if package is not None and t != package]


def signed_changes(changes: DataFrame) -> DataFrame:
    """The signed edge rows of a stream of changes; a change older than the file's state is dropped, equal ones count once."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        repo = key[0]
        seq, package, targets = state.get if state.exists else (-1, None, [])
        out: list[tuple] = []
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if row.seq <= seq:
                continue
            out += _signed(repo, package, targets, -1, int(row.seq))
            seq = int(row.seq)
            package, targets = (None, []) if row.op == "delete" else (row.package_name, list(row.targets) if row.targets is not None else [])
            out += _signed(repo, package, targets, 1, seq)
        state.update((seq, package, list(targets)))
        yield pd.DataFrame(out, columns=["repo_id", "from_module", "to_module", "weight", "seq"])

    return changes.groupBy("repo_id", "path").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def signed_changes_batch(changes: DataFrame) -> DataFrame:
    """The same rows for a finite table of changes, by window functions."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id", "path").orderBy("seq")
    once = changes.groupBy("repo_id", "path", "seq").agg(F.min(F.struct("op", "package_name", "targets")).alias("c")).select("repo_id", "path", "seq", "c.*")
    alive = once.withColumn("package_name", F.when(F.col("op") != "delete", F.col("package_name")))
    pair = alive.withColumn("old", F.lag(F.struct("package_name", "targets")).over(w))
    rows = pair.select("repo_id", "seq", "package_name", F.explode("targets").alias("to_module"), F.lit(1).alias("weight")).unionByName(
        pair.select("repo_id", "seq", F.col("old.package_name").alias("package_name"), F.explode("old.targets").alias("to_module"), F.lit(-1).alias("weight"))
    )
    return rows.where("package_name IS NOT NULL AND to_module != package_name").select(
        "repo_id", F.col("package_name").alias("from_module"), "to_module", F.col("weight").cast("bigint").alias("weight"), "seq"
    )


def edge_weights(signed: DataFrame) -> DataFrame:
    """(repo_id, from_module, to_module, weight) of the edges that remain."""
    return signed.groupBy("repo_id", "from_module", "to_module").agg(F.sum("weight").alias("weight")).where("weight > 0")


def run_available(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, appending signed rows to a Parquet folder; each batch is written to its own folder, so that a
    repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = signed_changes(changes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
