"""Filling fixed-capacity containers with items of varying length: harmonic packing.

Lengths fall into reciprocal-capacity classes: class k holds the lengths above capacity/(k+1) up to capacity/k, so any k of
them share a container, and every container of the class takes that fixed count. Alone, this leaves what k items don't use.
The count of items per length (at most `capacity` numbers, whatever the data) is therefore turned into a plan of container
patterns: the k longest items left of a class, then the longest ones of smaller classes that fit into the rest. A pattern
is repeated until one of its lengths runs out. Given the plan, workers place every item independently from its length and
its rank among the items of that length; no item is moved and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut, lookup
from .bpe import count_tokens

CAPACITY = 2048


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Rows (length, first_rank, first_container, per_container) from the number of items of each length 1..capacity.

    Items of a length with rank >= first_rank, up to the next row of that length, go per_container at a time into
    consecutive containers from first_container on. Containers are numbered from 0 without gaps.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, container = [], 0
    while (sizes := np.flatnonzero(left)).size:
        k = capacity // int(sizes[-1])
        pattern: dict[int, int] = {}
        room = capacity
        for s in sizes[::-1].tolist():  # the fixed count of the class
            if capacity // s != k or k == sum(pattern.values()):
                break
            pattern[s] = min(int(left[s]), k - sum(pattern.values()))
            room -= s * pattern[s]
        while room:  # what the class leaves, for smaller ones
            fits = np.flatnonzero(left[: room + 1])
            s = next((int(x) for x in fits[::-1] if left[x] > pattern.get(int(x), 0)), 0)
            if not s:
                break
            n = min(int(left[s]) - pattern.get(s, 0), room // s)
            pattern[s] = pattern.get(s, 0) + n
            room -= s * n
        times = min(int(left[s]) // n for s, n in pattern.items())
        for s, n in pattern.items():
            rows.append((s, int(used[s]), container, n))
            used[s] += n * times
            left[s] -= n * times
        container += times
    return rows


def items_of(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_from, n_tokens): documents as they are, those beyond the capacity cut into full pieces and a rest."""
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} AS int)")))
    return (
        sizes.select("doc_id", F.col("n_tokens").alias("whole"), F.explode(pieces).alias("piece"))
        .withColumn("token_from", F.col("piece").cast("bigint") * capacity)
        .select("doc_id", "piece", "token_from", F.least(F.col("whole") - F.col("token_from"), F.lit(capacity)).cast("bigint").alias("n_tokens"))
    )


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, token_from, n_tokens, container_id) for rows (doc_id, n_tokens).

    Every row comes out, repeated ones too, cut into pieces only beyond the capacity. Rows without tokens need no room and
    have a null container_id. An empty table gives no rows.
    """
    sizes = cut(sizes)  # ranks need rows that keep their partition and order
    items = items_of(sizes, capacity)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            n = b.column(3).to_numpy()
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order], side="left")
            local = np.empty(len(n), dtype=np.int64)
            local[order] = np.arange(len(n)) - first
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(local + seen[n])], [*b.schema.names, "part", "local"]
            )
            np.add.at(seen, n, 1)

    ranked = items.mapInArrow(rank, "doc_id bigint, piece int, token_from bigint, n_tokens bigint, part int, local bigint")
    per_part = items.groupBy(F.spark_partition_id().alias("part"), "n_tokens").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["n_tokens"]: r["n"] for r in offsets.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect() if r["n_tokens"]}
    rows = sorted(plan_patterns(counts, capacity))
    size, start, container, per = (np.array(x, dtype=np.int64) for x in (zip(*rows, strict=True) if rows else ([],) * 4))
    shift = 1 << 50
    bounds = size * shift + start

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at = b.column(3).to_numpy(), b.column(4).to_numpy()
            row = np.maximum(np.searchsorted(bounds, n * shift + at, side="right") - 1, 0)
            box = container[row] + (at - start[row]) // per[row] if len(bounds) else np.zeros(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(box, pa.int64(), mask=n == 0)], ["doc_id", "piece", "token_from", "n_tokens", "container_id"]
            )

    with_rank = ranked.join(lookup(offsets.select("part", "n_tokens", "before")), ["part", "n_tokens"]).select(
        "doc_id", "piece", "token_from", "n_tokens", (F.col("before") + F.col("local")).alias("rank")
    )
    return with_rank.mapInArrow(place, "doc_id bigint, piece int, token_from bigint, n_tokens bigint, container_id bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """pack_sizes of the documents' texts, measured in tokens."""
    return pack_sizes(count_tokens(docs, path=path), capacity)


def fill_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (n_items, n_containers, n_tokens, least_containers, fill): how full the containers are."""
    used = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    total = used.agg(F.sum("n").alias("n_items"), F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return total.select(
        "n_items",
        "n_containers",
        "n_tokens",
        "fullest",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * capacity).alias("fill"),
    )
