"""Per-key work without a few keys dominating the run: fragment-replicate by estimated load.

1. The load of each key is estimated from a fixed fraction of the rows, combined map-side.
2. Keys above a fair share of a task are split into proportionate shards, keys above 1/BUCKETS_PER_TASK of it are packed as
   they are, and all others fall into `BUCKETS_PER_TASK` hash buckets per task. Shards, keys and buckets are bin-packed to
   tasks, largest first onto the least loaded one. The plan has at most 2 * BUCKETS_PER_TASK rows per task, whatever the
   data, and is broadcast as two small tables.
3. Rows of a split key go to its shards in turn, the matching side is replicated to those shards only, and both sides are
   shuffled straight to the packed task ids. Results per shard are merged per key at the end.

The estimate only steers placement: any estimate gives the same result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut

BUCKETS_PER_TASK = 8
LOAD_FRACTION = 0.1


def pack(loads: list[tuple[object, float]], tasks: int) -> dict[object, int]:
    """Item -> task: items in descending load, each onto the task with the least load so far."""
    heap = [(0.0, t) for t in range(tasks)]
    placed = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        total, t = heapq.heappop(heap)
        placed[item] = t
        heapq.heappush(heap, (total + load, t))
    return placed


class LoadPlan:
    """Where rows of a key column go. `own`: key -> tasks of its shards, for keys packed by themselves; `bucket_task`: task of
    each bucket of the other keys."""

    def __init__(self, tasks: int, own: dict[str, list[int]], bucket_task: list[int]):
        self.tasks, self.own, self.bucket_task = tasks, own, bucket_task

    def _placed(self, df: DataFrame, key: str) -> DataFrame:
        """df with `_shards`, the tasks of the key's shards or of its bucket."""
        spark = df.sparkSession
        keys = spark.createDataFrame(list(self.own.items()), f"`{key}` string, _own array<int>")
        buckets = spark.createDataFrame([(i, [t]) for i, t in enumerate(self.bucket_task)], "_bucket bigint, _of_bucket array<int>")
        out = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(len(self.bucket_task))).cast("bigint"))
        out = out.join(F.broadcast(buckets), "_bucket").join(F.broadcast(keys), key, "left")
        return out.withColumn("_shards", F.coalesce("_own", "_of_bucket")).drop("_bucket", "_of_bucket", "_own")

    def fragment(self, df: DataFrame, key: str) -> DataFrame:
        """df with `_task`; the rows of a split key take its shards in turn, those with a null key all tasks in turn."""
        turn = F.monotonically_increasing_id()
        shard = F.get("_shards", F.pmod(turn, F.size("_shards").cast("bigint")).cast("int"))
        task = F.when(F.col(key).isNull(), F.pmod(turn, F.lit(self.tasks)).cast("int")).otherwise(shard)
        return self._placed(df, key).withColumn("_task", task).drop("_shards").repartitionById(self.tasks, F.col("_task"))

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """df with `_task`; each row of a split key once for every task that holds a shard of it."""
        out = self._placed(df, key).withColumn("_task", F.explode("_shards")).drop("_shards")
        return out.repartitionById(self.tasks, F.col("_task"))


def plan_loads(df: DataFrame, key: str, tasks: int | None = None, fraction: float = LOAD_FRACTION) -> LoadPlan:
    """The placement of df's rows by `key` on `tasks` tasks (default: shuffle partitions). Null keys are no load."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = tasks * BUCKETS_PER_TASK
    loads = (
        df.where(F.col(key).isNotNull()).select(key).sample(fraction=fraction, seed=7).groupBy(key).agg(F.count("*").alias("n"))
    )
    loads = cut(loads)
    share = max((loads.agg(F.sum("n")).first()[0] or 0) / tasks, 1.0)
    least = share / BUCKETS_PER_TASK
    own = {r[0]: r[1] for r in loads.where(F.col("n") > least).collect()}  # fewer than n_buckets keys exceed this
    light = (
        loads.where(F.col("n") <= least)
        .groupBy(F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int").alias("b"))
        .agg(F.sum("n").alias("n"))
        .collect()  # at most n_buckets rows
    )
    items: list[tuple[object, float]] = []
    for k, n in own.items():
        pieces = min(-(-n // int(share)), tasks)
        items += [((k, i), n / pieces) for i in range(pieces)]
    by_bucket = {r["b"]: r["n"] for r in light}
    items += [(b, float(by_bucket.get(b, 0))) for b in range(n_buckets)]
    placed = pack(items, tasks)
    shards: dict[str, set[int]] = {k: set() for k in own}
    for item, task in placed.items():
        if isinstance(item, tuple):
            shards[item[0]].add(task)
    return LoadPlan(tasks, {k: sorted(ts) for k, ts in shards.items()}, [placed[b] for b in range(n_buckets)])


def fragment_replicate_join(
    fact: DataFrame, side: DataFrame, key: str, how: str = "left", plan: LoadPlan | None = None, hash_side: bool = False
) -> DataFrame:
    """fact joined to side on `key`, placed by load; keeps `_task`, the task a row was sent to.

    `how` is 'inner' or 'left'. Null keys match nothing. Columns of both sides other than `key` must differ in name.
    hash_side builds a hash table of a task's share of side instead of sorting both; for sides with one row per key.
    """
    plan = plan or plan_loads(fact, key)
    right = plan.replicate(side, key)
    return plan.fragment(fact, key).join(right.hint("shuffle_hash") if hash_side else right, ["_task", key], how)
