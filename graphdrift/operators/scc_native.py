"""Strongly connected components as joins: for graphs too large for one task.

Repeat on the modules that are left: drop those without an in- or an out-edge (components of one); spread the smallest number
forward to a fixpoint, which colours each module by the smallest one that reaches it; within a colour walk back from the
module that gave it. What is reached is one component. All snapshots advance together.

Snapshots and names are numbered once, and all rounds move numbers only. What a round leaves is kept as Parquet and replaces
what the round before left, so the disk holds the edges about once, however many rounds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import BROADCAST_ROWS, Scratch, at_most
from .scoring import MODULE, SNAPSHOT

KEY = ["s", "v"]


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _side(df: DataFrame) -> DataFrame:
    """df as a side of a join: broadcast if a count proves it small, else never, as its files are smaller than its rows."""
    return F.broadcast(df) if at_most(df, BROADCAST_ROWS) else df.hint("merge")


def _numbered(df: DataFrame, c: str, number: str) -> DataFrame:
    return df.select(F.col(df.columns[0]).alias(c)).distinct().withColumn(number, F.monotonically_increasing_id())


def _coded(df: DataFrame, snapshots: DataFrame, names: DataFrame, *cols: str) -> DataFrame:
    df = df.join(snapshots, SNAPSHOT).drop(SNAPSHOT)
    for c in cols:
        df = df.join(names.select(F.col("name").alias(c), "no"), c).drop(c).withColumnRenamed("no", c)
    return df


def _ends(edges: DataFrame) -> DataFrame:
    """(s, v, goes, comes): both ends of each edge; a self-edge neither goes nor comes."""
    other = F.col("a") != F.col("b")
    end = lambda c, goes, comes: F.struct(F.col(c).alias("v"), goes.alias("goes"), comes.alias("comes"))
    return edges.select("s", F.explode(F.array(end("a", other, F.lit(False)), end("b", F.lit(False), other))).alias("x")).select("s", "x.*")


def _modules(ends: DataFrame) -> DataFrame:
    return ends.groupBy(*KEY).agg(F.max("goes").alias("goes"), F.max("comes").alias("comes"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    gone = _side(gone.select(*KEY))
    return edges.join(gone.withColumnRenamed("v", "a"), ["s", "a"], "left_anti").join(gone.withColumnRenamed("v", "b"), ["s", "b"], "left_anti").select("s", "a", "b")


def _lower(new: Column) -> list[Column]:
    """Colour `c`, lowered to `new` if that is smaller, and whether it was."""
    return [F.least("c", F.coalesce(new, "c")).alias("c"), F.coalesce(new < F.col("c"), F.lit(False)).alias("moved")]


def scc_native(edges: DataFrame, nodes: DataFrame, rounds: int = 1000) -> DataFrame:
    """(snapshot_id, module_name, scc_id): scc_id is the smallest name of the component. Edges and nodes may repeat."""
    kept = Scratch(edges.sparkSession)
    named = edges.select(SNAPSHOT, F.col("from_module").alias("a"), F.col("to_module").alias("b"))
    own = nodes.select(SNAPSHOT, F.col(MODULE).alias("v"))
    snapshots = kept.keep("snapshots", _numbered(named.select(SNAPSHOT).union(own.select(SNAPSHOT)), SNAPSHOT, "s"))
    names = kept.keep("names", _numbered(named.select("a").union(named.select("b")).union(own.select("v")), "name", "no"))
    snapshots, names = _side(snapshots), _side(names)
    e = kept.keep("edges", _coded(named, snapshots, names, "a", "b").select("s", "a", "b"))
    alone = _coded(own, snapshots, names, "v").select("s", "v", F.lit(False).alias("goes"), F.lit(False).alias("comes"))
    every = left = kept.keep("every", _modules(_ends(e).unionByName(alone)))
    e, single = e.where("a != b"), F.expr("NOT (goes AND comes)")
    gone = left.where(single)
    found: list[DataFrame] = []
    for n in range(rounds):
        while True:  # trim
            e = kept.keep("edges", _without(e, gone))
            left = kept.keep("left", _modules(_ends(e)))
            gone = left.where(single)
            if not _any(gone):
                break
        if not _any(left):
            break
        # forward: all send in the first round, then those whose colour has changed
        colour = e.groupBy("s", F.col("b").alias("v")).agg(F.min("a").alias("sent")).withColumn("c", F.col("v"))
        colour = kept.keep("colour", colour.select(*KEY, *_lower(F.col("sent"))))
        while _any(colour.where("moved")):
            front = colour.where("moved").select("s", F.col("v").alias("a"), "c")
            sent = e.join(_side(front), ["s", "a"]).groupBy("s", F.col("b").alias("v")).agg(F.min("c").alias("sent"))
            colour = kept.keep("colour", colour.join(sent, KEY, "left").select(*KEY, *_lower(F.col("sent"))))
        of = _side(colour.select(*KEY, "c"))
        both = e.join(of.withColumnRenamed("v", "a"), ["s", "a"]).join(of.select("s", F.col("v").alias("b"), F.col("c").alias("cb")), ["s", "b"])
        inner = kept.keep("inner", both.where("c = cb").select("s", "a", "b", "c"))
        hit = frontier = kept.keep(f"hit{n}_0", colour.where("v = c").select(*KEY, "c"))
        step = 0
        while _any(frontier):  # backward
            step += 1
            new = inner.join(_side(frontier.select("s", F.col("v").alias("b"))), ["s", "b"]).select("s", F.col("a").alias("v"), "c").distinct()
            frontier = kept.keep(f"hit{n}_{step}", new.join(_side(hit.select(*KEY)), KEY, "left_anti"))
            hit = hit.unionByName(frontier)
        found.append(hit)
        gone = hit
    else:
        raise RuntimeError("components did not settle")
    for name in ("edges", "left", "colour", "inner"):
        kept.drop(name)
    name_of = names.select(F.col("no").alias("v"), F.col("name").alias(MODULE))
    out = every.select(*KEY).join(name_of, "v").join(snapshots, "s")
    if not found:
        return out.select(SNAPSHOT, MODULE, F.col(MODULE).alias("scc_id"))
    parts = found[0]
    for f in found[1:]:
        parts = parts.unionByName(f)
    least = parts.join(name_of, "v").groupBy("s", "c").agg(F.min(MODULE).alias("scc_id"))
    parts = kept.keep("parts", parts.join(least, ["s", "c"]).select(*KEY, "scc_id"))
    return out.join(_side(parts), KEY, "left").select(SNAPSHOT, MODULE, F.coalesce("scc_id", MODULE).alias("scc_id"))
