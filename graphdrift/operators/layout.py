"""Places of modules and of clusters, one graph a task, the same in every run.

Repulsion between many modules is summed over a pyramid of grids: on each level a module meets the cells near its own parent
cell that aren't next to its own one, as if all their modules stood at their centre, and only modules of adjacent cells of the
finest level meet each other. So a step takes in the order of n log n, and memory grows with n.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import SNAPSHOT

#: Modules up to which all pairs are summed, modules of a finest cell, and levels of the pyramid.
DENSE, FULL_CELL, LEVELS = 256, 16, 12
SOFT = 0.05


def dense_repulsion(pos: np.ndarray, on: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The push of the points `on` (with weights) on each of `pos`, falling with the distance."""
    gap = pos[:, None] - on[None]
    pull = (gap**2).sum(axis=2) + SOFT
    return (gap / pull[..., None] * (1.0 if weight is None else weight[None, :, None])).sum(axis=1)


def repulsion(pos: np.ndarray) -> np.ndarray:
    n = len(pos)
    if n <= DENSE:
        return dense_repulsion(pos, pos)
    low = pos.min(axis=0)
    unit = (pos - low) / max(float((pos - low).max()), 1e-9) * (1 - 1e-9)
    force = np.zeros_like(pos)
    for level in range(2, LEVELS + 1):
        size = 1 << level
        cell = (unit * size).astype(np.int64)
        at = cell[:, 0] * size + cell[:, 1]
        order = np.argsort(at, kind="stable")
        cells, first, count = np.unique(at[order], return_index=True, return_counts=True)
        centre = np.add.reduceat(pos[order], first, axis=0) / count[:, None]
        corner = (cell // 2 - 1) * 2
        for dx in range(6):
            for dy in range(6):
                other = corner + (dx, dy)
                far = (np.abs(other - cell).max(axis=1) > 1) & (other >= 0).all(axis=1) & (other < size).all(axis=1)
                key = other[:, 0] * size + other[:, 1]
                place = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
                hit = np.flatnonzero(far & (cells[place] == key))
                gap = pos[hit] - centre[place[hit]]
                force[hit] += gap / ((gap**2).sum(axis=1) + SOFT)[:, None] * count[place[hit], None]
        if count.max() <= FULL_CELL or level == LEVELS:
            break
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            other = cell + (dx, dy)
            key = np.where((other >= 0).all(axis=1) & (other < size).all(axis=1), other[:, 0] * size + other[:, 1], -1)
            place = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
            many = np.where(cells[place] == key, count[place], 0)
            if level == LEVELS:  # a crowd that no grid parts stands at its centre
                crowd = np.flatnonzero(many > FULL_CELL)
                gap = pos[crowd] - centre[place[crowd]]
                force[crowd] += gap / ((gap**2).sum(axis=1) + SOFT)[:, None] * many[crowd, None]
                many = np.where(many > FULL_CELL, 0, many)
            me = np.repeat(np.arange(n), many)
            them = order[np.repeat(first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            gap = pos[me] - pos[them]
            push = gap / ((gap**2).sum(axis=1) + SOFT)[:, None]
            force[:, 0] += np.bincount(me, push[:, 0], n)
            force[:, 1] += np.bincount(me, push[:, 1], n)
    return force


def force_layout(labels: set[str], edges: dict[tuple[str, str], int], steps: int = 120, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Places by repulsion, springs along edges and gravity, from a seeded circle with jitter; the same for the same graph."""
    names = sorted(labels)
    at = {x: i for i, x in enumerate(names)}
    n = len(names)
    if not n:
        return {}
    rng = np.random.default_rng(seed)
    turn = np.arange(n) * 2 * math.pi / n
    pos = np.stack([np.cos(turn), np.sin(turn)], axis=1) * 10 * math.sqrt(max(1.0, n / DENSE)) + rng.normal(0, 0.1, (n, 2))
    old = pos.copy()
    links = sorted(edges)
    a, b = (np.array([at[e[k]] for e in links], dtype=int) for k in (0, 1))
    w = np.log1p(np.array([edges[e] for e in links], dtype=float))
    for step in range(steps):
        force = repulsion(pos) * 2 - pos * 0.03
        if len(a):
            pull = (pos[b] - pos[a]) * (0.02 * w)[:, None]
            np.add.at(force, a, pull)
            np.add.at(force, b, -pull)
        keep = 0.9 * 0.997**step
        pos, old = pos + (pos - old) * keep * 0.5 + np.clip(force, -5, 5) * 0.1, pos
    return {x: (float(pos[i, 0]), float(pos[i, 1])) for x, i in at.items()}


# Fixed values of the overview, as shares of its width and height: centre, radii of the ring, where sinks and support
# clusters are drawn to, the frame, the rest lengths of links; then strengths and rounds.
CENTRE, RADII, SINK_AT, SUPPORT_AT = (0.50, 0.52), (0.24, 0.28), (0.78, 0.82), (0.62, 0.58)
FRAME, REST = ((0.10, 0.14), (0.90, 0.90)), (0.22, 0.14)
PUSH, NEAREST, PULL, DRAW, STEP, ROUNDS = 4200.0, 64.0, 0.045, (0.030, 0.018), (0.08, 0.05), 36


def overview_places(size: np.ndarray, role: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, width: float, height: float) -> np.ndarray:
    """Places of clusters, given in the order of their rank: on a ring from the top, then ROUNDS of push, pull along links and draw
    towards the side of their role. `role` is 0 for sinks, 1 for support, 2 for primary clusters."""
    box = np.array([width, height])
    n = len(size)
    turn = -math.pi / 2 + np.arange(n) / max(n, 1) * 2 * math.pi
    pos = (np.array(CENTRE) + np.stack([np.cos(turn), np.sin(turn)], axis=1) * RADII) * box
    sink, support = role == 0, role == 1
    pos[:, 0] = np.where(sink, SINK_AT[0] * width, np.where(support, (pos[:, 0] + SUPPORT_AT[0] * width) / 2, pos[:, 0]))
    home = np.stack([np.where(sink, SINK_AT[1], np.where(support, SUPPORT_AT[1], CENTRE[0])) * width, np.full(n, CENTRE[1] * height)], axis=1)
    draw = np.where(sink, *DRAW)[:, None]
    rest = np.where(sink[a] | sink[b], *REST) * width
    strength = np.sqrt(np.maximum(weight, 1.0)) * PULL
    stride = 1 + np.sqrt(size)[:, None] * STEP
    for _ in range(ROUNDS):
        gap = pos[:, None] - pos[None]
        far = np.maximum((gap**2).sum(axis=2), NEAREST)
        force = (gap * (PUSH / far**1.5)[..., None]).sum(axis=1) + (home - pos) * draw
        along = pos[b] - pos[a]
        length = np.maximum(np.sqrt((along**2).sum(axis=1)), 1.0)
        pull = along * ((length - rest) / rest * strength / length)[:, None]
        np.add.at(force, a, pull)
        np.add.at(force, b, -pull)
        pos = np.clip(pos + force * stride, np.array(FRAME[0]) * box, np.array(FRAME[1]) * box)
    return pos


def overview(clusters: DataFrame, bridges: DataFrame, width: float = 1000.0, height: float = 600.0) -> DataFrame:
    """(snapshot_id, cluster, x, y): the overview's places of each snapshot's clusters (see cluster_ops.clusters and bridges)."""
    rows = clusters.select(SNAPSHOT, F.col("cluster").alias("a"), F.lit(None).cast("string").alias("b"), "rank", F.col("size").cast("double").alias("v"), F.col("role_rank").alias("r"))
    rows = rows.unionByName(bridges.select(SNAPSHOT, F.col("from_cluster").alias("a"), F.col("to_cluster").alias("b"), F.lit(0).alias("rank"), F.col("weight").cast("double").alias("v"), F.lit(0).alias("r")))

    def place(key: tuple[str, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["b"].isna()].sort_values("rank"), pdf[pdf["b"].notna()].sort_values(["a", "b"])
        at = {c: i for i, c in enumerate(own["a"])}
        a, b = (links[c].map(at).to_numpy(dtype=np.int64) for c in ("a", "b"))
        pos = overview_places(own["v"].to_numpy(), own["r"].to_numpy(), a, b, links["v"].to_numpy(), width, height)
        return pd.DataFrame({SNAPSHOT: key[0], "cluster": own["a"].to_numpy(), "x": pos[:, 0].round(4), "y": pos[:, 1].round(4)})

    return rows.groupBy(SNAPSHOT).applyInPandas(place, "snapshot_id string, cluster string, x double, y double")
