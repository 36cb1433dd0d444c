"""Exact graph algorithms on one snapshot's graph, run for all snapshots as grouped maps.

A snapshot's graph is bounded by the number of modules of one repository, so a group is one graph, never the table. All
functions take a set of nodes and {(from, to): weight}; ties follow names, so results don't depend on any order of rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edges = dict[tuple[str, str], int]
#: Sources whose breadth-first searches advance together.
BLOCK = 256
#: Bound of the matrix of sources and edges that they hold at once.
CELLS = 8_000_000


def strong_components(nodes: set[str], edges: Edges) -> dict[str, str]:
    """Node -> smallest name of its strongly connected component (iterative low-link)."""
    after = defaultdict(list)
    for a, b in sorted(edges):
        after[a].append(b)
    order, low, on, stack, out, count = {}, {}, set(), [], {}, 0
    for root in sorted(nodes):
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = count
        count += 1
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    name = min(members)
                    out |= dict.fromkeys(members, name)
    return out


def impacts(nodes: set[str], edges: Edges, target: str) -> dict[str, tuple[int, float]]:
    """What depends on `target`: node -> (distance, ln(1+w)/(1+d)^2), w the greatest weight of an edge one step nearer."""
    before = defaultdict(dict)
    for (a, b), w in edges.items():
        before[b][a] = w
    seen, layer, d, out = {target}, [target], 0, {}
    while layer:
        d += 1
        best: dict[str, int] = {}
        for y in layer:
            for x, w in before[y].items():
                if x not in seen:
                    best[x] = max(best.get(x, 0), w)
        for x, w in best.items():
            out[x] = (d, math.log1p(w) / (1 + d) ** 2)
        seen |= set(best)
        layer = list(best)
    return out


def blast_sums(nodes: set[str], edges: Edges) -> dict[str, tuple[int, float]]:
    """For every node, the number of nodes that depend on it and the sum of their impacts (see `impacts`).

    All breadth-first searches advance together, one distance a round: the reached sets of all sources are the rows of a bit
    matrix, and an edge joins the row of its target's frontier to its source. Sources are taken in blocks, so that memory is
    bounded by CELLS, not by the square of the graph.
    """
    names = sorted(nodes)
    at = {x: i for i, x in enumerate(names)}
    n = len(names)
    if not edges:
        return dict.fromkeys(names, (0, 0.0))
    a = np.fromiter((at[k[0]] for k in edges), np.int64, len(edges))
    b = np.fromiter((at[k[1]] for k in edges), np.int64, len(edges))
    w = np.log1p(np.fromiter(edges.values(), np.float64, len(edges)))
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    heads, first = np.unique(a, return_index=True)
    out: dict[str, tuple[int, float]] = {}
    width = max(1, min(BLOCK, CELLS // max(n, len(edges))))
    for begin in range(0, n, width):
        block = np.arange(begin, min(n, begin + width))
        seen = np.zeros((n, len(block)), dtype=bool)
        seen[block, np.arange(len(block))] = True
        front, count, reach, d = seen.copy(), np.zeros(len(block), np.int64), np.zeros(len(block)), 0
        while front.any():
            d += 1
            # the greatest weight by which each head reaches the frontier of each source
            best = np.zeros((n, len(block)))
            best[heads] = np.maximum.reduceat(np.where(front[b], w[:, None], 0.0), first, axis=0)
            hit = np.zeros((n, len(block)), dtype=bool)
            hit[heads] = np.logical_or.reduceat(front[b], first, axis=0)
            front = hit & ~seen
            seen |= front
            count += front.sum(axis=0)
            reach += np.where(front, best, 0.0).sum(axis=0) / (1 + d) ** 2
        out |= {names[i]: (int(c), float(r)) for i, c, r in zip(block, count, reach, strict=True)}
    return out


def cut_vertices(nodes: set[str], edges: Edges) -> dict[str, int]:
    """Cut vertex of the undirected graph -> number of parts that its component falls into without it; none below 3 nodes."""
    if len(nodes) < 3:
        return {}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    order, low, parts, count = {}, {}, defaultdict(int), 0
    for root in sorted(nodes):
        if root in order:
            continue
        order[root] = low[root] = count
        count += 1
        children = 0
        work = [(root, None, iter(sorted(near[root])))]
        while work:
            v, parent, rest = work[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = count
                    count += 1
                    work.append((w, v, iter(sorted(near[w]))))
                    break
            else:
                work.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[v])
                if parent == root:
                    children += 1
                elif low[v] >= order[parent]:
                    parts[parent] += 1
        if children > 1:
            parts[root] = children
    # a non-root cut vertex also keeps the part above it
    roots = {r for r in parts if order[r] == low[r] and not any(order[x] < order[r] for x in near[r])}
    return {v: n + (v not in roots) for v, n in parts.items()}


def condensed(nodes: set[str], edges: Edges) -> tuple[dict[str, str], Edges]:
    """(node -> component, edges between components with the greatest weight)."""
    comp = strong_components(nodes, edges)
    out: Edges = {}
    for (a, b), w in edges.items():
        if comp[a] != comp[b]:
            k = comp[a], comp[b]
            out[k] = max(out.get(k, 0), w)
    return comp, out


def _topological(comps: set[str], edges: Edges) -> list[str]:
    after, need = defaultdict(list), dict.fromkeys(comps, 0)
    for a, b in edges:
        after[a].append(b)
        need[b] += 1
    ready, out = sorted(c for c in comps if not need[c]), []
    while ready:
        v = ready.pop(0)
        out.append(v)
        for w in sorted(after[v]):
            need[w] -= 1
            if not need[w]:
                ready.append(w)
    return out


def longest_chains(nodes: set[str], edges: Edges, k: int) -> list[tuple[int, list[str]]]:
    """(total weight, chain of representatives) of the k heaviest chains by their ends; a component's representative is its
    member of highest degree. None for fewer than two nodes or components."""
    comp, links = condensed(nodes, edges)
    comps = set(comp.values())
    if len(nodes) < 2 or k <= 0 or len(comps) < 2:
        return []
    degree = defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
    face: dict[str, str] = {}
    for v in sorted(nodes):
        c = comp[v]
        if c not in face or degree[v] > degree[face[c]]:
            face[c] = v
    into = defaultdict(list)
    for (a, b), w in links.items():
        into[b].append((a, w))
    best = {c: (0, None) for c in comps}
    for c in _topological(comps, links):
        for a, w in sorted(into[c], key=lambda x: face[x[0]]):
            if best[a][0] + w > best[c][0]:
                best[c] = (best[a][0] + w, a)
    ends = sorted((c for c in comps if best[c][0] > 0), key=lambda c: (-best[c][0], face[c]))[:k]
    out = []
    for end in ends:
        chain, c = [], end
        while c is not None:
            chain.append(face[c])
            c = best[c][1]
        out.append((best[end][0], chain[::-1]))
    return out


def layers(nodes: set[str], edges: Edges) -> dict[str, int]:
    """Node -> number of edges on the longest path of components that leads to its component."""
    comp, links = condensed(nodes, edges)
    level = dict.fromkeys(comp.values(), 0)
    into = defaultdict(list)
    for a, b in links:
        into[b].append(a)
    for c in _topological(set(comp.values()), links):
        level[c] = max([0, *(level[a] + 1 for a in into[c])])
    return {v: level[comp[v]] for v in nodes}


def undirected(nodes: set[str], edges: Edges) -> dict[str, dict[str, int]]:
    near: dict[str, dict[str, int]] = {v: {} for v in nodes}
    for (a, b), w in edges.items():
        if a != b:
            near[a][b] = near[a].get(b, 0) + max(w, 1)
            near[b][a] = near[b].get(a, 0) + max(w, 1)
    return near


def propagate_labels(nodes: set[str], edges: Edges, rounds: int = 12) -> dict[str, int]:
    """Node -> label after asynchronous propagation, in order of descending number of neighbours, then name.

    A node takes the label with the greatest weight around it; ties keep its own label, else the smaller one wins.
    """
    names = sorted(nodes)
    label = {v: i for i, v in enumerate(names)}
    near = undirected(nodes, edges)
    order = sorted(names, key=lambda v: (-len(near[v]), v))
    for _ in range(rounds):
        changed = False
        for v in order:
            if not near[v]:
                continue
            score = defaultdict(int)
            for u, w in near[v].items():
                score[label[u]] += w
            best = max(score, key=lambda x: (score[x], x == label[v], -x))
            if best != label[v]:
                label[v], changed = best, True
        if not changed:
            break
    return label


def per_snapshot(edges: DataFrame, nodes: DataFrame, schema: str, make) -> DataFrame:
    """(snapshot_id, *schema): the rows that make(nodes, edges) gives for each snapshot's graph."""
    fields = [x.split()[0] for x in schema.split(", ")]
    rows = edges.select("snapshot_id", F.col("from_module").alias("a"), F.col("to_module").alias("b"), F.col("weight").alias("w")).unionByName(
        nodes.select("snapshot_id", F.col("module_name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("bigint").alias("w"))
    )

    def run(key: tuple[str, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        links = pdf[pdf["b"].notna()]
        e = dict(zip(zip(links["a"], links["b"], strict=True), links["w"].astype(int), strict=True))
        v = set(pdf["a"]) | set(links["b"])
        return pd.DataFrame([(key[0], *r) for r in make(v, e)], columns=["snapshot_id", *fields])

    return rows.groupBy("snapshot_id").applyInPandas(run, f"snapshot_id string, {schema}")


def scc(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, scc_id): scc_id is the smallest name of the module's strongly connected component."""
    return per_snapshot(edges, nodes, "module_name string, scc_id string", lambda v, e: strong_components(v, e).items())


def blast_all(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, downstream_count, weighted_reach, score, is_articulation_point) for every module."""

    def make(v, e):
        cut = cut_vertices(v, e)
        for m, (count, reach) in blast_sums(v, e).items():
            yield m, count, reach, min(1.0, reach / (len(v) - 1)) if len(v) > 1 else 0.0, m in cut

    return per_snapshot(edges, nodes, "module_name string, downstream_count bigint, weighted_reach double, score double, is_articulation_point boolean", make)


def blast_single(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, target, module_name, distance, impact) of the module that most modules of a snapshot import."""

    def make(v, e):
        importers = defaultdict(int)
        for _, b in e:
            importers[b] += 1
        if importers:
            t = max(sorted(importers), key=lambda m: importers[m])
            for m, (d, x) in sorted(impacts(v, e, t).items()):
                yield t, m, d, x

    return per_snapshot(edges, nodes, "target string, module_name string, distance bigint, impact double", make)


def articulation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, fan_in, fan_out, components_bridged) of the cut vertices."""

    def make(v, e):
        into, out = defaultdict(int), defaultdict(int)
        for a, b in e:
            out[a] += 1
            into[b] += 1
        return [(m, into[m], out[m], n) for m, n in sorted(cut_vertices(v, e).items())]

    return per_snapshot(edges, nodes, "module_name string, fan_in bigint, fan_out bigint, components_bridged bigint", make)


def critical_paths(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(snapshot_id, rank, total_weight, depth, chain) of the k heaviest chains."""

    def make(v, e):
        return [(i + 1, w, len(c), " > ".join(c)) for i, (w, c) in enumerate(longest_chains(v, e, k))]

    return per_snapshot(edges, nodes, "rank bigint, total_weight bigint, depth bigint, chain string", make)


def component_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, layer)."""
    return per_snapshot(edges, nodes, "module_name string, layer bigint", lambda v, e: sorted(layers(v, e).items()))


def label_propagation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, label): label is the smallest name among the modules that share it."""

    def make(v, e):
        label = propagate_labels(v, e)
        first: dict[int, str] = {}
        for m in sorted(v):
            first.setdefault(label[m], m)
        return [(m, first[label[m]]) for m in sorted(v)]

    return per_snapshot(edges, nodes, "module_name string, label string", make)


def layout(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, x, y): a place for every module, the same in every run."""

    def make(v, e):
        from .layout import force_layout

        return [(m, round(x, 6), round(y, 6)) for m, (x, y) in sorted(force_layout(v, e).items())]

    return per_snapshot(edges, nodes, "module_name string, x double, y double", make)


def longest_distance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, scc_id, distance): the greatest total weight of a path of components that ends in each component."""

    def make(v, e):
        comp, links = condensed(v, e)
        best = dict.fromkeys(sorted(set(comp.values())), 0)
        into = defaultdict(list)
        for (a, b), w in links.items():
            into[b].append((a, w))
        for c in _topological(set(best), links):
            best[c] = max([0, *(best[a] + w for a, w in into[c])])
        return list(best.items())

    return per_snapshot(edges, nodes, "scc_id string, distance bigint", make)
