"""Architecture map of one snapshot's graph: clusters from namespaces and structure, with names, kinds, roles and places.

The steps depend on each other's result, so one graph is worked on by one task, all snapshots in parallel. Clusters are
gone through in the order of their smallest label, so nothing depends on the order of rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Clustering
from ..functions.labels import FIXED_PREFIXES, FIXED_ROOTS, KIND_BY_NAME
from ..functions.paths import globs_regex
from .graph_algorithms import Edges, layers, propagate_labels, undirected

DEPS, ROOT = "__deps__", "__root__"
Groups = list[set[str]]


def root_token(label: str) -> str | None:
    for sep in "_-":
        head, found, _ = label.partition(sep)
        if found and len(head.encode()) >= 3:
            return head
    return None


class Namespaces:
    """Namespace of each label of a graph under a configuration."""

    def __init__(self, labels: set[str], internal: set[str], cfg: Clustering):
        self.internal, self.cfg = internal, cfg
        self.tokens = Counter(t for x in labels & internal if "/" not in x and (t := root_token(x)))
        self.heads = {x.split("/", 1)[0] for x in labels & internal if "/" in x}

    def of(self, label: str) -> str | None:
        cfg = self.cfg
        if family := cfg.family(label):
            return family.name
        if label not in self.internal:
            return DEPS if cfg.collapse_external else label
        if "/" in label:
            return label.split("/", 1)[0]
        if label in FIXED_ROOTS or (cfg.include_exact_roots and label in self.heads):
            return label
        for prefix, name in FIXED_PREFIXES.items():
            if label.startswith(prefix):
                return name
        token = root_token(label)
        if token and self.tokens[token] >= cfg.root_token_min_repeats:
            return token
        return ROOT if re.fullmatch(r"[A-Za-z0-9_-]*", label) else None

    def base_name(self, members: set[str]) -> str:
        """Most frequent namespace, ties to the smaller; the root one becomes its dominant token or the fallback family."""
        count = Counter(n for m in members if (n := self.of(m)))
        if not count:
            return min(members)
        name = min(count, key=lambda n: (-count[n], n))
        if name == DEPS:
            return "deps"
        if name != ROOT:
            return name
        tokens = Counter(t for m in members if (t := root_token(m)))
        best = min(tokens, key=lambda t: (-tokens[t], t), default=None)
        return best if best and tokens[best] >= 2 and 2 * tokens[best] >= sum(tokens.values()) else self.cfg.fallback_family


def _ordered(groups: Groups) -> Groups:
    return sorted((g for g in groups if g), key=min)


def by_namespace(labels: set[str], spaces: Namespaces) -> Groups | None:
    """Labels grouped by namespace; None if a label has none or there are fewer than two groups."""
    groups = defaultdict(set)
    for x in labels:
        groups[spaces.of(x)].add(x)
    return None if None in groups or len(groups) < 2 else _ordered(list(groups.values()))


def by_structure(labels: set[str], edges: Edges) -> Groups:
    groups = defaultdict(set)
    for x, label in propagate_labels(labels, edges).items():
        groups[label].add(x)
    return _ordered(list(groups.values()))


def _inner(edges: Edges, members: set[str]) -> Edges:
    return {(a, b): w for (a, b), w in edges.items() if a in members and b in members}


def split_dominant(groups: Groups, labels: set[str], edges: Edges, spaces: Namespaces, generic: bool = False) -> Groups:
    """Split families that dominate (or, if `generic`, carry the fallback name) by propagation inside them, where that gives
    two parts of the least size or more that bear different names."""
    cfg, out = spaces.cfg, []
    for g in groups:
        name = spaces.base_name(g)
        dominant = name == cfg.fallback_family or (not generic and len(g) / len(labels) >= cfg.max_cluster_share)
        if name == "deps" or len(g) < cfg.split_threshold or not dominant or any(f.name == name and f.split == "never" for f in cfg.families):
            out.append(g)
            continue
        parts = by_structure(g, _inner(edges, g))
        large = [p for p in parts if len(p) >= cfg.min_cluster_size]
        pure = not cfg.purity or len({spaces.base_name(p) for p in large}) >= 2
        out += parts if len(large) >= 2 and pure else [g]
    return _ordered(out)


def merge_small(groups: Groups, edges: Edges, spaces: Namespaces) -> Groups:
    """Clusters below the least size join a neighbour: of the same name first, then by weight, then the earlier one."""
    groups, least = [set(g) for g in groups], max(2, spaces.cfg.min_cluster_size)
    near = undirected({x for g in groups for x in g}, edges)
    place = {x: j for j, h in enumerate(groups) for x in h}
    for i, g in enumerate(groups):
        if not g or len(g) >= least:
            continue
        weight = Counter()
        for x in g:
            for y, w in near[x].items():
                if place[y] != i:
                    weight[place[y]] += w
        if weight:
            name = spaces.base_name(g)
            best = min(weight, key=lambda j: (spaces.base_name(groups[j]) != name, -weight[j], j))
            groups[best] |= g
            place |= dict.fromkeys(g, best)
            groups[i] = set()
    return _ordered(groups)


def must_group(groups: Groups, cfg: Clustering) -> Groups:
    """Labels that a rule keeps together move to the cluster that holds most of them."""
    for rule in cfg.constraints:
        if rule.type == "must_group":
            rx = globs_regex([*rule.left, *rule.right])
            hits = [{x for x in g if re.match(rx, x)} for g in groups]
            if any(hits):
                best = max(range(len(groups)), key=lambda i: (len(hits[i]), -i))
                moved = set().union(*hits)
                groups = [g | moved if i == best else g - moved for i, g in enumerate(groups)]
    return _ordered(groups)


def must_separate(groups: Groups, cfg: Clustering) -> Groups:
    """Where a cluster holds both sides of a rule, what matches only the right side (else only the left) moves out."""
    for rule in cfg.constraints:
        if rule.type == "must_separate":
            left, right, out = globs_regex(rule.left), globs_regex(rule.right), []
            for g in groups:
                a, b = {x for x in g if re.match(left, x)}, {x for x in g if re.match(right, x)}
                moved = (b - a) or (a - b)
                out += [g - moved, moved] if a and b and moved and moved != g else [g]
            groups = out
    return _ordered(groups)


@dataclass
class Cluster:
    members: set[str]
    name: str
    kind: str
    role: str
    anchor: str
    layer: int = 0
    x: float = 0.5
    y: float = 0.5
    inside: int = 0
    outbound: int = 0
    inbound: int = 0


def _suffix(name: str, anchor: str) -> str | None:
    a = anchor.strip()
    if not a or a.lower() == name.lower():
        return None
    rest = next((a[len(name) + 1 :] for s in "/_-" if a.startswith(name + s)), None)
    if rest is None:
        rest = next((a.rsplit(s, 1)[1] for s in "/_-" if s in a), a)
    return rest.strip()[:16] or None


def unique_names(clusters: list[Cluster]) -> None:
    """Equal names get what tells their anchors apart in brackets, else a number."""
    same = defaultdict(list)
    for c in clusters:
        same[c.name].append(c)
    for name, cs in same.items():
        if len(cs) > 1:
            taken: set[str] = set()
            for c in cs:
                s = _suffix(name, c.anchor)
                if s and f"{name} [{s}]" not in taken:
                    c.name = f"{name} [{s}]"
                    taken.add(c.name)
            number = 1
            for c in cs:
                while c.name == name:
                    if (new := f"{name} [{number}]") not in taken:
                        c.name = new
                        taken.add(new)
                    number += 1


def build_map(labels: set[str], edges: Edges, internal: set[str], cfg: Clustering | None = None) -> list[Cluster] | None:
    """The clusters of a graph, or None below three labels or two clusters."""
    cfg = cfg or Clustering()
    if len(labels) < 3:
        return None
    spaces = Namespaces(labels, internal, cfg)
    seed = None if cfg.strategy == "structural" else by_namespace(labels, spaces)
    groups = seed or by_structure(labels, edges)
    groups = merge_small(must_group(groups, cfg), edges, spaces) if cfg.post_merge else must_group(groups, cfg)
    if cfg.structural and cfg.strategy != "namespace":
        groups = split_dominant(split_dominant(groups, labels, edges, spaces), labels, edges, spaces, generic=True)
        groups = merge_small(groups, edges, spaces) if cfg.post_merge else groups
    groups = must_separate(must_group(groups, cfg), cfg)
    if len(groups) < 2:
        return None
    place = {x: i for i, g in enumerate(groups) for x in g}
    degree, inside, out, into, links = Counter(), Counter(), Counter(), Counter(), Counter()
    for (a, b), w in edges.items():
        degree[a] += w
        degree[b] += w
        i, j = place[a], place[b]
        if i == j:
            inside[i] += w
        else:
            out[i] += w
            into[j] += w
            links[str(i), str(j)] += w
    level = layers({str(i) for i in range(len(groups))}, dict(links))
    clusters = []
    for i, g in enumerate(groups):
        base = spaces.base_name(g)
        name, n_int = cfg.aliases.get(base, base), len(g & internal)
        kind = cfg.kinds.get(name) or cfg.kinds.get(name.lower()) or next((f.kind for f in cfg.families if f.name == base and f.kind), None)
        if not kind:
            kind = "external" if not n_int else next((k for k, names in KIND_BY_NAME.items() if name.lower() in names), "group")
        n_ext = len(g) - n_int
        role = "external_sink" if kind == "deps" or (not n_int and n_ext) else "support" if n_ext > 3 * n_int and n_int <= 2 else "primary"
        anchor = max(g, key=lambda x: (degree[x], x))
        clusters.append(Cluster(g, name, kind, role, anchor, level[str(i)], inside=inside[i], outbound=out[i], inbound=into[i]))
    # fixed values: the margins of the map and the room between them
    deepest = max(c.layer for c in clusters)
    for depth in range(deepest + 1):
        row = sorted((c for c in clusters if c.layer == depth), key=lambda c: (-c.outbound, -c.inbound, -len(c.members), c.name))
        for r, c in enumerate(row):
            spread = 0.5 if len(row) == 1 else 0.16 + r / (len(row) - 1) * 0.68
            c.x, c.y = (spread if deepest == 0 else 0.14 + depth / deepest * 0.72), spread
    if cfg.disambiguate:
        unique_names(clusters)
    return clusters


def architecture_maps(edges: DataFrame, nodes: DataFrame, cfg: Clustering | None = None) -> DataFrame:
    """One row per module of each snapshot that has a map, with its cluster's name, kind, role, anchor, layer and place."""
    rows = edges.select("snapshot_id", F.col("from_module").alias("a"), F.col("to_module").alias("b"), F.col("weight").alias("w"), F.lit(False).alias("i")).unionByName(
        nodes.select("snapshot_id", F.col("module_name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("bigint").alias("w"), F.col("is_internal").alias("i"))
    )
    import pandas as pd

    names = ["snapshot_id", "module_name", "cluster", "kind", "role", "anchor", "layer", "x_ratio", "y_ratio", "internal_weight", "outbound_weight", "inbound_weight"]

    def run(key: tuple[str, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        links, own = pdf[pdf["b"].notna()], pdf[pdf["b"].isna()]
        e = dict(zip(zip(links["a"], links["b"], strict=True), links["w"].astype(int), strict=True))
        clusters = build_map(set(pdf["a"]) | set(links["b"]), e, set(own[own["i"]]["a"]), cfg) or []
        out = [
            (key[0], m, c.name, c.kind, c.role, c.anchor, c.layer, round(c.x, 6), round(c.y, 6), c.inside, c.outbound, c.inbound)
            for c in clusters for m in sorted(c.members)
        ]
        return pd.DataFrame(out, columns=names)

    return rows.groupBy("snapshot_id").applyInPandas(
        run, "snapshot_id string, module_name string, cluster string, kind string, role string, anchor string, layer bigint, x_ratio double, y_ratio double, internal_weight bigint, outbound_weight bigint, inbound_weight bigint"
    )
