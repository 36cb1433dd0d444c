import itertools
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from graphdrift.config import parse_config
from graphdrift.operators import graph_algorithms as A
from graphdrift.operators.blast_native import blast_native
from graphdrift.operators.scc_native import scc_native
from graphdrift.operators.scoring import boundary_list, diagnostics, drift
from graphdrift.plans.runtime import ensure_checkpoint_dir


FRAME = "snapshot_id string, repo_id string, commit_hash string, scan_order bigint, frame_ts bigint"


def ring(n):
    return {(f"n{i}", f"n{(i + 1) % n}"): 1 for i in range(n)}


def layered(sizes):
    names = [[f"l{i}_{j}" for j in range(n)] for i, n in enumerate(sizes)]
    return {(a, b): 1 for x, y in itertools.pairwise(names) for a in x for b in y}, names


def tree(n):
    return {(f"t{i // 2}", f"t{i}"): 1 for i in range(1, n)}


_l354, _ = layered([3, 5, 4])
_l343, _n = layered([3, 4, 3])
_l343 |= {(a, b): 1 for a in _n[2] for b in _n[0]}
_ringleaf = ring(10) | {("n0", f"leaf{i}"): 1 for i in range(10)}
_god = {(f"u{i}", "god"): 1 for i in range(15)} | {("god", f"d{i}"): 1 for i in range(10)}
_spaghetti = {(f"s{i}", f"s{j}"): (i + j) % 10 + 1 for i in range(100) for j in range(100) if i != j and (7 * i + 13 * j) % 5 == 0}
_cli = {("cli/app", f"m{i}"): 1 for i in range(12)} | {(f"m{i}", "cli/app"): 1 for i in range(12)}
# name: (edges, total, cycle, layering, hub, coupling, cognitive, instability)
GOLDEN = {
    "simple3": ({("A", "B"): 1, ("A", "C"): 1, ("B", "C"): 1}, 0, 0, 0, 0, 0, 0, 0),
    "ring3": (ring(3), 29, 95.0, 0, 0, 0, 0, 0),
    "tree31": (tree(31), 0, 0, 0, 0, 0, 0, 0),
    "layered_3_5_4": (_l354, 2, 0, 0, 0, 0, 23.9, 0),
    "layered_back": (_l343, 54, 93.5, 87.6, 0, 0, 36.1, 0),
    "ring10_leaf10": (_ringleaf, 29, 76.1, 0, 0, 0, 0, 76.8),
    "god": (_god, 9, 0, 0, 59.6, 0, 0, 0),
    "spaghetti100": (_spaghetti, 84, 86.6, 94.2, 100.0, 86.2, 94.9, 0),
    "entry_exempt": (_cli, 47, 93.2, 74.7, 0, 0, 0, 0),
}


def frames(spark, graphs):
    e = [(s, a, b, w) for s, g in graphs.items() for (a, b), w in g.items() if a != b]
    n = [(s, m, True, None) for s, g in graphs.items() for m in {x for k in g for x in k}]
    return (
        spark.createDataFrame(e, "snapshot_id string, from_module string, to_module string, weight bigint"),
        spark.createDataFrame(n, "snapshot_id string, module_name string, is_internal boolean, importer_count bigint"),
    )


def test_score_goldens(spark):
    edges, nodes = frames(spark, {k: v[0] for k, v in GOLDEN.items()})
    scc = A.scc(edges, nodes).cache()
    fr = spark.createDataFrame([(k, k, "c", i, i) for i, k in enumerate([*GOLDEN, "nothing"])], FRAME)
    rows = drift(edges, nodes, fr, scc).collect()
    assert [tuple(r)[1:8] for r in rows if r["snapshot_id"] == "nothing"] == [(len(GOLDEN), 0, 0, 0, 0, 0, 0)]
    got = {r["snapshot_id"]: tuple(r[c] for c in ("total", "cycle_debt", "layering_debt", "hub_debt", "coupling_debt", "cognitive_debt", "instability_debt")) for r in rows}
    for name, (_, *want) in GOLDEN.items():
        assert got[name] == pytest.approx(tuple(want), abs=0.051), name


def test_native_components_equal_grouped(spark):
    rng = random.Random(3)
    graphs = {k: v[0] for k, v in GOLDEN.items() if len(v[0]) < 200}
    graphs |= {f"r{i}": {(f"v{rng.randrange(14)}", f"v{rng.randrange(14)}"): 1 for _ in range(22)} for i in range(6)}
    edges, nodes = frames(spark, graphs)
    a = {tuple(r) for r in A.scc(edges, nodes).collect()}
    assert {tuple(r) for r in scc_native(edges, nodes).collect()} == a


def test_native_components_keep_little_on_disk(spark):
    """Edges are held once as numbers, whatever the number of rounds; repeated edges, self-edges and lone modules don't matter."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*") if p.is_file())
    ids = spark.range(2000).select(F.concat(F.lit("repository-with-a-long-name@"), F.md5(F.col("id").cast("string"))).alias("snapshot_id"))
    graph = ring(6) | {(f"n{i}", f"leaf{i}"): 1 for i in range(6)} | {(f"leaf{i}", f"end{i}"): 1 for i in range(6)} | {("own", "own"): 1}
    links = spark.createDataFrame([*graph, *graph], "from_module string, to_module string")
    edges, nodes = ids.crossJoin(links), ids.withColumn("module_name", F.lit("lone"))
    before = size()
    got = scc_native(edges, nodes)
    assert size() - before < 1_000_000
    rows = {(r["module_name"], r["scc_id"]): r["count"] for r in got.groupBy("module_name", "scc_id").count().collect()}
    assert rows == {(m, "n0" if m[0] == "n" else m): 2000 for m in {x for k in graph for x in k} | {"lone"}}


def test_native_impacts_equal_grouped(spark):
    rng = random.Random(9)
    graphs = {k: v[0] for k, v in GOLDEN.items() if len(v[0]) < 60}
    graphs |= {f"r{i}": {(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}"): rng.randrange(1, 9) for _ in range(20)} for i in range(4)}
    edges, nodes = frames(spark, graphs)
    a = {tuple(r)[:2]: (r[2], pytest.approx(r[3])) for r in A.blast_all(edges, nodes).collect()}
    assert {tuple(r)[:2]: (r[2], r[3]) for r in blast_native(edges, nodes).collect()} == a


def test_empty_graph(spark):
    edges, nodes = frames(spark, {})
    assert blast_native(edges, nodes).collect() == []
    assert A.scc(edges, nodes).collect() == [] and scc_native(edges, nodes).collect() == []
    assert drift(edges, nodes, spark.createDataFrame([], FRAME), A.scc(edges, nodes)).collect() == []
    assert diagnostics(edges, nodes, A.scc(edges, nodes)).collect() == []


def test_scores_by_configuration(spark):
    """Weights, exemptions, thresholds and boundaries change what they should, and the higher of both layering scores counts."""
    edges, nodes = frames(spark, {"god": _god, "back": _l343})
    scc, fr = A.scc(edges, nodes).cache(), spark.createDataFrame([("god", "r", "c0", 0, 5), ("back", "r", "c1", 1, 6)], FRAME)

    def run(text):
        return {r["snapshot_id"]: r for r in drift(edges, nodes, fr, scc, parse_config(text).scoring).collect()}

    plain = run("")
    assert plain["god"]["hub_debt"] == 59.6 and plain["god"]["total"] == 9 and plain["back"]["timestamp"] == 6
    assert run('[scoring.exemptions]\nhub_exempt = ["go"]')["god"]["hub_debt"] == 0
    assert run("[scoring.thresholds]\nentry_point_max_fan_in = 15")["god"]["hub_debt"] == 0
    only = run("[scoring.weights]\ncycle = 0\nlayering = 0\nhub = 1\ncoupling = 0\ncognitive = 0\ninstability = 0")
    assert only["god"]["total"] == 60 and only["back"]["total"] == 0
    rules = parse_config('[[scoring.boundaries]]\nfrom = "god"\ndeny = ["d*"]\n[[scoring.boundaries]]\nfrom = "*"\ndeny = ["d1"]').scoring
    got = {r["snapshot_id"]: r for r in drift(edges, nodes, fr, scc, rules).collect()}
    assert got["god"]["boundary_violations"] == 10 and got["god"]["layering_violations"] == 0
    assert got["god"]["layering_debt"] == pytest.approx(round(100 * (1 - math.exp(-3 * 10 / 25)), 1))
    assert got["back"]["layering_debt"] == 87.6 and got["back"]["boundary_violations"] == 0
    listed = boundary_list(edges, rules, shown=3).collect()
    assert [(r["rank"], r["to_module"], r["n_found"]) for r in sorted(listed, key=lambda r: r["rank"])] == [(1, "d0", 10), (2, "d1", 10), (3, "d2", 10)]
    found = {(r["rule_id"], r["args"]) for r in diagnostics(edges, nodes, scc, rules).where("snapshot_id = 'god'").collect()}
    assert ("hub", "god 15 10") in found and ("boundary", "10") in found


CHAIN = {("A", "B"): 1, ("B", "C"): 1, ("C", "D"): 1}


def test_impacts():
    reach = {m: sum(x for _, x in A.impacts(set("ABCD"), CHAIN, m).values()) for m in "ABCD"}
    assert reach == pytest.approx({"A": 0, "B": 0.173287, "C": 0.250303, "D": 0.293625}, abs=1e-6)
    tie = {("S", "X"): 1, ("S", "Y"): 5, ("X", "T"): 1, ("Y", "T"): 9}
    assert A.impacts(set("STXY"), tie, "T")["S"] == (2, pytest.approx(math.log(6) / 9))


def test_cut_vertices_against_deletion():
    assert A.cut_vertices(set("ABCD"), CHAIN) == {"B": 2, "C": 2}
    assert A.cut_vertices({"A", "B"}, {("A", "B"): 1}) == {}
    assert A.cut_vertices(set("ABCD"), {("A", "B"): 1, ("A", "C"): 1, ("B", "D"): 1, ("C", "D"): 1}) == {}
    rng = random.Random(5)
    for _ in range(60):
        names = [f"v{i}" for i in range(9)]
        e = {(rng.choice(names), rng.choice(names)): 1 for _ in range(rng.randrange(4, 14))}
        e = {k: 1 for k in e if k[0] != k[1]}
        nodes = {x for k in e for x in k}

        def parts(left, e=e):
            seen, count = set(), 0
            for s in left:
                if s not in seen:
                    count += 1
                    todo = [s]
                    while todo:
                        v = todo.pop()
                        if v not in seen:
                            seen.add(v)
                            todo += [b if a == v else a for a, b in e if v in (a, b) and a in left and b in left]
            return count

        whole = parts(nodes)
        want = {v: parts(nodes - {v}) - whole + 1 for v in nodes if len(nodes) > 2 and parts(nodes - {v}) > whole}
        assert A.cut_vertices(nodes, e) == want


def test_chains():
    assert A.longest_chains(set("ABCD"), CHAIN, 3) == [(3, list("ABCD")), (2, list("ABC")), (1, list("AB"))]
    cycle = {("A", "B"): 1, ("B", "C"): 1, ("C", "A"): 1, ("C", "D"): 2}
    assert A.longest_chains(set("ABCD"), cycle, 3) == [(2, ["C", "D"])]
    assert A.longest_chains({"A"}, {}, 3) == []


def test_layers_and_labels():
    assert A.layers(set("ABCD"), CHAIN) == {"A": 0, "B": 1, "C": 2, "D": 3}
    two = {(a, b): 5 for g in ("abc", "xyz") for a, b in itertools.permutations(g, 2)} | {("a", "x"): 1}
    labels = A.propagate_labels(set("abcxyz"), two)
    assert len({labels[v] for v in "abc"}) == 1 and len({labels[v] for v in "xyz"}) == 1 and labels["a"] != labels["x"]
