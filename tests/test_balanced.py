from collections import Counter

from graphdrift.operators.balanced import fragment_replicate_join, pack, plan_loads
from graphdrift.operators.module_load import hot_modules, module_totals


def test_keys_near_a_share_are_packed_one_by_one(spark):
    """Eight keys of nearly a task's share each, which hash buckets would throw together, go to eight tasks."""
    fact = spark.createDataFrame([(f"k{i}", j) for i in range(8) for j in range(900)] + [(None, j) for j in range(800)], "k string, v bigint")
    plan = plan_loads(fact, "k", tasks=8, fraction=1.0)
    assert sorted(t for ts in plan.own.values() for t in ts[:1]) == list(range(8))
    per_task = Counter(r["_task"] for r in plan.fragment(fact, "k").select("_task").collect())
    assert sum(per_task.values()) == fact.count() and max(per_task.values()) < 1.3 * fact.count() / 8


def test_pack_balances():
    placed = pack([(i, float(w)) for i, w in enumerate([9, 5, 4, 3, 3, 2, 1, 1])], 4)
    loads = Counter()
    for i, w in enumerate([9, 5, 4, 3, 3, 2, 1, 1]):
        loads[placed[i]] += w
    assert max(loads.values()) == 9 and len(loads) == 4


def test_large_key_is_split_and_result_whole(spark):
    rows = [("hot", i) for i in range(6000)] + [(f"k{i % 90}", i) for i in range(3000)] + [(None, 1), ("", 2)]
    fact = spark.createDataFrame(rows, "k string, v bigint")
    side = spark.createDataFrame([("hot", "h"), ("k1", "a"), ("k1", "b"), ("nobody", "n"), (None, "z")], "k string, name string")
    plan = plan_loads(fact, "k", tasks=8)
    assert len(plan.own["hot"]) >= 4 and len(plan.own) < 8 * 8
    got = Counter((r["k"], r["v"], r["name"]) for r in fragment_replicate_join(fact, side, "k", "left", plan).collect())
    names = {"hot": ["h"], "k1": ["a", "b"]}
    want = Counter((k, v, n) for k, v in rows for n in names.get(k, [None]))
    assert got == want
    per_task = Counter(r["_task"] for r in plan.fragment(fact, "k").select("_task").collect())
    assert max(per_task.values()) < 3 * sum(per_task.values()) / 8


EDGE = "to_module string, weight bigint, row_count string"
NODE = "module_name string, node_kind string, weight int"


def test_totals(spark):
    edges = [("core", None, ""), (" core\t", 5, ""), ("a\\b", 2, ""), ("a/b", 2, ""), ("", 1, ""), (None, 1, ""), ("x" * 5000, 1, "")] * 3
    nodes = [("core", "internal", 1), ("core ", "external", 1), (None, "internal", 1), ("z", None, 1)]
    got = {r["to_module"]: tuple(r)[1:] for r in module_totals(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)).collect()}
    assert got == {"core": (6, 18, 2, 1), "a/b": (6, 12, 0, 0), "x" * 5000: (3, 3, 0, 0)}
    hot = {r[0] for r in hot_modules(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), share=0.3).collect()}
    assert hot == {"core", "a/b"}


def test_empty(spark):
    assert module_totals(spark.createDataFrame([], EDGE), spark.createDataFrame([], NODE)).collect() == []
    assert hot_modules(spark.createDataFrame([], EDGE), spark.createDataFrame([], NODE)).collect() == []
