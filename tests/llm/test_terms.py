import random
from collections import Counter, defaultdict

from graphdrift.llm.term_bitmaps import value_frequencies

EDGE = "repo_id string, commit_hash string, to_module string, term string, record_id int"
NODE = "repo_id string, commit_hash string, importer_count bigint, word string"


def brute(edges, nodes):
    out = {}
    for field, rows in (("to_module", [(r, c, (t or "").replace("\\", "/").strip(" \t") or None) for r, c, t, *_ in edges]), ("importer_count", [(r, c, None if v is None else str(v)) for r, c, v, *_ in nodes])):
        total = len({(r, c) for r, c, _ in rows})
        n, docs = Counter(), defaultdict(set)
        for r, c, t in rows:
            if t is not None:
                n[t] += 1
                docs[t].add((r, c))
        for t in n:
            k = len(docs[t])
            out[field, t] = (n[t], k, "rare" if k < 3 else "common" if k > 0.4 * total else None)
    return out


def run(spark, edges, nodes):
    df = value_frequencies(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE))
    rows = df.collect()
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["snapshots"], r["mark"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(1)
    terms = ["core", " core", "core\t", "a\\b", "a/b", None, "", " ", "Core", "z" * 4000, *[f"m{i}" for i in range(40)]]
    keys = [(rng.choice("rst"), f"c{i}") for i in range(150)] + [(None, "c"), ("r", None)]
    edges = [(*rng.choice(keys), rng.choice([*terms, "core", "core"]), "x", 1) for _ in range(1500)]
    edges += edges[:200]
    nodes = [(*rng.choice(keys), rng.choice([None, 0, 1, 1, 1, 7, 10**12]), "w") for _ in range(400)]
    assert run(spark, edges, nodes) == brute(edges, nodes)


def test_one_record_in_a_third_of_rows(spark):
    edges = [("r", "hot", f"m{i % 50}", "", 1) for i in range(3000)] + [("r", f"c{i}", "core", "", 1) for i in range(6000)]
    assert run(spark, edges, []) == brute(edges, [])


def test_empty(spark):
    assert run(spark, [], []) == {}
