import random
from datetime import datetime

from graphdrift.operators.snapshot_diff import snapshot_changes

EDGE = "repo_id string, commit_hash string, from_module string, to_module string, weight bigint, delivered_at timestamp, balance int, sign string"
FRAME = "repo_id string, commit_hash string, scan_order bigint, weight double"


def _norm(m):
    m = (m or "").replace("\\", "/").strip(" \t")
    return m or None


def brute(edges, frames):
    order = {}
    for r, c, s, _ in frames:
        if None not in (r, c, s):
            order[r, c] = min(s, order.get((r, c), s))
    latest = {}
    for r, c, f, t, w, at, *_ in edges:
        f, t = _norm(f), _norm(t)
        if None in (r, c, f, t):
            continue
        rank = (at or datetime.min, 1 if w is None else w)
        latest[r, c, f, t] = max(latest.get((r, c, f, t), rank), rank)
    snap = {}
    for (r, c, f, t), (_, w) in latest.items():
        snap.setdefault((r, c), {})[f, t] = w
    out = set()
    for r in {r for r, _ in order}:
        seq = [c for (_, c) in sorted((k for k in order if k[0] == r), key=lambda k: (order[k], k[1]))]
        for a, b in zip(seq, seq[1:]):
            old, new = snap.get((r, a), {}), snap.get((r, b), {})
            for k in old.keys() | new.keys():
                if old.get(k) != new.get(k):
                    out.add((r, b, *k, "added" if k not in old else "removed" if k not in new else "changed"))
    return out


def run(spark, edges, frames):
    df = snapshot_changes(spark.createDataFrame(edges, EDGE), spark.createDataFrame(frames, FRAME))
    rows = [tuple(r)[:5] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rng = random.Random(4)
    mods = ["a", " a", "a/b", "a\\b", "\tb ", "core", None, "", "  ", "ü" * 3000]
    frames = [("r", f"c{i}", i // 2, 0.5) for i in range(8)] * 2 + [("s", "c0", 3, None), (None, "c", 1, 1.0), ("s", "x", None, 1.0), ("s", "empty", 9, 0.0)]
    edges = [
        (rng.choice(["r", "r", "s", None]), f"c{rng.randrange(9)}", rng.choice(mods), rng.choice([*mods, "core", "core"]), rng.choice([None, 1, 1, 2, 9]),
         rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, rng.randrange(1, 4))]), 1, "x")
        for _ in range(600)
    ]
    edges += edges[:100]
    assert run(spark, edges, frames) == brute(edges, frames)


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("r", "a", 1, 0.0), ("r", "b", 2, 0.0)]) == set()


def test_frame_without_edges_removes_all(spark):
    e = [("r", "a", "x", "y", None, None, 0, "")]
    f = [("r", "a", 1, 0.0), ("r", "b", 2, 0.0), ("r", "c", 3, 0.0)]
    assert run(spark, e, f) == {("r", "b", "x", "y", "removed")}
