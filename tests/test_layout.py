import numpy as np

from graphdrift.operators import layout as L


def test_grid_repulsion_is_near_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    for pos in (rng.normal(0, 5, (900, 2)), np.concatenate([rng.normal(0, 0.2, (500, 2)), rng.uniform(-40, 40, (500, 2))]), rng.uniform(0, 1, (600, 2)) * (100, 1)):
        want, got = L.dense_repulsion(pos, pos), L.repulsion(pos)
        off = np.linalg.norm(got - want, axis=1) / np.maximum(np.linalg.norm(want, axis=1), 1.0)
        assert np.median(off) < 0.05 and off.mean() < 0.1


def test_points_that_coincide():
    got = L.repulsion(np.zeros((1000, 2)))
    assert np.isfinite(got).all() and np.abs(got).max() < 1e-6


def test_layout_is_the_same_in_every_run_and_separates():
    edges = {(f"a{i}", f"a{j}"): 3 for i in range(6) for j in range(i)} | {(f"b{i}", f"b{j}"): 3 for i in range(6) for j in range(i)}
    labels = {x for e in edges for x in e}
    one = L.force_layout(labels, edges)
    assert one == L.force_layout(set(sorted(labels)), dict(sorted(edges.items(), reverse=True)))
    a, b = (np.array([p for x, p in one.items() if x[0] == k]) for k in "ab")
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > a.std(axis=0).max()
    assert L.force_layout(set(), {}) == {} and set(L.force_layout({"x"}, {})) == {"x"}


def test_overview_places_by_role():
    size, role = np.array([9.0, 4, 2, 1]), np.array([2, 2, 1, 0])
    a, b, w = np.array([0, 1]), np.array([1, 3]), np.array([5.0, 2])
    pos = L.overview_places(size, role, a, b, w, 1000, 600)
    assert (pos[:, 0] >= 100).all() and (pos[:, 0] <= 900).all() and (pos[:, 1] >= 84).all() and (pos[:, 1] <= 540).all()
    assert pos[3, 0] == pos[:, 0].max() and len({tuple(p) for p in pos.round(3)}) == 4
    assert L.overview_places(np.array([1.0]), np.array([2]), a[:0], b[:0], w[:0], 1000, 600).shape == (1, 2)
