"""Density clustering over all points, in blocks, against points in memory."""

import numpy as np
import pandas as pd
import pytest

from scenelake.operators import cluster, spanning


def prim(x, min_samples):
    """Sorted weights of the tree, which are the same for every least spanning tree."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    best, inside, out = reach[0].copy(), np.zeros(len(x), bool), []
    inside[0] = True
    for _ in range(len(x) - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        out.append(best[j])
        inside[j] = True
        best = np.minimum(best, reach[j])
    return sorted(out)


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")


@pytest.mark.parametrize("block, fan", [(1000, 8), (40, 2)])
def test_tree_of_all_points(spark, block, fan):
    x = np.round(np.random.default_rng(5).normal(size=(150, 3)), 1)  # many ties
    x[100:120] = x[0]  # repeated points
    tree = spanning.spanning_tree(spanning.numbered(table(spark, x)), 4, block, fan).collect()
    assert sorted(r.w for r in tree) == pytest.approx(prim(x, 4))
    root = {}
    for r in tree:  # no cycle
        ends = []
        for a in (r.lo, r.hi):
            while root.get(a, a) != a:
                a = root[a]
            ends.append(a)
        assert ends[0] != ends[1]
        root[ends[0]] = ends[1]


def test_small_clusters_among_many_points(spark):
    """Clusters that a sample of 2,000 would lose: 40 of 5,000 points each."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(c, 0.02, (40, 2)) for c in ((0, 0), (5, 5))] + [r.uniform(-60, 60, (4920, 2))])
    got = {p.id: p.cluster for p in cluster.density_clusters(table(spark, x), 25, 5, 2000).collect()}
    want = cluster.density_labels(x, 25, 5)
    assert len(got) == 5000
    pairs = {(got[i], int(want[i])) for i in range(5000)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # the same classes
    for at in (0, 40):
        (name,) = {got[i] for i in range(at, at + 40)}
        assert name >= 0


def test_edges_that_no_list_holds(spark, monkeypatch):
    """Places far apart, each with more points than a list: the edges between them are searched for, and the largest part waits."""
    monkeypatch.setattr(spanning, "NEAREST", 3)
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(c, 1, (n, 2)) for c, n in ((0, 50), (30, 20), (-90, 20), (200, 9))])
    tree = spanning.spanning_tree(spanning.numbered(table(spark, x)), 2, 30, 2).collect()
    assert sorted(e.w for e in tree) == pytest.approx(prim(x, 2)) and len(tree) == len(x) - 1


def test_far_boxes_are_not_compared(monkeypatch):
    """Of points in many places only boxes near each other are compared, and the least edges out are those of all pairs."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(r.uniform(-50, 50, 3), 0.3, (250, 3)) for _ in range(24)])
    x, part = x[spanning._boxed(x)], r.integers(0, 40, 6000)
    d = spanning.distances(x, x)
    core = np.sort(d, axis=1)[:, 5]
    row = {"i": 0} | {c: np.asarray(v).tobytes() for c, v in {"x": x, "node": np.arange(6000), "times": np.ones(6000, np.int64), "core": core, "part": part, "bound": np.full(6000, np.inf)}.items()}
    compared, within = [], spanning._within
    monkeypatch.setattr(spanning, "_within", lambda a, b, *more: compared.append(len(a) * len(b)) or within(a, b, *more))
    boxes = spanning._Boxes(pd.DataFrame([row]))
    found = spanning._outward(boxes, boxes)
    reach = np.where(part[:, None] == part, np.inf, np.maximum(d, np.maximum(core[:, None], core)))
    assert found["w"].tolist() == [reach[part == p].min() for p in range(40)]
    assert sum(compared) < 0.1 * 6000**2


def test_points_without_place(spark):
    rows = spark.createDataFrame([(1, None), (2, [0.0, None]), (3, [0.0, 1.0]), (3, [0.0, 1.0])], "id long, x array<double>")
    assert sorted(tuple(r) for r in cluster.density_clusters(rows, 5, 2).collect()) == [(1, -1), (2, -1), (3, -1), (3, -1)]
    assert cluster.density_clusters(rows.limit(0), 5, 2).count() == 0
    assert {r.cluster for r in cluster.density_clusters(table(spark, np.zeros((30, 2))), 5, 2).collect()} != set()
